"""BPE encoding by a segment tree over adjacent-pair ranks, and decoding.

Each pre-token is a row of byte symbols, the last one carrying the word-end suffix. Leaf ``i`` of its
tree holds the merge rank of symbol ``i`` with its living right neighbour, or ``NONE``; every inner
node holds the smaller of its children. The root is the lowest rank; walking down, left child first
on equal values, finds its leftmost place. Merging there changes three leaves, each repaired in
log(n) steps; a root of ``NONE`` ends the word. Words of like length go through this together, one
numpy step for all of them; where few are left, each goes on alone in a tree of plain integers, whose
repairs stop at the first node that doesn't change. So one very long run costs n log n small steps.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import keeps, thrifty
from .token_count import byte_chars

NONE = np.int32(2**31 - 1)
#: With fewer words than this in one numpy step each is merged alone.
FEW = 96
#: Words of more characters aren't kept in the memo.
LONG = 256
#: Fixed: the split pattern of the word-end vocabulary.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_VOUCHED = re.compile("[\x00-\u024f\u0300-\u036f\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")
#: White space that ``str.split`` sees and the pattern's ``\\s`` doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")


class TreeBPE:
    """Encoder and decoder for a word-end BPE vocabulary file."""

    def __init__(self, path: str, memo: int = 250_000) -> None:
        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = added
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.tokens: list[str] = [""] * (1 + max([*vocab.values(), *added.values()]))
        for t, i in [*vocab.items(), *added.items()]:
            self.tokens[i] = t
        chars = byte_chars()
        self._byte_of = {c: b for b, c in chars.items()}
        self.plain = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[chars[b] + self.suffix] for b in range(256)], np.int64)
        self.base = len(self.tokens)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        code = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(code, kind="stable")
        self.codes, self.ranks = code[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges] + [0], np.int64)
        self._made = self.made.tolist()
        self.rank_of = dict(zip(self.codes.tolist(), self.ranks.tolist()))
        self.limit, self.words, self.pre = memo, {}, {}
        self.numbers = list(map(str, range(self.base)))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of symbol pairs; ``NONE`` where either is missing (-1) or no merge exists."""
        code = left * self.base + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def merge_one(self, symbols: list[int]) -> list[int]:
        """One word's symbols, merged to the end."""
        n, base, rank_of, none = len(symbols), self.base, self.rank_of, int(NONE)
        if n < 2:
            return symbols
        made = self._made
        width = 1 << (n - 1).bit_length()
        tree = [none] * (2 * width)
        tree[width : width + n - 1] = [rank_of.get(a * base + b, none) for a, b in zip(symbols, symbols[1:])]
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf: int, value: int) -> None:
            tree[leaf] = value
            while leaf > 1:
                other = tree[leaf ^ 1]
                if other < value:
                    value = other
                leaf >>= 1
                if tree[leaf] == value:
                    return
                tree[leaf] = value

        while (best := tree[1]) != none:
            node = 1
            while node < width:
                node *= 2
                if tree[node] != best:
                    node += 1
            i = node - width
            j = after[i]
            new = symbols[i] = made[best]
            symbols[j] = -1
            k, h = after[j], before[i]
            after[i] = k
            put(j + width, none)
            if k < n:
                before[k] = i
                put(node, rank_of.get(new * base + symbols[k], none))
            else:
                put(node, none)
            if h >= 0:
                put(h + width, rank_of.get(symbols[h] * base + new, none))
        return [x for x in symbols if x >= 0]

    def merge_rows(self, symbols: np.ndarray) -> np.ndarray:
        """``symbols``: one word a row, -1 beyond its end, the width a power of two. Merged in place; -1 marks symbols that are gone."""
        n, width = symbols.shape
        if n < FEW:
            return self._alone(symbols, np.arange(n))
        tree = np.full((n, 2 * width), NONE, np.int32)
        tree[:, width : 2 * width - 1] = self.rank(symbols[:, :-1], symbols[:, 1:])
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            best = tree[live, 1]
            node = np.ones(len(live), np.int64)
            while node[0] < width:
                node = 2 * node + (tree[live, 2 * node] != best)
            i = node - width
            j = after[live, i]
            symbols[live, i] = self.made[best]
            symbols[live, j] = -1
            k, h = after[live, j], before[live, i]
            after[live, i] = k
            inside = k < width
            before[live[inside], k[inside]] = i[inside]
            right = np.where(inside, symbols[live, np.minimum(k, width - 1)], -1)
            self._set(tree, live, i + width, self.rank(symbols[live, i], right))
            self._set(tree, live, j + width, np.full(len(live), NONE))
            has = h >= 0
            self._set(tree, live[has], h[has] + width, self.rank(symbols[live[has], h[has]], symbols[live[has], i[has]]))
            live = live[tree[live, 1] != NONE]
            if len(live) < FEW:
                return self._alone(symbols, live)
        return symbols

    def _alone(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        for r in rows:
            left = self.merge_one([x for x in symbols[r].tolist() if x >= 0])
            symbols[r] = -1
            symbols[r, : len(left)] = left
        return symbols

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, node: np.ndarray, value: np.ndarray) -> None:
        if not len(rows):
            return
        tree[rows, node] = value
        node = node >> 1
        while node[0]:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1

    def encode_pretokens(self, pretokens: list[str]) -> list[list[int]]:
        """Ids of each pre-token, by groups of like length."""
        raw = [p.encode("utf-8", "surrogateescape") for p in pretokens]
        size = np.array([len(b) for b in raw], np.int64)
        out: list[list[int]] = [[]] * len(raw)
        width_of = np.maximum(2, 2 ** np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
        for width in np.unique(width_of):
            members = np.flatnonzero(width_of == width)
            rows_at_once = max(1, 262_144 // int(width))
            for at in range(0, len(members), rows_at_once):
                part = members[at : at + rows_at_once]
                n = size[part]
                flat = self.plain[np.frombuffer(b"".join(raw[i] for i in part), np.uint8)]
                flat[np.cumsum(n) - 1] = self.final[[raw[i][-1] for i in part]]
                rows = np.full((len(part), int(width)), -1, np.int64)
                rows[np.arange(int(width)) < n[:, None]] = flat
                rows = self.merge_rows(rows)
                kept = rows >= 0
                ends = np.cumsum(kept.sum(1))
                ids = rows[kept].tolist()
                start = 0
                for i, end in zip(part.tolist(), ends.tolist()):
                    out[i] = ids[start:end]
                    start = end
        return out

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens of a run without white space or special strings.

        Beyond the characters below Unicode tables differ between versions, so there the library's own
        normaliser and pre-tokenizer decide.
        """
        if _VOUCHED.fullmatch(text):
            return PATTERN.findall(self.normal(text))
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        found = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(map(self._byte_of.__getitem__, piece)).decode("utf-8", "surrogateescape") for piece, _ in found]

    @staticmethod
    def normal(text: str) -> str:
        """NFC and lower case character by character (a capital sigma has one lower case here)."""
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()

    @staticmethod
    def split(text: str) -> list[str]:
        """Runs without white space; normalising and pre-tokenizing never cross white space."""
        if _SEPARATORS.search(text):
            return [w for w in _WHITE.split(text) if w]
        return text.split()

    def _parts(self, word: str) -> list[str | int]:
        """Pre-tokens (text) and special tokens (ids) of a run without white space."""
        if self._special is None or "<|" not in word:
            return self.pretokens(word)
        out: list[str | int] = []
        for i, piece in enumerate(self._special.split(word)):
            out += [self.specials[piece]] if i % 2 else self.pretokens(piece)
        return out

    def learn(self, words: set[str]) -> list[str]:
        """Make sure that the memo holds these words; what it held before may go when it is full. Those too long to stay are returned."""
        if len(self.words) > self.limit:
            self.words = {w: self.words[w] for w in words & self.words.keys()}
        new = [w for w in words if w not in self.words]
        parts = [self._parts(w) for w in new]
        wanted = {p for x in parts for p in x if isinstance(p, str)}
        if len(self.pre) > self.limit:
            self.pre = {p: self.pre[p] for p in wanted & self.pre.keys()}
        fresh = [p for p in wanted if p not in self.pre]
        names, tokens, pre = self.numbers, self.tokens, self.pre
        for p, ids in zip(fresh, self.encode_pretokens(fresh)):
            pre[p] = (" ".join([names[i] for i in ids]), " ".join([tokens[i] for i in ids]), len(ids))
        for w, x in zip(new, parts):
            got = [pre[p] if isinstance(p, str) else (names[p], tokens[p], 1) for p in x]
            self.words[w] = got[0] if len(got) == 1 else (" ".join([g[0] for g in got]), " ".join([g[1] for g in got]), sum([g[2] for g in got]))
        for p in fresh:
            if len(p) > LONG:
                del pre[p]
        return [w for w in new if len(w) > LONG]

    def encode_texts(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: the number of ids, the ids joined by spaces, and the decoded text."""
        split = [self.split(t) for t in texts]
        long = self.learn(set().union(*split))
        memo = self.words
        out = []
        for s in split:
            got = [memo[w] for w in s]
            out.append((sum([g[2] for g in got]), " ".join([g[0] for g in got if g[2]]), " ".join([g[1] for g in got if g[2]])))
        for w in long:
            del memo[w]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_texts([text])[0][1].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, word-end suffixes kept: what a vocabulary without a decoder gives."""
        return " ".join([self.tokens[i] for i in ids])


_LOADED: dict[str, TreeBPE] = {}


def load(path: str) -> TreeBPE:
    if path not in _LOADED:
        _LOADED[path] = TreeBPE(path)
    keeps("bpe", _LOADED.clear)
    return _LOADED[path]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def bpe_encode(df: DataFrame, tokenizer_path: str, keep: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for each row, with ids (array) and decoded text if ``keep``.

    A null text counts as empty: no ids, digests of the empty string. Repeated rows and null ids each
    give their row; other columns are not read; an empty table gives no rows; very long texts and words are
    encoded whole. One pass without a shuffle; memory is a slice of a
    batch plus two bounded memos.
    """

    def run(batches):
        bpe = load(tokenizer_path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 128):
                got = bpe.encode_texts([t or "" for t in texts.slice(at, 128).to_pylist()])
                cols = [ids.slice(at, 128), pa.array([g[0] for g in got], pa.int64()), pa.array([_sha(g[1]) for g in got], pa.string()), pa.array([_sha(g[2]) for g in got], pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    cols += [pa.array([list(map(int, g[1].split())) for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(thrifty(run, "bpe"), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep)
