"""Token counts of whole texts, huge ones by overlapping chunks that are resynchronised.

A text of at most ``chunk_chars`` is cut before each single space that stands between two non-blank
characters. Every pre-token pattern takes a space only as its first character or in a run of blanks,
and special strings hold no blank, so each cut ends a pre-token and the counts of the pieces add up.
The library counts each distinct piece once while it stays in a bounded memo.

A longer text is encoded in chunks that overlap; each chunk yields tokens, character offsets and the pre-token each token is in.
Two neighbouring chunks are spliced at a character position that

* ends a pre-token in both encodings, and
* is at least ``MARGIN`` characters before the end of the left chunk.

The byte-level pre-tokenizer scans left to right, its only state is the position, and it looks
one character past a match (three for contractions, thirteen for the special string). So what the
left chunk gives up to such a position is what the whole text gives, and what the right chunk gives
from there on depends on nothing before it: the splice is exact. Tokens inside one pre-token are no
proof, hence mere token ends are not used. Where the overlap holds no common position (a run
without any pre-token end), the overlap doubles up to the whole left chunk, and then that chunk is
encoded anew at twice its length: a run of n characters costs a few times n, not its square.

Both proofs are about that one pre-tokenizer. A file with another one, with a normaliser or with added
tokens that take blanks along is counted by the library on whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
#: Longest special string of the vocabulary (13) and the regex's look-ahead (3).
MARGIN = 16

_LOADED: dict[str, object] = {}


def load(path: str):
    """The tokenizer at ``path``; offsets untrimmed, which changes no token."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel":
            spec["pre_tokenizer"]["trim_offsets"] = False
        tok = Tokenizer.from_str(json.dumps(spec))
        tok.no_truncation()
        tok.no_padding()
        _LOADED[path] = tok
    return _LOADED[path]


def splittable(path: str) -> bool:
    """Whether the file's pre-tokenizer and special strings are those that the cuts below rely on."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    plain = plain and not any(spec["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    return plain and all(t["content"].startswith("<|") and len(t["content"]) < MARGIN and not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in added)


_BLANKS = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S) (?=\S)")


#: Fixed: the pre-token pattern of byte-level BPE vocabularies. Only pieces of the characters below go
#: through it here, on which the two regex engines can't differ; the library takes all others whole.
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_VOUCHED = re.compile("[\t-\r\x20-\x7e\xa1-\u024f]*")


def byte_chars() -> dict[int, str]:
    """Byte -> character of the byte-level alphabet: printable bytes stand for themselves."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_CHARS = byte_chars()


class PieceCounts:
    """Token counts of pieces as the library gives them, the last ``limit`` to ``2 * limit`` of them kept."""

    def __init__(self, tok, limit: int = 250_000) -> None:
        self.tok, self.limit, self.new, self.old, self.pre = tok, limit, {}, {}, {}

    def vouched(self, piece: str) -> int:
        """Pre-tokens by the pattern below, each counted by the library's BPE model."""
        total = 0
        for t in _PATTERN.findall(piece):
            n = self.pre.get(t)
            if n is None:
                if len(self.pre) > self.limit:
                    self.pre.clear()
                n = self.pre[t] = len(self.tok.model.tokenize(t.encode().decode("latin-1").translate(_BYTE_CHARS)))
            total += n
        return total

    @staticmethod
    def pieces(text: str) -> list[str]:
        if _BLANKS.search(text) or text[:1].isspace() or text[-1:].isspace():
            parts = _CUT.split(text)
        else:
            parts = text.split(" ")
        parts[0] = " " + parts[0]  # marked: the only piece without a space before it in the text
        return parts

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.pieces(t) for t in texts]
        wanted = set().union(*split)
        if len(self.new) > self.limit:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        lacking = []
        for p in wanted:
            if p not in new:
                if p in old:
                    new[p] = old[p]
                else:
                    lacking.append(p)
        rest = []
        for p in lacking:
            if _VOUCHED.fullmatch(p) and "<|" not in p:
                new[p] = self.vouched(p[1:] if p[0] == " " else " " + p)
            else:
                rest.append(p)
        for at in range(0, len(rest), 4096):
            plain = [p[1:] if p[0] == " " else " " + p for p in rest[at : at + 4096]]
            for p, e in zip(rest[at : at + 4096], self.tok.encode_batch_fast(plain, add_special_tokens=False)):
                new[p] = len(e)
        return [sum(map(new.__getitem__, s)) for s in split]


class _Chunk:
    """One encoded chunk; ``ends[i]`` is the token count up to boundary ``bounds[i]`` of the text."""

    def __init__(self, tok, text: str, start: int, stop: int) -> None:
        enc = tok.encode(text[start:stop], add_special_tokens=False)
        self.start, self.stop, self.ids = start, stop, enc.ids
        spans = np.array(enc.offsets, np.int64).reshape(-1, 2) + start
        word = np.array([-1 if w is None else w for w in enc.word_ids], np.int64)
        turn = np.flatnonzero((word[1:] != word[:-1]) | (word[1:] < 0))
        turn = turn[spans[turn, 1] == spans[turn + 1, 0]]
        self.bounds, self.ends = spans[turn, 1], turn + 1

    def common(self, right: _Chunk) -> tuple[int, int] | None:
        """Tokens of self before, and of ``right`` up to, the last position proven stable."""
        both, i, j = np.intersect1d(self.bounds, right.bounds, assume_unique=True, return_indices=True)
        ok = np.flatnonzero(both <= self.stop - MARGIN)
        return (int(self.ends[i[ok[-1]]]), int(right.ends[j[ok[-1]]])) if len(ok) else None


def encode_spliced(tok, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[list[int]]:
    """The ids of the whole text, piece by piece; ``[]`` for an empty text."""
    n = len(text)
    if n <= chunk:
        yield tok.encode(text, add_special_tokens=False).ids
        return
    left, done = _Chunk(tok, text, 0, chunk), 0
    while left.stop < n:
        back = max(MARGIN + 1, min(overlap, chunk // 2))
        while True:
            begin = left.stop - back
            if begin <= left.start:  # no boundary anywhere: both as one
                left, at = _Chunk(tok, text, left.start, min(n, 2 * left.stop - left.start)), None
                break
            right = _Chunk(tok, text, begin, min(n, begin + max(chunk, 2 * back)))
            at = left.common(right)
            if at and at[0] >= done:
                break
            back *= 2
        if at:
            yield left.ids[done : at[0]]
            left, done = right, at[1]
    yield left.ids[done:]


def count_tokens(df: DataFrame, tokenizer_path: str, limit: int = 512, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are each counted; null ids pass
    through; other columns are not read; an empty table gives no rows. One narrow pass without a shuffle; a worker holds one Arrow
    batch and one chunk's encoding.
    """

    cut = splittable(tokenizer_path)

    def run(batches):
        tok = load(tokenizer_path)
        memo = PieceCounts(tok)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n_tok = np.zeros(len(texts), np.int64)
            if not cut:
                n_tok[:] = [len(tok.encode(t, add_special_tokens=False)) for t in texts]
            small = [i for i, t in enumerate(texts) if cut and len(t) <= chunk_chars]
            for at in range(0, len(small), 128):
                part = small[at : at + 128]
                n_tok[part] = memo.counts([texts[i] for i in part])
            for i, t in enumerate(texts):
                if cut and len(t) > chunk_chars:
                    n_tok[i] = sum(map(len, encode_spliced(tok, t, chunk_chars, overlap_chars)))
            n_bytes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tok), pa.array(n_tok > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
