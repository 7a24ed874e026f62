"""Cross-tokenizer alignment by relational steps over the distinct pieces of all texts.

1. A text, with a space before it, is cut where both tokenizers provably begin a new token (``Cutter``).
   Numbers of pieces stand for the text; each distinct piece of a block of documents is listed once, and
   each distinct piece of the corpus is encoded once. This is the aggregation before the shuffle: rows of
   all token occurrences would be some fifty times the input.
2. ``align_pieces`` is DataFrame work alone, with a piece in the part of a document: token ids are
   posexploded, their byte lengths summed by a window into ends, both sides joined on (piece, end). Where
   both end there is a cut; the running count of cuts (from the end) is the group's number. Every distinct end is the end
   of exactly one overlap of an A and a B token, so each joined row is one link, and its two tokens are
   the nearest on either side that end at or after it. No range join, and nothing quadratic in a group.
3. Documents get their pieces' results block by block; what a pair counts is the number of documents that
   hold it, and all sums over links are sums over pieces.

Only a block's pieces and numbers pass through one task, ``BLOCK_CHARS`` of text or one document.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import re
import uuid
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, keyed_runs, partitions_for, remove
from .token_count import _VOUCHED, byte_chars

BLOCK_CHARS = 32_000_000
#: Distinct (A id, B id) pairs up to which their counts are broadcast; more are joined by shuffle.
MOST_BROADCAST_PAIRS = 2_000_000
MARKS = ",.;:!?)"
SPACE = "▁"
#: Fixed value: how byte-level BPE cuts a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Tokenizers:
    """Both libraries, with the bytes that each id stands for."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of_char = {c: b for b, c in byte_chars().items()}
        self.ranked = None
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(of_char[c] for c in entry) if all(c in of_char for c in entry) else entry.encode()
        model = json.loads(self.a.to_str())
        if self._ids_are_ranks(model):
            import tiktoken

            added = {t["id"] for t in model["added_tokens"]}
            ranks = {self.a_bytes[i]: i for i in entries.values() if i not in added}
            self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b_pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(SPACE, " ").encode() for p in self.b_pieces]

    @staticmethod
    def _ids_are_ranks(file: dict) -> bool:
        """Whether the file is plain byte-level BPE whose merges make one token each, in the order of the ids."""
        model = file["model"]
        plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and file["normalizer"] is None
        before = file["pre_tokenizer"] or {}
        if not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            return False
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        return all(x < y for x, y in zip(made, made[1:])) and len(made) + 256 == len(model["vocab"]) - sum(t["content"] in model["vocab"] for t in file["added_tokens"])

    def encode_a(self, pieces: list[str]) -> list[list[int]]:
        """A's ids. Pieces of ASCII and Latin letters go by the merge ranks, several times faster and the same ids; others to the library."""
        if self.ranked is None:
            return [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        rest = [i for i, p in enumerate(pieces) if not _VOUCHED.fullmatch(p)]
        out = list(map(self.ranked.encode_ordinary, pieces)) if not rest else [self.ranked.encode_ordinary(p) if _VOUCHED.fullmatch(p) else [] for p in pieces]
        for i, e in zip(rest, self.a.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of both sides, and whether both give a piece's bytes back.

        B puts a space before what it is given: it gets a piece without its leading space, and one that has
        none behind a line end, whose two tokens are then left out.
        """
        a = self.encode_a(pieces)
        b = self.b.encode([p[1:] if p[0] == " " else "\n" + p for p in pieces], num_threads=1)
        b = [ids if p[0] == " " else ids[2:] for p, ids in zip(pieces, b)]
        same = lambda ids, of, p: b"".join([of[i] for i in ids]) == p
        ok = [same(x, self.a_bytes, raw) and same(y, self.b_bytes, raw) for p, x, y in zip(pieces, a, b) for raw in (p.encode(),)]
        return a, b, ok


class Cutter:
    """Cuts (space + text) at boundaries of both tokenizers.

    A's pre-tokens never cross the place before a space that a non-blank follows, that between a letter or
    number and a mark, nor that behind a lone line end; cutting there leaves every run of blanks as the whole
    text has it. B merges neighbours only into its pieces, so no token crosses two characters that no
    piece holds side by side: checked here for the three kinds of cut, and a kind that fails isn't used.
    """

    def __init__(self, b_pieces: list[str]) -> None:
        plain = [p for p in b_pieces if not _BYTE.fullmatch(p)]
        if any("\n" in p for p in plain) or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in plain):
            raise ValueError("B's pieces cross spaces or line ends; texts can't be cut")
        marks = "".join(m for m in MARKS if not any(x.isalnum() and y == m for p in plain for x, y in zip(p, p[1:])))
        self.marks = frozenset(marks)
        self.within = re.compile(rf"(?<=[^\W_])(?=[{re.escape(marks)}])|(?<=\S\n)(?=\S)" if marks else r"(?<=\S\n)(?=\S)")
        self.blanks = re.compile(r" \s")
        self.words = re.compile(r"(?<=[^ ])(?= \S)")

    def odd(self, text: str) -> bool:
        """Whether blanks follow each other or stand at an end, so that not every space begins a word."""
        return text[0].isspace() or text[-1] == " " or self.blanks.search(text) is not None

    def outer(self, text: str) -> list[str]:
        """Words of (space + text), each without the space it begins with; ``text.split(" ")`` unless the text is ``odd``."""
        return [w[1:] for w in self.words.split(" " + text)]

    def inner(self, word: str) -> list[str]:
        """Pieces of (space + word)."""
        if word.isalpha():
            return [" " + word]
        if word[-1:] in self.marks and word[:-1].isalpha():
            return [" " + word[:-1], word[-1]]
        return self.within.split(" " + word)


_CUT_SCHEMA = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("nos", pa.list_(pa.int32())), ("no", pa.int32()), ("piece", pa.string())])


def _block_rows(cutter: Cutter, block: int, ids: list, texts: list[str]):
    """A block's documents with the numbers of their pieces, then its distinct pieces. Words are told apart by Arrow; Python sees each distinct one once."""
    odd = [bool(t) and cutter.odd(t) for t in texts]
    plain = pa.array([t for t, x in zip(texts, odd) if t and not x], pa.large_string())
    words = pc.split_pattern(plain, " ").cast(pa.large_list(pa.large_string()))
    if any(odd):
        words = pa.concat_arrays([words, pa.array([cutter.outer(t) for t, x in zip(texts, odd) if x], pa.large_list(pa.large_string()))])
    owners = [i for i, t, x in zip(ids, texts, odd) if t and not x] + [i for i, x in zip(ids, odd) if x] + [i for i, t in zip(ids, texts) if not t]
    ends = words.offsets.to_numpy()
    texts.clear()
    coded = words.flatten().dictionary_encode()
    del plain, words  # a block's memory is what bounds its size
    codes, counts, parts = coded.indices.to_numpy(), [np.zeros(0, np.int32)], [pa.array([], pa.large_string())]
    for at in range(0, len(coded.dictionary), 50_000):
        pieces = list(map(cutter.inner, coded.dictionary.slice(at, 50_000).to_pylist()))
        counts.append(np.fromiter(map(len, pieces), np.int32, len(pieces)))
        parts.append(pa.array(list(chain.from_iterable(pieces)), pa.large_string()))
    count = np.concatenate(counts)
    numbered = pa.concat_arrays(parts).dictionary_encode()
    del parts, coded
    number = numbered.indices.to_numpy()
    each = count[codes]
    nos = number[_expand((np.cumsum(count) - count)[codes], each)]
    edges = np.r_[0, np.cumsum(each)][ends]
    offsets = np.r_[edges, np.full(len(owners) - len(edges) + 1, edges[-1])].astype(np.int32)  # empty texts come last
    for at in range(0, len(owners), 5_000):
        part = owners[at : at + 5_000]
        n, cut = len(part), offsets[at : at + len(part) + 1]
        column = pa.ListArray.from_arrays(pa.array(cut - cut[0]), pa.array(nos[cut[0] : cut[-1]]))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(part, pa.int64()), column, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], schema=_CUT_SCHEMA)
    for at in range(0, len(numbered.dictionary), 100_000):
        part = numbered.dictionary.slice(at, 100_000).cast(pa.string())
        n = len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32())), pa.array(np.arange(at, at + n, dtype=np.int32)), part], schema=_CUT_SCHEMA)


def _cut(docs: DataFrame, b_path: str, block_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(block, doc_id, nos, no, piece): a row a document with the numbers of its pieces, and a row a distinct piece of its block."""

    def run(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=b_path)
        cutter = Cutter([sp.id_to_piece(i) for i in range(sp.get_piece_size())])
        block = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if texts and size + len(text or "") > block_chars:
                    yield from _block_rows(cutter, block, ids, texts)
                    ids, texts, size, block = [], [], 0, block + 1
                ids.append(i)
                texts.append(text or "")
                size += len(text or "") + 1
        if texts:
            yield from _block_rows(cutter, block, ids, texts)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "block long, doc_id long, nos array<int>, no int, piece string")


def encode_pieces(pieces: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(piece, a, b, ok) of a table of distinct pieces."""

    def run(batches):
        tok = Tokenizers(a_path, b_path)
        ints = pa.list_(pa.int32())
        for batch in batches:
            names = batch.column(0).to_pylist()
            for at in range(0, len(names), 2_000):
                part = names[at : at + 2_000]
                a, b, ok = tok.encode(part)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(a, ints), pa.array(b, ints), pa.array(ok)], names=["piece", "a", "b", "ok"])

    return pieces.mapInArrow(run, "piece string, a array<int>, b array<int>, ok boolean")


def _lengths(spark: SparkSession, of: list[bytes], name: str) -> DataFrame:
    """Byte length of each id of a vocabulary, which bounds the broadcast."""
    return F.broadcast(spark.createDataFrame(pd.DataFrame({name: np.arange(len(of), dtype=np.int32), "n": np.array([len(x) for x in of], np.int32)})))


def pair_type(b_size: int, a_size: int) -> str:
    """What holds a link's number, A id * (size of B) + B id."""
    return "int" if a_size * b_size < 2**31 else "long"


def align_pieces(encoded: DataFrame, a_lengths: DataFrame, b_lengths: DataFrame, b_size: int, kind: str = "long") -> DataFrame:
    """(pid, end, a, b, pair, group) of (pid, a, b): a row each link, by its end, those of a piece together and falling.

    ``a`` and ``b`` are set where a token of that side ends, ``pair`` is the link's number (``pair_type``), ``group`` counts the
    cuts from the text's end. Ends, joined ends and running values keep the exchange by ``pid`` if the
    session lets a join use it (``spark.sql.requireAllClusterKeysForCoPartition`` off).
    """

    def ends(ids: str, lengths: DataFrame) -> DataFrame:
        tokens = encoded.select("pid", F.posexplode(ids).alias("pos", ids)).join(lengths, ids)
        w = Window.partitionBy("pid").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return tokens.select("pid", F.sum("n").over(w).cast("int").alias("end"), ids)

    joined = ends("a", a_lengths).join(ends("b", b_lengths), ["pid", "end"], "full_outer")
    back = Window.partitionBy("pid").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = F.col("a").isNotNull() & F.col("b").isNotNull()
    link = (F.last("a", ignorenulls=True).over(back).cast("long") * b_size + F.last("b", ignorenulls=True).over(back)).cast(kind)
    rows = joined.select("pid", "end", "a", "b", link.alias("pair"), F.count(F.when(cut, True)).over(back).cast("int").alias("group"))
    return rows.sortWithinPartitions("pid", F.desc("end"))  # as the window left them


def describe_pieces(aligned: DataFrame, kind: str = "long") -> DataFrame:
    """(pid, n_a, n_b, n_groups, pairs, groups) of ``align_pieces``: counts, links in order, and the groups as text."""

    def run(batches):
        for table in keyed_runs(batches, "pid", 20_000):
            table = table.take(pa.array(np.arange(table.num_rows)[::-1]))  # ends rise
            pid, a, b, group = (table[c].to_numpy() for c in ("pid", "a", "b", "group"))
            has_a, has_b = np.asarray(table["a"].is_valid()), np.asarray(table["b"].is_valid())
            new = np.flatnonzero(np.r_[True, pid[1:] != pid[:-1]])
            opens = np.r_[True, (pid[1:] != pid[:-1]) | (group[1:] != group[:-1])]
            starts = np.flatnonzero(opens)
            ids = [[str(int(v)) for v in x[has]] for x, has in ((a, has_a), (b, has_b))]
            edges = [np.r_[0, np.cumsum(has)][np.r_[starts, len(pid)]].tolist() for has in (has_a, has_b)]
            parts = [f"{','.join(ids[0][i:j])}|{','.join(ids[1][k:m])}" for i, j, k, m in zip(edges[0], edges[0][1:], edges[1], edges[1][1:])]
            first = np.r_[np.cumsum(opens)[new] - 1, len(parts)]
            texts = [";".join(parts[i:j]) for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
            count = lambda has: pa.array(np.add.reduceat(has.astype(np.int64), new).astype(np.int32))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [pa.array(pid[new]), count(has_a), count(has_b), pa.array(np.diff(first).astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.r_[new, len(pid)].astype(np.int32)), pa.array(table["pair"].to_numpy())), pa.array(texts, pa.string())],
                names=["pid", "n_a", "n_b", "n_groups", "pairs", "groups"],
            )

    return aligned.mapInArrow(run, f"pid long, n_a int, n_b int, n_groups int, pairs array<{kind}>, groups string")


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without nulls."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + counts[i], one after the other."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(before - starts, counts)


def _by_no(table: pa.Table, name: str) -> np.ndarray:
    """A column of a block's pieces, in the order of their numbers."""
    out = np.zeros(table.num_rows, np.int64)
    out[table["no"].to_numpy()] = table[name].to_numpy()
    return out


def _usable(docs: pa.Table, pieces: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece numbers, offsets, and which documents have tokens: some pieces, all of them faithful."""
    nos, offsets = _flat(docs["nos"])
    size = np.diff(offsets)
    bad = np.zeros(docs.num_rows, np.int64)
    if pieces.num_rows:
        wrong = _by_no(pieces, "wrong")
        owner = np.repeat(np.arange(docs.num_rows), size)
        bad = np.bincount(owner, wrong[nos], docs.num_rows)
    return nos, offsets, (size > 0) & (bad == 0)


def _pairs_of_block(docs: pa.Table, pieces: pa.Table) -> pa.Table:
    """(pair, docs): in how many documents of a block each pair is linked."""
    found = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if pieces.num_rows:
        nos, offsets, fit = _usable(docs, pieces)
        order = np.argsort(pieces["no"].to_numpy())
        pairs, at = _flat(pieces["pairs"].take(pa.array(order)))
        local, names = pd.factorize(pairs.astype(np.int64))
        count, starts = np.diff(at), at[:-1].astype(np.int64)
        total = np.zeros(len(names), np.int64)
        which = np.flatnonzero(fit)
        size = np.diff(offsets)
        for lo in _steps(size[which], 1_000_000):
            mine = which[lo]
            held = nos[_expand(offsets[mine].astype(np.int64), size[mine].astype(np.int64))]
            owner = np.repeat(np.arange(len(mine), dtype=np.int64), size[mine])
            once = pd.unique(owner * pieces.num_rows + held)
            owner, held = np.divmod(once, pieces.num_rows)
            linked = local[_expand(starts[held], count[held].astype(np.int64))]
            keys = pd.unique(np.repeat(owner, count[held]) * max(1, len(names)) + linked)
            total += np.bincount(keys % max(1, len(names)), minlength=len(names))
        some = total > 0
        found = names[some], total[some]
    return pa.table({"pair": pa.array(found[0]), "docs": pa.array(found[1])})


def _steps(sizes: np.ndarray, most: int):
    """Slices of rows whose sizes add up to about ``most`` (one row at least)."""
    if len(sizes):
        part = np.cumsum(sizes) // most
        edges = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *edges], [*edges, len(sizes)]):
            yield slice(int(a), int(b))


SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _documents_of_block(docs: pa.Table, pieces: pa.Table, digest: bool) -> pa.Table:
    """A block's documents with the sums and the groups of their pieces (or the SHA-256 of the groups, '' if there are none)."""
    nos, offsets, fit = _usable(docs, pieces)
    out = {"doc_id": docs["doc_id"].combine_chunks()}
    held = {name: _by_no(pieces, name) for name in ("ab", "gl", "n_best", "count_sum")}
    low = np.int64(2**32 - 1)
    counts = {"n_a": held["ab"] >> 32, "n_b": held["ab"] & low, "n_groups": held["gl"] >> 32, "n_links": held["gl"] & low, **held}
    for name in SUMS:
        of = counts[name]
        running = np.concatenate([[0], np.cumsum(of[nos])]) if len(nos) else np.zeros(1, np.int64)
        out[name] = pa.array(np.where(fit, running[offsets[1:]] - running[offsets[:-1]], 0))
    order = np.empty(pieces.num_rows, np.int64)
    order[pieces["no"].to_numpy()] = np.arange(pieces.num_rows)
    texts = pieces["groups"].combine_chunks().cast(pa.large_binary())
    joined = []
    for rows in _steps(np.diff(offsets), 500_000):  # a block's texts are several times its numbers
        edges = offsets[rows.start : rows.stop + 1].astype(np.int64)
        listed = pa.LargeListArray.from_arrays(pa.array(edges - edges[0]), texts.take(pa.array(order[nos[edges[0] : edges[-1]]])))
        whole = pc.if_else(pa.array(fit[rows]), pc.binary_join(listed, pa.scalar(b";", pa.large_binary())), pa.scalar(b"", pa.large_binary()))
        joined.append(pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in whole.to_pylist()], pa.string()) if digest else whole.cast(pa.large_string()).cast(pa.string()))
    out["groups_sha256" if digest else "groups"] = pa.chunked_array(joined, pa.string())
    return pa.table(out)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A session setting for the time of a block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def align(df: DataFrame, a_path: str, b_path: str, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups): each row's text under both tokenizers.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``; with ``digest`` its SHA-256 stands in its place as ``groups_sha256``. A pair's count is the number of rows whose text holds it linked;
    ``n_best`` are links whose count is the highest of their A id, ``count_sum`` is over links. Texts that are
    null, empty, or that a tokenizer doesn't give back have no tokens: zeros and ''. Repeated rows are
    documents of their own, ids may be null; very long texts are a block of their own. An empty table gives
    no rows. Other columns are not read. Works through tables in the cluster's shared folder; those that
    the result reads stay.
    """
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/align-{uuid.uuid4().hex}"

    def kept(x: DataFrame, name: str) -> DataFrame:
        with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):  # a written table needs its shuffles no more
            x.write.option("compression", "zstd").parquet(f"{base}/{name}")
        return spark.read.schema(x.schema).parquet(f"{base}/{name}")

    cut = kept(_cut(df, b_path, block_chars, id_col, text_col), "cut")
    docs = cut.where("no is null").select("block", "doc_id", "nos")
    listed = spark.read.schema(cut.schema).parquet(f"{base}/cut").where("no is not null").select("block", "no", "piece")
    n = partitions_for(df)
    encoded = kept(encode_pieces(listed.select("piece").distinct(), a_path, b_path).withColumn("pid", F.monotonically_increasing_id()), "encoded")
    tok = Tokenizers(a_path, b_path)
    b_size, kind = len(tok.b_bytes), pair_type(len(tok.b_bytes), len(tok.a_bytes))
    with setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):  # the join on (pid, end) may use the exchange by pid
        dealt = encoded.where("ok").select("pid", "a", "b").repartition(n, "pid")
        rows = align_pieces(dealt, _lengths(spark, tok.a_bytes, "a"), _lengths(spark, tok.b_bytes, "b"), b_size, kind)
        aligned = kept(describe_pieces(rows, kind), "aligned")
    results = kept(encoded.select("pid", "piece", "ok").join(aligned, "pid", "left").select("piece", (~F.col("ok")).cast("int").alias("wrong"), "n_a", "n_b", "n_groups", F.coalesce("pairs", F.array().cast(f"array<{kind}>")).alias("pairs"), "groups"), "results")
    for name in ("encoded", "aligned"):
        remove(spark, f"{base}/{name}")

    held = listed.join(results.select("piece", "wrong", "pairs"), "piece").select("block", "no", "wrong", "pairs")
    pairs = docs.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(_pairs_of_block, "pair long, docs long")
    pairs = kept(pairs.groupBy("pair").agg(F.sum("docs").alias("docs")), "pairs")
    of_a = F.floor(F.col("pair") / b_size)
    best = pairs.groupBy(of_a.alias("a")).agg(F.max("docs").alias("best"))
    counts = pairs.withColumn("a", of_a).join(F.broadcast(best), "a").select("pair", "docs", (F.col("docs") == F.col("best")).cast("int").alias("is_best"))  # a row an A id: bounded by its vocabulary
    if pairs.count() <= MOST_BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    scored = results.select("piece", F.explode(F.col("pairs").cast("array<bigint>")).alias("pair")).join(counts, "pair").groupBy("piece").agg(F.sum("docs").alias("count_sum"), F.sum("is_best").alias("n_best"))
    whole = results.withColumn("n_links", F.size("pairs")).drop("pairs").join(scored, "piece", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    two = lambda a, b: F.shiftleft(number(a), 32).bitwiseOR(number(b))  # noqa: E731  two counts of a piece in a long: the widest exchange is of these rows
    ready = listed.join(whole, "piece").select("block", "no", "wrong", two("n_a", "n_b").alias("ab"), two("n_groups", "n_links").alias("gl"), number("n_best").cast("int").alias("n_best"), number("count_sum").alias("count_sum"), F.coalesce("groups", F.lit("")).alias("groups"))
    ready = kept(ready, "ready")  # its joins' shuffles are gone before the widest exchange
    for name in ("results", "pairs"):
        remove(spark, f"{base}/{name}")
    last = "groups_sha256 string" if digest else "groups string"

    def documents(left: pa.Table, right: pa.Table) -> pa.Table:
        return _documents_of_block(left, right, digest)

    return docs.groupBy("block").cogroup(ready.groupBy("block")).applyInArrow(documents, "doc_id long, " + ", ".join(f"{c} long" for c in SUMS) + f", {last}")
