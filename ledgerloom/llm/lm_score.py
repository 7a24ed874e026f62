"""Language-model scores from a log-frequency Bloom filter.

Counts of single tokens and pairs are quantised, level q = 1 + floor(log_BASE c), and a filter holds
(n-gram, 1) ... (n-gram, q). A count is read by probing levels upwards until one is missing, and
probabilities are smoothed at run time from such reads:

    P(w | v) = (c(v w) + MU * P(w)) / (c(v) + MU),    P(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))

Counting: tasks pre-aggregate their tokens and pairs in chunks and send one packed block a chunk and
shard, so a very frequent token is one entry a chunk; a shard (a range of hashes) sums its blocks, runs in
hash order, and builds its own part of the filter. Shards are counted from the bytes of the training
texts, ``SHARD_BYTES`` each, and a task works through its shards one at a time, so neither what a task
holds nor what it reads grows with the corpus. A part is sized by its keys: ``BITS_PER_KEY`` bits a key at every size of the
corpus, so the false-positive rate, which ``filter_stats`` reports, stays the same. Parts are collected
and broadcast while they are at most ``MOST_FILTER_BYTES`` and the counted vocabulary, whose exact counts
the base score needs, at most ``MOST_WORDS``. A larger model stays where it is: documents are dealt once into
chunks of ``CHUNK_BYTES``, a chunk asks each shard for the levels and counts of its distinct n-grams, and is
scored with the answers. Texts are dealt once however large the model is, so the work grows with them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, WordHashes, doc_bucket, keyed_runs, mix, partitions_for, shared_checkpoint, slices, words

BASE, MU = 1.5, 200.0
BITS_PER_KEY, PROBES = 12, 8
MOST_FILTER_BYTES = 192 << 20
MOST_SHARD_BITS = 2**32 - 64
MOST_WORDS = 8_000_000
CHUNK_TOKENS = 2_000_000
#: N-grams probed at once, few enough for their arrays to stay in the processor's cache.
AT_ONCE = 32768
#: Text of a chunk that asks the shards at once.
CHUNK_BYTES = 12 << 20
#: Training text a shard stands for, and shards a task works through.
SHARD_BYTES, SHARDS_A_TASK = 24 << 20, 4
END = np.uint64(xxhash.xxh64_intdigest(b"\n end of text"))  # no token holds a blank
START = np.uint64(xxhash.xxh64_intdigest(b"\n start of text"))
#: Boundaries of the levels, for counts up to 2**62.
_EDGES = BASE ** np.arange(1, 108)
#: What a level stands for: the middle of its counts.
VALUE = np.concatenate([[0.0, 1.0], (_EDGES[:-1] + _EDGES[1:]) / 2])


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.searchsorted(_EDGES, counts, "right")


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(left) + right * GOLDEN)


def token_arrays(memo: WordHashes, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, those before them, and the number of tokens of each text (its end included)."""
    lists = [words(t) for t in texts]
    n = np.array([len(x) + 1 for x in lists], np.int64)
    flat = np.empty(n.sum(), np.uint64)
    ends = np.cumsum(n)
    for x, stop in zip(lists, ends):
        flat[stop - 1 - len(x) : stop - 1] = memo.of(x)
    flat[ends - 1] = END
    before = np.roll(flat, 1)
    before[ends - n] = START
    return flat, before, n


# ---- counting -------------------------------------------------------------------------------------


def _pack(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    one = counts == 1
    return b"".join([np.array([one.sum(), (~one).sum()], np.int64).tobytes(), hashes[one].tobytes(), hashes[~one].tobytes(), counts[~one].astype(np.int64).tobytes()])


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.frombuffer(data, np.int64, 2)
    hashes = np.frombuffer(data, np.uint64, a + b, 16)
    return hashes, np.concatenate([np.ones(a, np.int64), np.frombuffer(data, np.int64, b, 16 + 8 * (a + b))])


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts


def count_blocks(texts: DataFrame, shards: int) -> DataFrame:
    """(shard, kind, data): packed partial counts; kind 0 tokens, 1 pairs."""

    def run(batches):
        memo, held, n = WordHashes(), ([], []), 0

        def flush():
            for kind in (0, 1):
                hashes, counts = _summed(h := np.concatenate(held[kind]), np.ones(len(h), np.int64))
                cuts = np.searchsorted(shard_of(hashes, shards), np.arange(shards + 1))  # hashes are sorted, so shards are too
                some = [s for s in range(shards) if cuts[s + 1] > cuts[s]]
                data = [_pack(hashes[cuts[s] : cuts[s + 1]], counts[cuts[s] : cuts[s + 1]]) for s in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([kind] * len(some), pa.int32()), pa.array(data, pa.binary())], names=["shard", "kind", "data"])
                held[kind].clear()

        for batch in batches:
            column = batch.column(0).to_pylist()
            for a, b in slices([], (len(t or "") for t in column), 1_000_000):
                flat, before, _ = token_arrays(memo, column[a:b])
                held[0].append(flat)
                held[1].append(pair_hashes(before, flat))
                n += len(flat)
                if n >= CHUNK_TOKENS:
                    yield from flush()
                    n = 0
        if n:
            yield from flush()

    return texts.select("text").mapInArrow(run, "shard int, kind int, data binary")


def _places(hashes: np.ndarray, level: np.ndarray | int, size: np.ndarray | int):
    """Bit numbers of each probe of (n-gram, level) in a filter of ``size`` bits (below 2**32)."""
    with np.errstate(over="ignore"):
        g = mix(hashes + np.asarray(level, np.uint64) * GOLDEN)
        step = (g << np.uint64(32) | g >> np.uint64(32)) | np.uint64(1)
        size = np.asarray(size, np.uint64)
        for _ in range(PROBES):
            yield (g >> np.uint64(32)) * size >> np.uint64(32)
            g = g + step


def build_filter(hashes: np.ndarray, counts: np.ndarray, most_bits: int) -> tuple[np.ndarray, int]:
    """The bits (as bytes) for these n-grams, and the number of keys in them; fewer bits a key above ``most_bits``."""
    q = levels(counts)
    keys = int(q.sum())
    size = min(max(64, (BITS_PER_KEY * keys + 63) // 64 * 64), most_bits, 2**32 - 64)
    bits = np.zeros(size // 8, np.uint8)
    for level in range(1, int(q.max(initial=0)) + 1):
        part = hashes[q >= level]
        for at in range(0, len(part), 500_000):
            for place in _places(part[at : at + 500_000], level, size):
                flags = np.zeros(size, bool) if len(place) > size // 64 else None
                if flags is not None:
                    flags[place] = True
                    bits |= np.packbits(flags, bitorder="little")
                else:
                    np.bitwise_or.at(bits, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
    return bits, keys


def plan_shards(texts: DataFrame, partitions: int, shard_bytes: int = SHARD_BYTES) -> tuple[int, int]:
    """(shards, tasks) for these training texts."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(partitions, -(-size // shard_bytes))
    return shards, max(partitions, -(-shards // SHARDS_A_TASK))


def build_shards(blocks: DataFrame, shards: int, tasks: int) -> DataFrame:
    """One row a shard: its vocabulary (packed), token sum, and its part of the filter."""

    def run(batches):
        for t in keyed_runs(batches, "shard", 1):
            shard, kinds, data = t.column("shard").to_numpy(), t.column("kind").to_numpy(), t.column("data").to_pylist()
            for s in np.unique(shard):
                parts = []
                for kind in (0, 1):
                    got = [_unpack(d) for d, x, k in zip(data, shard, kinds) if x == s and k == kind]
                    parts.append(_summed(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                (uni, n_uni), (pair, n_pair) = parts
                bits, keys = build_filter(np.concatenate([uni, pair]), np.concatenate([n_uni, n_pair]), MOST_SHARD_BITS)
                if BITS_PER_KEY * keys > MOST_SHARD_BITS:
                    raise ValueError(f"{keys} keys in one of {shards} shards: lower SHARD_BYTES")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(s)], pa.int32()), pa.array([len(uni)], pa.int64()), pa.array([int(n_uni.sum())], pa.int64()), pa.array([keys], pa.int64()), pa.array([_pack(uni, n_uni)], pa.binary()), pa.array([bits.tobytes()], pa.binary())],
                    names=["shard", "n_words", "n_tokens", "n_keys", "words", "bits"],
                )

    sorted_ = blocks.repartitionById(tasks, F.floor(F.col("shard").cast("long") * tasks / shards).cast("int")).sortWithinPartitions("shard")
    return shared_checkpoint(sorted_.mapInArrow(run, "shard int, n_words long, n_tokens long, n_keys long, words binary, bits binary"))


# ---- the model ------------------------------------------------------------------------------------


class LogBloom:
    """The filter, or some of its shards: parts one after another; n-grams of other shards read as level 0."""

    def __init__(self, parts: list[tuple[int, bytes]], shards: int, n_tokens: int, n_words: int) -> None:
        self.shards, self.n, self.v = shards, n_tokens, n_words
        sizes = np.zeros(shards, np.int64)
        for s, b in parts:
            sizes[s] = len(b)
        self.begin, self.size = (np.cumsum(sizes) - sizes).astype(np.uint64), (sizes * 8).astype(np.uint64)
        self.bits = np.zeros(int(sizes.sum()), np.uint8)
        for s, b in parts:
            self.bits[int(self.begin[s]) : int(self.begin[s]) + len(b)] = np.frombuffer(b, np.uint8)

    def level(self, hashes: np.ndarray) -> np.ndarray:
        """The highest level below which no probe fails."""
        out = np.zeros(len(hashes), np.int64)
        if not len(self.bits):
            return out
        shard = shard_of(hashes, self.shards)
        live = np.flatnonzero(self.size[shard] > 0)
        level = 1
        while len(live) and level < len(VALUE):
            parts = (live[i : i + AT_ONCE] for i in range(0, len(live), AT_ONCE))
            live = np.concatenate([x[self.holds(hashes[x], level, self.begin[shard[x]], self.size[shard[x]])] for x in parts])
            out[live] = level
            level += 1
        return out

    def holds(self, hashes: np.ndarray, level: int, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which of these n-grams have all their bits of this level; what misses one isn't probed again."""
        with np.errstate(over="ignore"):
            g = mix(hashes + np.uint64(level) * GOLDEN)
            step = (g << np.uint64(32) | g >> np.uint64(32)) | np.uint64(1)
            left = np.arange(len(g))
            for _ in range(PROBES):
                place = (g >> np.uint64(32)) * size >> np.uint64(32)
                hit = (self.bits[(begin + (place >> np.uint64(3))).view(np.int64)] >> (place.astype(np.uint8) & np.uint8(7)) & np.uint8(1)).view(bool)
                if not hit.all():
                    g, step, begin, size, left = g[hit], step[hit], begin[hit], size[hit], left[hit]
                g = g + step
        return left

    def levels_of(self, flat: np.ndarray, before: np.ndarray, tokens: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Levels of every token and of every pair, as two columns of bytes; ``tokens``: distinct ones and where each stands, if known."""
        distinct, back = tokens if tokens is not None else np.unique(flat, return_inverse=True)
        pairs, places = np.unique(pair_hashes(before, flat), return_inverse=True)
        return np.stack([self.level(distinct).astype(np.uint8)[back], self.level(pairs).astype(np.uint8)[places]], 1)

    def log10(self, found: np.ndarray, flat: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 P of every token given the one before it, from the levels of both."""
        own = VALUE[found[:, 0]]
        prior = (own + 0.5) / (self.n + 0.5 * (self.v + 1))
        context = np.roll(own, 1)
        context[before == START] = own[np.argmax(flat == END)]  # as many starts as ends
        both = np.minimum(VALUE[found[:, 1]], context)
        return np.log10((both + MU * np.minimum(prior, 1.0)) / (context + MU))


def groups_of(built: DataFrame, most_bytes: int) -> list[list[int]]:
    """Shards whose parts of the filter fit into so many bytes together (or one part); more than one group isn't broadcast."""
    out, held = [[]], 0
    for shard, size in built.select("shard", F.length("bits")).orderBy("shard").collect():
        if out[-1] and held + size > most_bytes:
            out.append([])
            held = 0
        out[-1].append(shard)
        held += size
    return out


class Vocabulary:
    """Exact counts by hash, for vocabularies of proven size."""

    def __init__(self, parts: list[bytes]) -> None:
        got = [_unpack(p) for p in parts]
        hashes = np.concatenate([np.zeros(0, np.uint64), *(g[0] for g in got)])
        counts = np.concatenate([np.zeros(0, np.int64), *(g[1] for g in got)])
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.counts = counts[order].astype(np.uint32 if counts.max(initial=0) < 2**32 else np.int64)

    def of(self, distinct: np.ndarray) -> np.ndarray:
        """Counts of ascending hashes."""
        if not len(self.hashes):
            return np.zeros(len(distinct), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, distinct), len(self.hashes) - 1)
        return np.where(self.hashes[at] == distinct, self.counts[at], 0).astype(np.int64)


def filter_stats(built: DataFrame) -> DataFrame:
    """Keys, bytes and the expected false-positive rate of one probe sequence, over all shards."""
    rate = F.pow(1 - F.exp(-PROBES * F.col("n_keys") / (8.0 * F.length("bits"))), F.lit(float(PROBES)))
    return built.agg(F.sum("n_keys").alias("keys"), F.sum(F.length("bits")).alias("bytes"), (F.sum(rate * F.col("n_keys")) / F.sum("n_keys")).alias("false_positive_rate"))


def score_documents(df: DataFrame, modulus: int = 5, held_out: int = 1, most_words: int = MOST_WORDS, most_filter_bytes: int = MOST_FILTER_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Trained on the rows outside the held-out remainder (rows of null doc_id train). A null text counts as
    empty: its end is its only token. Repeated rows train and are scored each; very long texts count whole, a slice
    at a time; columns other than doc_id and text are not read. An empty table gives no
    rows; a table without training rows has N = V = 0 and all its scores 0.
    """
    docs = df.select("doc_id", "text")
    out_of = F.coalesce(doc_bucket(F.col("doc_id"), modulus) == held_out, F.lit(False))
    training = docs.where(~out_of)
    shards, tasks = plan_shards(training, partitions_for(df), shard_bytes)
    built = build_shards(count_blocks(training, shards), shards, tasks)
    totals = built.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    v, n = int(totals[0]), int(totals[1])
    kind = df.schema["doc_id"].dataType.simpleString()
    result = ["doc_id", out_of.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"]
    if v > most_words or len(groups_of(built, most_filter_bytes)) > 1:
        return _asked(docs, built, shards, n, v, kind).select(*result)
    bloom = LogBloom([(r.shard, bytes(r.bits)) for r in built.select("shard", "bits").toLocalIterator()], shards, n, v)
    exact = Vocabulary([bytes(r.words) for r in built.select("words").toLocalIterator()])
    shared = df.sparkSession.sparkContext.broadcast((bloom, exact))
    del bloom, exact

    def run(batches):
        model, vocabulary = shared.value
        memo = WordHashes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices([], (len(t or "") for t in texts), 1_000_000):
                flat, before, size = token_arrays(memo, texts[a:b])
                tokens = np.unique(flat, return_inverse=True)
                found = model.levels_of(flat, before, tokens)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *_scores(model, flat, before, size, found, vocabulary.of(tokens[0]), tokens[1])], names=["doc_id", *SCORES])

    return docs.mapInArrow(run, f"doc_id {kind}, {SCORES_SCHEMA}").select(*result)


SCORES = ["n_tokens", "n_known", "base_score", "score"]
SCORES_SCHEMA = "n_tokens long, n_known long, base_score double, score double"


def _scores(model: LogBloom, flat: np.ndarray, before: np.ndarray, size: np.ndarray, found: np.ndarray, counts: np.ndarray, back: np.ndarray) -> list[pa.Array]:
    """``SCORES`` of consecutive texts: levels of every token and pair, exact counts of distinct tokens and where each stands."""
    starts = np.cumsum(size) - size
    known, base = (counts > 0).astype(np.int64)[back], np.log10((counts + 0.5) / (model.n + 0.5 * (model.v + 1)))[back]
    return [pa.array(size), pa.array(np.add.reduceat(known, starts)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(model.log10(found, flat, before), starts))]


def _chunk_arrays(texts: list[str]):
    """A chunk's distinct tokens and pairs, ascending, and its texts in slices: rows, tokens, those before, sizes, and places among the distinct."""
    memo, held = WordHashes(), []
    for a, b in slices([], (len(t or "") for t in texts), 1_000_000):
        flat, before, size = token_arrays(memo, texts[a:b])
        held.append((a, b, flat, before, size, np.unique(flat, return_inverse=True), np.unique(pair_hashes(before, flat), return_inverse=True)))
    distinct = [np.unique(np.concatenate([h[i][0] for h in held])) for i in (5, 6)]
    return distinct, held


def _asked(docs: DataFrame, built: DataFrame, shards: int, n: int, v: int, kind: str) -> DataFrame:
    """(doc_id, SCORES) of every row, with levels and counts asked of the shards.

    Documents are dealt to chunks by id and text; that exchange is read twice, by the chunks that ask and by
    those that score. A question is a chunk's distinct hashes of one shard, tokens before pairs, both
    ascending: a frequent n-gram is asked for once a chunk. Shards are ranges of hashes, so answers put
    together by shard stand as the distinct hashes do.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(partitions_for(docs), -(-size // CHUNK_BYTES))
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk")
    dealt = docs.select(chunk, "doc_id", "text").repartition(max(partitions_for(docs), -(-chunks // SHARDS_A_TASK)), "chunk")

    def ask(key, table):
        (tokens, pairs), _ = _chunk_arrays(table.column("text").to_pylist())
        cuts = [np.searchsorted(shard_of(x, shards), np.arange(shards + 1)) for x in (tokens, pairs)]
        some = np.flatnonzero((np.diff(cuts[0]) > 0) | (np.diff(cuts[1]) > 0))
        part = lambda i, x, s: x[cuts[i][s] : cuts[i][s + 1]]
        data = [part(0, tokens, s).tobytes() + part(1, pairs, s).tobytes() for s in some]
        return pa.table({"shard": pa.array(some, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(some), pa.int64()), "n": pa.array(np.diff(cuts[0])[some], pa.int32()), "hashes": pa.array(data, pa.binary())})

    def answer(key, parts, asked):
        s = key[0].as_py()
        model = LogBloom([(s, b) for b in parts.column("bits").to_pylist()], shards, 0, 0)
        words = Vocabulary(parts.column("words").to_pylist())
        found, counts = [], []
        for first, data in zip(asked.column("n").to_pylist(), asked.column("hashes").to_pylist()):
            hashes = np.frombuffer(data, np.uint64)
            found.append(model.level(hashes).astype(np.uint8).tobytes())
            counts.append(words.of(hashes[:first]).tobytes())
        return pa.table({"chunk": asked.column("chunk"), "shard": asked.column("shard"), "levels": pa.array(found, pa.binary()), "counts": pa.array(counts, pa.binary())})

    def score(_, table, answers):
        (tokens, pairs), held = _chunk_arrays(table.column("text").to_pylist())
        answers = answers.sort_by("shard")
        counts = [np.frombuffer(c, np.int64) for c in answers.column("counts").to_pylist()]
        found = [np.frombuffer(f, np.uint8) for f in answers.column("levels").to_pylist()]
        of_tokens = np.concatenate([f[: len(c)] for f, c in zip(found, counts)])
        of_pairs = np.concatenate([f[len(c) :] for f, c in zip(found, counts)])
        counts = np.concatenate(counts)
        model, out = LogBloom([], shards, n, v), []
        for a, b, flat, before, size, own, both in held:
            at, pair_at = np.searchsorted(tokens, own[0]), np.searchsorted(pairs, both[0])
            levels_ = np.stack([of_tokens[at][own[1]], of_pairs[pair_at][both[1]]], 1)
            ids = table.column("doc_id").slice(a, b - a).combine_chunks()
            out.append(pa.Table.from_arrays([ids, *_scores(model, flat, before, size, levels_, counts[at], own[1])], names=["doc_id", *SCORES]))
        return pa.concat_tables(out)

    asked = dealt.groupBy("chunk").applyInArrow(ask, "shard int, chunk long, n int, hashes binary")
    model = built.select("shard", "words", "bits")
    answers = model.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(answer, "chunk long, shard int, levels binary, counts binary")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, f"doc_id {kind}, {SCORES_SCHEMA}")
