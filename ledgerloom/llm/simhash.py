"""SimHash near-duplicates by a binary-trie self-join.

Every text gets a signature of one or more 64-bit words; a bit is set where more than half of its
shingle hashes set it. Distinct signatures are the nodes of the join. A *view* names key bits, which
must agree exactly, and walk bits, over which a binary trie is built and joined with itself: pairs of
trie nodes descend together, each level adds the differing bit to the pair's error, and a pair whose
error passes the budget is pruned with everything below it. Pairs that reach small nodes are checked
on whole signatures.

Views are chosen so that no pair within the budget is missed: the bits are cut into one more block
than the budget allows errors, hence one block agrees (``exact_views`` does this twice, which leaves
groups that share 35 of 64 bits). Rows of one view and key meet in one task; only edges of a spanning
forest leave it, so a dense group of copies costs no quadratic output. Inside a task, neighbours in
trie order and each large group's centre are linked first, and node pairs whose members are all in
one component already aren't walked any more: the components stay the same, the work near linear.

The corpus stage takes what this search links only as candidates: ``verified_components`` splits each
candidate group by the exact Jaccard similarity of its members' shingle sets.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, keyed_runs, mix, shared_checkpoint, slices, thrifty, words
from .components import connected_components

SEED = 42
KEY_BITS = 40


@dataclass(frozen=True)
class View:
    key: tuple[int, ...]
    walk: tuple[int, ...]


def cut(bits: list[int], parts: int) -> list[list[int]]:
    size, more = divmod(len(bits), parts)
    out, at = [], 0
    for i in range(parts):
        n = size + (i < more)
        out.append(bits[at : at + n])
        at += n
    return out


def exact_views(bits: int = 64, budget: int = 2) -> list[View]:
    """Two rounds of the pigeonhole principle: complete for every pair within ``budget``."""
    out = []
    for block in cut(list(range(bits)), budget + 1):
        rest = [b for b in range(bits) if b not in block]
        for inner in cut(rest, budget + 1):
            out.append(View((*block, *inner), tuple(b for b in rest if b not in inner)))
    return out


def sampled_views(bits: int, tables: int, table_bits: int, budget: int, seed: int = 7) -> list[View]:
    """``tables`` random subsets of the bits, each searched completely within ``budget`` errors."""
    rng, out = random.Random(seed), []
    for _ in range(tables):
        chosen = rng.sample(range(bits), table_bits)
        for block in cut(chosen, budget + 1):
            out.append(View(tuple(block), tuple(b for b in chosen if b not in block)))
    return out


def shingles(tokens: list[bytes], size: int) -> list[bytes]:
    """Space-joined runs of ``size`` words, repeats included; fewer words: the whole sequence."""
    if len(tokens) < size:
        return [b" ".join(tokens)] if tokens else []
    return list(map(b" ".join, zip(*(tokens[i:] for i in range(size)))))


def signatures(texts: list[str | None], size: int, n_words: int = 1) -> np.ndarray:
    """One row of ``n_words`` unsigned words a text; no words: all zero. Word 0 uses XXH64 (seed 42) as it is, the others mix it."""
    lists = [shingles(words(t), size) for t in texts]
    count = np.array([len(x) for x in lists], np.int64)
    return majorities(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for x in lists for s in x), np.uint64, int(count.sum())), count, n_words)


def majorities(h: np.ndarray, count: np.ndarray, n_words: int) -> np.ndarray:
    """Signatures of texts that have ``count`` of the shingle hashes each."""
    out = np.zeros((len(count), n_words), np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    starts = (np.cumsum(count) - count)[full]
    for w in range(n_words):
        with np.errstate(over="ignore"):
            g = h if not w else mix(h + np.uint64(w) * GOLDEN)
        bits = np.unpackbits(g.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full, w] = np.packbits(2 * ones > count[full, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprint_rows(df: DataFrame, size: int, n_words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, s0, s1, ...) of every row, the signature's words as signed longs."""
    names = [f"s{i}" for i in range(n_words)]

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices([], (len(t or "") for t in texts), 1_500_000):
                sig = signatures(texts[a:b], size, n_words).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *(pa.array(sig[:, i]) for i in range(n_words))], names=[id_col, *names])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(thrifty(run), f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names))


def _pick(bits: np.ndarray, chosen: tuple[int, ...]) -> np.ndarray:
    code = np.zeros(len(bits), np.uint64)
    for b in chosen:
        code = (code << np.uint64(1)) | bits[:, b]
    return code


def _bits(sig: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(sig).view(np.uint8).reshape(len(sig), -1), axis=1, bitorder="little")


class _Forest:
    """Components of the rows seen in one task."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.parent[a], self.parent[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                return
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.parent[self.parent]
                if (up == self.parent).all():
                    break
                self.parent = up


class TrieJoin:
    """Self-join of one view's rows, sorted by (key, walk code); joins only within a key."""

    #: Node pairs of at most so many member pairs are checked directly; so many are checked at once.
    SMALL, AT_ONCE = 16, 1 << 18

    def __init__(self, key: np.ndarray, code: np.ndarray, width: int, sig: np.ndarray, local: np.ndarray, forest: _Forest, budget: int, accept: int) -> None:
        self.key, self.code, self.width, self.sig, self.local, self.forest, self.budget, self.accept = key, code, width, sig, local, forest, budget, accept

    def check(self, i: np.ndarray, j: np.ndarray) -> None:
        if not len(i):
            return
        apart = np.zeros(len(i), np.int64)
        for w in range(self.sig.shape[1]):
            apart += np.bitwise_count(self.sig[i, w] ^ self.sig[j, w])
        ok = apart <= self.accept
        self.forest.unite(self.local[i[ok]], self.local[j[ok]])

    def check_nodes(self, pairs: np.ndarray) -> None:
        """All member pairs of node pairs (a_from, a_to, b_from, b_to), in bounded portions."""
        at = 0
        size = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        while at < len(pairs):
            take = max(1, int(np.searchsorted(np.cumsum(size[at:]), self.AT_ONCE, "right")))
            part, n = pairs[at : at + take], size[at : at + take]
            at += take
            if take == 1 and n[0] > self.AT_ONCE:
                a, b = np.arange(part[0, 0], part[0, 1]), np.arange(part[0, 2], part[0, 3])
                step = max(1, self.AT_ONCE // len(b))
                for s in range(0, len(a), step):
                    rows = a[s : s + step]
                    lab = self.forest.parent[self.local]
                    i, j = np.repeat(rows, len(b)), np.tile(b, len(rows))
                    keep = (i < j) & (lab[i] != lab[j])
                    self.check(i[keep], j[keep])
                continue
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(part[:, 3] - part[:, 2], n)
            i = np.repeat(part[:, 0], n) + within // wide
            j = np.repeat(part[:, 2], n) + within % wide
            lab = self.forest.parent[self.local]
            keep = (i < j) & (lab[i] != lab[j])
            self.check(i[keep], j[keep])

    def seed(self, starts: np.ndarray, ends: np.ndarray) -> None:
        """Links of neighbours in trie order, and of large groups' most central member."""
        for step in (1, 2):
            i = np.flatnonzero(self.key[step:] == self.key[:-step])
            self.check(i, i + step)
        for a, b in zip(starts, ends):
            if b - a > 64:
                bits = _bits(self.sig[a:b])
                centre = bits.mean(0) > 0.5
                pivot = a + int(np.argmin((bits != centre).sum(1)))
                others = np.arange(a, b)
                self.check(np.full(b - a, pivot), others)

    def open_pairs(self, pairs: np.ndarray) -> np.ndarray:
        """Without those whose members are in one component by now."""
        lab = self.forest.parent[self.local]
        turns = np.concatenate([[0], np.cumsum(lab[1:] != lab[:-1])])
        a0, a1, b0, b1 = pairs[:, 0], pairs[:, 1], pairs[:, 2], pairs[:, 3]
        closed = (turns[a1 - 1] == turns[a0]) & (turns[b1 - 1] == turns[b0]) & (lab[a0] == lab[b0])
        return pairs[~closed]

    def run(self) -> None:
        starts = np.flatnonzero(np.concatenate([[True], self.key[1:] != self.key[:-1]]))
        ends = np.append(starts[1:], len(self.key))
        many = ends - starts > 1
        starts, ends = starts[many], ends[many]
        if not len(starts):
            return
        self.seed(starts, ends)
        first = np.stack([starts, ends, starts, ends, np.zeros(len(starts), np.int64)], 1)
        waiting = [(self.width - 1, first)]
        while waiting:
            bit, pairs = waiting.pop()
            if len(pairs) > self.AT_ONCE // 4 and len(pairs) > 1:  # depth first in portions: bounded memory
                half = len(pairs) // 2
                waiting += [(bit, pairs[half:]), (bit, pairs[:half])]
                continue
            pairs = self.open_pairs(pairs)
            size = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
            small = size <= self.SMALL if bit >= 0 else np.ones(len(pairs), bool)
            self.check_nodes(pairs[small])
            pairs = pairs[~small]
            if len(pairs):
                waiting.append((bit - 1, self.children(pairs, bit)))

    def children(self, pairs: np.ndarray, bit: int) -> np.ndarray:
        ones = np.concatenate([[0], np.cumsum((self.code >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)])
        a0, a1, b0, b1, err = pairs.T
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        apart = a0 != b0
        out = np.concatenate([
            np.stack([a0, am, b0, bm, err], 1),
            np.stack([am, a1, bm, b1, err], 1),
            np.stack([a0, am, bm, b1, err + 1], 1),
            np.stack([am, a1, b0, bm, err + 1], 1)[apart],
        ])
        keep = (out[:, 1] > out[:, 0]) & (out[:, 3] > out[:, 2]) & (out[:, 4] <= self.budget)
        keep &= (out[:, 0] != out[:, 2]) | (out[:, 1] - out[:, 0] > 1)
        return out[keep]


def join_rows(view_of: np.ndarray, key: np.ndarray, sig: np.ndarray, node: np.ndarray, views: list[View], budget: int, accept: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) over the rows of whole keys."""
    ids, local = np.unique(node, return_inverse=True)
    forest = _Forest(len(ids))
    for v in np.unique(view_of):
        rows = np.flatnonzero(view_of == v)
        code = _pick(_bits(sig[rows]), views[v].walk)
        order = np.lexsort((code, key[rows]))
        rows, code = rows[order], code[order]
        TrieJoin(key[rows], code, len(views[v].walk), sig[rows], local[rows], forest, budget, accept).run()
    loose = np.flatnonzero(forest.parent != np.arange(len(ids)))
    return ids[loose], ids[forest.parent[loose]]


def link_nodes(nodes: DataFrame, views: list[View], budget: int, accept: int) -> DataFrame:
    """Edges (u, v) whose components are those of all node pairs found within ``accept`` differing bits.

    ``nodes`` is (node, s0, s1, ...), one row a distinct signature.
    """
    names = [c for c in nodes.columns if c != "node"]

    def expand(batches):
        for batch in batches:
            sig = np.stack([batch.column(n).to_numpy() for n in names], 1).view(np.uint64)
            bits = _bits(sig)
            for i, v in enumerate(views):
                key = (np.int64(i) << KEY_BITS) | _pick(bits, v.key).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("node"), *(batch.column(n) for n in names)], names=["key", "node", *names])

    def walk(batches):
        for t in keyed_runs(batches, "key"):
            key = t.column("key").to_numpy()
            sig = np.stack([t.column(n).to_numpy() for n in names], 1).view(np.uint64)
            u, v = join_rows(key >> KEY_BITS, key, sig, t.column("node").to_numpy(), views, budget, accept)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    columns = ", ".join(f"{n} long" for n in names)
    rows = nodes.select("node", *names).mapInArrow(thrifty(expand), f"key long, node long, {columns}")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(thrifty(walk), "u long, v long")


def near_duplicate_components(df: DataFrame, size: int = 3, n_words: int = 1, views: Callable[[int], list[View]] | None = None, budget: int = 2, accept: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, s0.., component_id): the smallest id among all rows reachable through near-equal signatures.

    ``views`` makes the views to search from the number of distinct signatures; without it the search is
    complete for ``budget`` differing bits.

    Null and empty texts have no words: signature zero, linked like any other. Repeated ids and null
    ids keep their rows; a component's id is its smallest non-null id, null if it has none. Equal
    signatures are one node, so exact copies never multiply pairs; very long texts are signed whole. An empty table gives no rows; other
    columns are not read.
    """
    accept = budget if accept is None else accept
    rows = shared_checkpoint(fingerprint_rows(df, size, n_words, id_col, text_col))
    names = [f"s{i}" for i in range(n_words)]
    rows = rows.withColumn("node", F.col("s0") if n_words == 1 else F.xxhash64(*names))
    nodes = shared_checkpoint(rows.groupBy("node", *names).agg(F.min(id_col).alias("low")))
    chosen = views(nodes.count()) if views else exact_views(64 * n_words, budget)
    labels = connected_components(link_nodes(nodes.select("node", *names), chosen, budget, accept))
    own = nodes.join(labels, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    lowest = own.groupBy("root").agg(F.min("low").alias("component_id"))
    of_node = own.select("node", "root").join(lowest, "root").select("node", "component_id")
    return rows.join(of_node, "node", "left").select(id_col, *names, "component_id")


def simhash_components(df: DataFrame) -> DataFrame:
    """Three-word shingles, 64 bits, links at two or fewer differing bits; fingerprints in hex."""
    out = near_duplicate_components(df)
    return out.select("doc_id", F.lower(F.lpad(F.hex("s0"), 16, "0")).alias("fingerprint"), "component_id")


#: The corpus stage: five-word shingles, 256 bits, groups of texts whose shingle sets have a Jaccard
#: similarity of 0.8 or more. That means 8/9 of two equally large sets in common, an angle of
#: acos(8/9), 39 of 256 bits on average with a spread of 6. Signatures within 56 bits are candidates; a
#: pair at 44 bits is met in some table with a probability of RECALL, closer pairs with more; the bits
#: of a table grow with the number of signatures so that a signature meets some CHANCE unrelated ones a
#: table, and the number of tables follows. Only exact similarity links.
STAGE = {"size": 5, "n_words": 4, "budget": 2, "accept": 56}
RECALL, CHANCE = 0.99, 16.0
#: A candidate group of at most so many shingles is compared in one task, a larger one in pairs of chunks of that size.
CHUNK = 200_000


def plan_tables(nodes: int, bits: int = 256, budget: int = 2, accept: int = 44, recall: float = RECALL, chance: float = CHANCE) -> tuple[int, int]:
    """(tables, bits of a table) for so many signatures."""
    ball = lambda n: sum(math.comb(n, i) for i in range(budget + 1))
    width = next(n for n in range(24, 3 * KEY_BITS) if nodes * ball(n) / 2**n <= chance)
    p = accept / bits
    met = sum(math.comb(width, i) * p**i * (1 - p) ** (width - i) for i in range(budget + 1))
    return math.ceil(math.log(1 - recall) / math.log(1 - met)), width


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    return [np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in set(shingles(words(t), size))), np.uint64)) for t in texts]


def set_rows(df: DataFrame, size: int, n_words: int) -> DataFrame:
    """(doc_id, text_key, node, n, s0, ...) of every row: the hash, size and signature of its shingle set."""
    names = [f"s{i}" for i in range(n_words)]

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices([], (len(t or "") for t in texts), 1_500_000):
                sets = shingle_sets(texts[a:b], size)
                count = np.array([len(x) for x in sets], np.int64)
                sig = majorities(np.concatenate(sets), count, n_words).view(np.int64)
                node = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
                cols = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(node), pa.array(count), *(pa.array(sig[:, i]) for i in range(n_words))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_key", "node", "n", *names])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", text_key(), "text").mapInArrow(thrifty(run), f"doc_id {kind}, text_key long, node long, n long, " + ", ".join(f"{n} long" for n in names))


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def alike(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of ``a`` and ``b`` members with so many in common have a Jaccard similarity of 0.8 or more."""
    return (9 * shared >= 4 * (a + b)) & (shared > 0)


def link_sets(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component; rows of equal label are linked, and rows of side 0 to all sets alike."""
    n, size = len(sets), np.array([len(x) for x in sets], np.int64)
    forest = _Forest(n)
    _, first, back = np.unique(label, return_index=True, return_inverse=True)
    forest.unite(first[back], np.arange(n))
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    turns = np.concatenate([[True], flat[order][1:] != flat[order][:-1]])[: len(flat)]
    begin = np.flatnonzero(turns)
    times = np.diff(np.append(begin, len(flat)))
    rows = np.repeat(np.arange(n), size)[order]
    shingle = np.empty(len(flat), np.int64)
    shingle[order] = np.cumsum(turns) - 1
    stop = np.cumsum(size)
    for i in np.flatnonzero(side == 0):
        if (forest.parent == forest.parent[0]).all():
            break
        own = shingle[stop[i] - size[i] : stop[i]]
        own = own[times[own] > 1]
        many = times[own]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[own], many)
        hit = np.flatnonzero(alike(np.bincount(rows[at], minlength=n), size[i], size))
        forest.unite(np.full(len(hit), i), hit)
    return forest.parent


def link_groups(rows: DataFrame) -> DataFrame:
    """Edges (u, v) between sets alike within each group of (group, side, label, node, shingles)."""

    def run(batches):
        for t in keyed_runs(batches, "group", 1):
            group, node = t.column("group").to_numpy(), t.column("node").to_numpy()
            side, label, data = t.column("side").to_numpy(), t.column("label").to_numpy(), t.column("shingles").to_pylist()
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            for a, b in zip(starts, np.append(starts[1:], len(group))):
                low = a + link_sets([np.frombuffer(x, np.uint64) for x in data[a:b]], label[a:b], side[a:b])
                loose = np.flatnonzero(low != np.arange(a, b))
                if len(loose):
                    yield pa.RecordBatch.from_arrays([pa.array(node[a + loose]), pa.array(node[low[loose]])], names=["u", "v"])

    return rows.select("group", "side", "label", "node", "shingles").repartition("group").sortWithinPartitions("group").mapInArrow(thrifty(run), "u long, v long")


def pivot_labels(rows: DataFrame) -> DataFrame:
    """(root, node, n, label) of (root, node, n, shingles, pivot, pivot_shingles): the pivot if alike, else the node itself."""

    def run(batches):
        for batch in batches:
            node, pivot, n = (batch.column(c).to_numpy() for c in ("node", "pivot", "n"))
            pairs = zip(batch.column("shingles").to_pylist(), batch.column("pivot_shingles").to_pylist())
            sets = [(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in pairs]
            shared = np.array([len(np.intersect1d(a, b, True)) for a, b in sets], np.int64)
            ok = alike(shared, n, np.array([len(b) for _, b in sets], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("root"), batch.column("node"), batch.column("n"), pa.array(np.where(ok, pivot, node))], names=["root", "node", "n", "label"])

    return rows.mapInArrow(thrifty(run), "root long, node long, n long, label long")


def _small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Broadcast only when counted to be small."""
    return F.broadcast(df) if df.count() <= rows else df


def exact_links(sets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges (u, v) of ``exact_parts``, together."""
    one, rest = exact_parts(sets, chunk)
    return one if rest is None else one.unionByName(rest)


def few_components(edges: DataFrame, most: int = 200_000) -> DataFrame:
    """(node, root) as by ``connected_components``, in one task when counted to be at most ``most`` edges."""
    edges = shared_checkpoint(edges)
    if edges.count() > most:
        return connected_components(edges)

    def run(batches):
        t = pa.Table.from_batches(batches)
        u, v = t.column("u").to_numpy(), t.column("v").to_numpy()
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        forest = _Forest(len(ids))
        forest.unite(at[: len(u)], at[len(u) :])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[forest.parent])], names=["node", "root"])

    def some(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            yield from run(held)

    return edges.coalesce(1).mapInArrow(thrifty(some), "node long, root long")


def exact_parts(sets: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame | None]:
    """Edges (u, v) whose components are those of all pairs alike within each root of (root, node, n, copies, shingles).

    The first part is that of groups of at most ``chunk`` shingles, one task's each: v is the root of u. Of a larger one, members alike to its pivot (the
    text with most copies) get one label; a group of one label is settled, else its members are cut into
    chunks and every pair of chunks is compared, but for those of one and the same label.
    """
    comps = sets.groupBy("root").agg(F.sum(F.col("n") + 1).alias("weight"), F.max_by("node", F.struct("copies", "node")).alias("pivot"))
    big = shared_checkpoint(comps.where(F.col("weight") > chunk).select("root", "pivot"))
    one = sets.join(_small(big), "root", "left_anti").select(F.col("root").alias("group"), F.lit(0).alias("side"), F.col("node").alias("label"), "node", "shingles")
    if big.isEmpty():
        return link_groups(one), None
    some = sets.join(_small(big), "root")
    pivots = some.where("node = pivot").select("root", F.col("shingles").alias("pivot_shingles"))
    labels = shared_checkpoint(pivot_labels(some.join(_small(pivots, 64), "root").select("root", "node", "n", "shingles", "pivot", "pivot_shingles")))
    by_label = labels.groupBy("root", "label").agg(F.sum(F.col("n") + 1).alias("w"))
    alone = F.col("w") > chunk
    by_root = by_label.groupBy("root").agg(F.count("*").alias("labels"), F.sum(F.when(~alone, F.col("w"))).alias("rest")).where("labels > 1")
    parts = by_label.join(by_root, "root").withColumn("parts", F.ceil(F.when(alone, F.col("w")).otherwise(F.col("rest")) / chunk))
    parts = parts.select("root", "label", F.when(alone, F.col("label")).alias("pure"), "parts")
    same = (F.col("l.root") == F.col("p.root")) & (F.col("l.label") == F.col("p.label"))
    placed = labels.alias("l").join(_small(parts).alias("p"), same).select("l.root", "l.node", "l.label", "p.pure", "p.parts")
    place = F.pmod(F.xxhash64(F.when(F.col("pure").isNull(), F.col("label")).otherwise(F.col("node"))), F.col("parts"))
    placed = shared_checkpoint(placed.select("root", "node", "label", "pure", F.xxhash64("root", F.coalesce("pure", F.lit(0)), F.col("pure").isNull(), place).alias("chunk")))
    chunks = placed.select("root", "chunk", "pure").distinct()
    met = chunks.alias("a").join(chunks.alias("b"), (F.col("a.root") == F.col("b.root")) & (F.col("a.chunk") <= F.col("b.chunk")))
    met = met.where(~F.coalesce(F.col("a.pure") == F.col("b.pure"), F.lit(False))).select(F.xxhash64("a.chunk", "b.chunk").alias("group"), F.col("a.chunk").alias("c0"), F.col("b.chunk").alias("c1"))
    ends = F.when(F.col("c0") == F.col("c1"), F.array("c0")).otherwise(F.array("c0", "c1"))
    met = met.select("group", F.posexplode(ends).alias("side", "chunk"))
    wide = placed.select("node", "label", "chunk").join(_small(met), "chunk").join(sets.select("node", "shingles"), "node")
    stars = labels.where("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v"))
    return link_groups(one), link_groups(wide).unionByName(stars)


def verified_components(docs: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, text_key, node, ...) of every row, (node, first, copies, ...) of every node, and (node, root) of those alike to another.

    ``first`` is the node's smallest (doc_id is null, doc_id, text_key).

    A node is a distinct shingle set, so copies never multiply pairs. Nodes near in signature are
    candidates; components are those of pairs with an exact similarity of 0.8 or more within each
    candidate group, whether or not the search has met the pair itself.
    """
    size, n_words, budget, accept = (STAGE[k] for k in ("size", "n_words", "budget", "accept"))
    names = [f"s{i}" for i in range(n_words)]
    rows = shared_checkpoint(set_rows(docs, size, n_words))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    nodes = shared_checkpoint(rows.groupBy("node", *names).agg(first, F.count("*").alias("copies")))
    views = sampled_views(64 * n_words, *plan_tables(nodes.count()), budget)
    near = connected_components(link_nodes(nodes.select("node", *names), views, budget, accept))
    near = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct())
    wanted = shared_checkpoint(near.join(nodes, "node").select("root", "node", "copies", "first.doc_id", "first.text_key"))

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices([], (len(t or "") for t in texts), 1_500_000):
                sets = shingle_sets(texts[a:b], size)
                cols = [*(batch.column(c).slice(a, b - a) for c in ("root", "node", "copies")), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["root", "node", "copies", "n", "shingles"])

    same = F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("d.text_key") == F.col("x.text_key"))
    texts = docs.select("doc_id", text_key(), "text").alias("d").join(_small(wanted).alias("x"), same).select("x.root", "x.node", "x.copies", "d.text")
    sets = shared_checkpoint(texts.mapInArrow(thrifty(run), "root long, node long, copies long, n long, shingles binary").dropDuplicates(["node"]))
    one, rest = exact_parts(sets, chunk)
    labels = one.toDF("node", "root")
    return rows, nodes, shared_checkpoint(labels if rest is None else labels.unionByName(few_components(rest)))


def keep_one_per_group(docs: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """``docs`` with one row of each near-duplicate group; columns unchanged.

    The row of the smallest doc_id stays, nulls last, and of several texts of that id the one of the
    smallest hash. Decided by row, told apart by doc_id and text: other rows of the same or of null
    doc_id stay. Rows that repeat a kept id and text are reduced to one. What goes is broadcast only
    when counted to be at most ``broadcast_rows``; else both sides are shuffled.
    """
    rows, nodes, labels = verified_components(docs)
    own = nodes.join(labels, "node", "left").select("node", "first", "copies", F.coalesce("root", "node").alias("root"))
    groups = own.groupBy("root").agg(F.min("first").alias("keep"), F.sum("copies").alias("rows")).where("rows > 1")
    of_node = own.join(groups, "root").select("node", "keep")
    mine = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("text_key") == F.col("keep.text_key"))
    found = rows.join(_small(of_node, broadcast_rows), "node").select("doc_id", "text_key", mine.alias("mine"))
    found = shared_checkpoint(found.groupBy("doc_id", "text_key", "mine").agg(F.count("*").alias("n")))
    drop, again = found.where("not mine").select("doc_id", "text_key"), found.where("mine and n > 1").select("doc_id", "text_key")
    key = F.xxhash64(F.coalesce("d.text", F.lit("")))
    same = F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (key == F.col("x.text_key"))
    kept = docs.alias("d").join(_small(drop, broadcast_rows).alias("x"), same, "left_anti")
    if again.isEmpty():
        return kept
    again = _small(again, broadcast_rows)
    once = kept.alias("d").join(again.alias("x"), same, "left_semi").select(F.col("d.doc_id"), text_key(), F.struct(*docs.columns).alias("row"))
    return kept.alias("d").join(again.alias("x"), same, "left_anti").unionByName(once.dropDuplicates(["doc_id", "text_key"]).select("row.*"))
