import hashlib
import random

import numpy as np
import xxhash

from ledgerloom.llm import minhash as M
from ledgerloom.llm.common import WordHashes, words

SCHEMA = "doc_id long, text string, n_chars string, fingerprint string"


def jaccard(a, b):
    def grams(t):
        w = words(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def texts(n, seed):
    rng = random.Random(seed)
    voc = [f"w{i}" for i in range(3000)]
    return [" ".join(rng.choices(voc, k=rng.choice([1, 3, 4, 5, 9, 60, 400, 900]))) for _ in range(n)]


M64 = 2**64 - 1
GOLDEN, M1, M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(x):
    x = ((x ^ (x >> 30)) * M1) & M64
    x = ((x ^ (x >> 27)) * M2) & M64
    return x ^ (x >> 31)


def asked(b):
    """All bins in the order in which bin ``b`` asks them."""
    own = mixed((b + 1) * GOLDEN & M64)
    return sorted(range(512), key=lambda t: mixed((own + (t + 1) * GOLDEN) & M64))


ASKED = [asked(b) for b in range(512)]


def brute(text):
    """The 512 stored digits of a text, in plain integers."""
    h = [xxhash.xxh64_intdigest(w) for w in (text or "").encode().lower().split()]
    k = min(5, len(h))
    bins = {}
    for i in range(len(h) - k + 1 if h else 0):
        g = k * GOLDEN & M64
        for x in h[i : i + k]:
            g = (mixed(g ^ x) + GOLDEN) & M64
        b, v = g >> 55, g & (2**55 - 1)
        bins[b] = min(v, bins.get(b, v))
    if not bins:
        return [0] * 512
    full = [bins[b] if b in bins else bins[next(t for t in ASKED[b] if t in bins)] for b in range(512)]
    return [mixed(v ^ mixed(mixed(b + 1))) & 15 for b, v in enumerate(full)]


def hexes(digits):
    return "".join(f"{d:x}" for d in digits)


def likeness(a, b):
    return min(1.0, max(0.0, (sum(x == y for x, y in zip(a, b)) / 512 - 1 / 16) / (15 / 16)))


def place(r):
    h = xxhash.xxh64_intdigest((r[1] or "").encode(), 42)
    return (r[0] is not None, r[0] or 0, h - 2**64 if h >= 2**63 else h, r[1] or "")


def check(spark, rows):
    got = M.fingerprint_pairs(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    order = sorted(rows, key=place, reverse=True)
    want = []
    for i, r in enumerate(order):
        t, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        own, changed, after = brute(t), brute(e), brute(nxt)
        want.append((r[0], len(t), hashlib.sha256(e.encode()).hexdigest(), hexes(own), hexes(changed), round(likeness(own, changed), 9), round(likeness(own, after), 9)))
    assert sorted(map(str, ((*tuple(g)[:5], round(g.near_edited, 9), round(g.near_next, 9)) for g in got))) == sorted(map(str, want))
    return got


def test_pairs_against_brute_force(spark):
    ts = texts(120, 1)
    check(spark, [(i * 3 % 131, t, "c", "f") for i, t in enumerate(ts)])


def test_an_id_that_most_rows_share_is_cut_between_its_texts(spark):
    rows = [(7 if i % 3 else None, t, "", "") for i, t in enumerate(texts(90, 4))] + [(i, t, "", "") for i, t in enumerate(texts(12, 5))]
    check(spark, rows)
    cut = M.beside_next(spark.createDataFrame(rows, SCHEMA).select("doc_id", "text"), 8)
    size = {r.bucket: r["count"] for r in cut.where("extra = 0").groupBy("bucket").count().collect()}
    assert len(size) >= 6 and max(size.values()) < 40


def test_different_texts_of_few_shingles_look_different():
    rng, memo = random.Random(3), WordHashes()
    one = [memo.of([f"t{rng.random()}".encode()]) for _ in range(4000)]
    low = M.fingerprints(one)
    assert (M.likeness(low[::2], low[1::2]) < 0.1).mean() >= 0.99
    two = M.fingerprints([memo.of([f"t{rng.random()}".encode() for _ in range(6)]) for _ in range(4000)])
    assert (M.likeness(two[::2], two[1::2]) < 0.1).mean() >= 0.99


def test_nulls_repeats_and_small_tables(spark):
    check(spark, [(5, None, "", ""), (5, "a b", "", ""), (None, "last one here", "", ""), (9, "", "", ""), (2, "é" * 9 + " ü" * 50_000, "", ""), (2, "tie", "", "")])
    (r,) = check(spark, [(1, "only one text in here today", "", "")])
    assert r.near_next == 1.0
    assert M.fingerprint_pairs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_estimate_is_close_to_jaccard():
    memo, rng = WordHashes(), random.Random(2)
    voc = [f"w{i}" for i in range(3000)]
    off = []
    for _ in range(150):
        a = rng.choices(voc, k=rng.choice([40, 300, 1500]))
        cut = rng.randrange(len(a))
        b = a[:cut] + rng.choices(voc, k=len(a) - cut)
        x, y = M.fingerprints([memo.of([w.encode() for w in a])]), M.fingerprints([memo.of([w.encode() for w in b])])
        assert (M.unpack(M.pack(x)[0]) == x[0]).all()
        off.append(M.likeness(x, y)[0] - jaccard(" ".join(a), " ".join(b)))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.05
    assert M.likeness(x, x)[0] == 1.0


def test_plain_operator(spark):
    df = spark.createDataFrame([(1, "Aa bb cc", "", ""), (2, "aA  BB\ncc", "", ""), (3, None, "", "")], SCHEMA)
    got = {r.doc_id: r.fingerprint for r in M.fingerprint_documents(df).collect()}
    assert got[1] == got[2] != got[3] and set(got[3]) == {"0"}
