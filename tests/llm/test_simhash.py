import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import simhash as S

SCHEMA = "doc_id long, text string, extra string"


def brute_fingerprint(text, size=3):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, budget=2):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= budget:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_trie_join_finds_all_links_of_random_and_dense_signatures():
    rng = random.Random(3)
    for trial in range(6):
        fps = {rng.getrandbits(64) for _ in range(150)}
        for c in rng.sample(sorted(fps), 3):  # balls round a few centres
            fps |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(150)}
        fps = sorted(fps)
        sig = np.array(fps, np.uint64)[:, None]
        views = S.exact_views()
        bits = S._bits(sig)
        view_of = np.repeat(np.arange(len(views)), len(fps))
        key = np.concatenate([(np.int64(i) << 40) | S._pick(bits, v.key).astype(np.int64) for i, v in enumerate(views)])
        u, v = S.join_rows(view_of, key, np.tile(sig, (len(views), 1)), np.tile(np.arange(len(fps)), len(views)), views, 2, 2)
        root = list(range(len(fps)))
        for a, b in zip(u, v):
            root[a] = int(b)
        assert root == brute_components(fps)


def test_components_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(40, 160))) for _ in range(60)]
    for t in list(texts[:25]):
        for _ in range(3):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [None, "", "  \t", "One", "one", "Two words", texts[0], texts[0].upper(), "x " * 30_000]
    rows = [(i, t, "e") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in S.simhash_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(rows))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(rows))] == brute_components(fps)


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, "a b c d", "x"), (7, "a b c d", "x"), (7, "a b c d", "y"), (None, "nothing like it at all", None)]
    got = S.simhash_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]
    assert S.simhash_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_stage_keeps_one_of_each_group(spark):
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(5000)]
    rows, groups, n = [], defaultdict(list), 0
    for g in range(40):
        base = rng.choices(vocabulary, k=300)
        for c in range(1 + g % 4):
            w = list(base)
            for _ in range(c):  # Jaccard 0.9 and more
                w[rng.randrange(300)] = "edit"
            rows.append((n, " ".join(w), "e"))
            groups[g].append(n)
            n += 1
    rows += [(3, rows[3][1], "again"), (n, None, "e"), (n + 1, "", "e")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = S.keep_one_per_group(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted([*(min(g) for g in groups.values()), n])
    assert S.keep_one_per_group(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("budget", [1, 2, 3])
def test_views_cover_the_budget(budget):
    rng = random.Random(budget)
    views = S.exact_views(64, budget)
    for _ in range(300):
        flipped = set(rng.sample(range(64), budget))
        assert any(not flipped & set(v.key) for v in views)


def test_tables_follow_the_number_of_signatures():
    assert S.plan_tables(1)[1] == 24
    small, large = S.plan_tables(10**5), S.plan_tables(10**9)
    assert large[1] > small[1] and large[0] > small[0]
    rng = np.random.default_rng(1)
    views = S.sampled_views(256, *small, 2)
    tables = [[*v.key, *v.walk] for v in views[::3]]
    met = 0
    for _ in range(400):
        apart = np.zeros(256, int)
        apart[rng.choice(256, 44, replace=False)] = 1
        met += any(apart[t].sum() <= 2 for t in tables)
    assert met >= 360


def brute_near(texts, size=5):
    sets = [set(S.shingles(S.words(t), size)) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_stage_verifies_candidates_by_their_shingles(spark):
    rng = random.Random(21)
    fresh = lambda k: " ".join(f"u{rng.getrandbits(40):x}" for _ in range(k))
    line = "\n".join(["one line of ten words that is repeated all over"] * 100)
    rows = [(i, f"{line}\n{fresh(60)}", "e") for i in range(6)]  # alike to 0.1 at most, close as a list of repeats
    base = fresh(300).split()
    for i in range(6, 30):  # similarities of 0.55 to 0.9 to one base
        w = list(base)
        at = rng.randrange(200)
        n = rng.randint(12, 80)
        w[at : at + n] = fresh(n).split()
        rows.append((i, " ".join(w), "e"))
    few = fresh(200)
    rows += [(30, few, "e"), (31, "\n".join([few] * 7), "e")]
    got = sorted(r.doc_id for r in S.keep_one_per_group(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted(set(brute_near([t for _, t, _ in rows])))


@pytest.mark.parametrize("chunk", [1, 3000, S.CHUNK])
def test_exact_links_are_those_of_all_pairs(spark, chunk):
    rng = random.Random(chunk)
    texts = []
    for _ in range(3):
        base = [f"u{rng.getrandbits(40):x}" for _ in range(120)]
        for _ in range(25):
            w = list(base)
            n = rng.randint(1, 45)
            at = rng.randrange(120 - n)
            w[at : at + n] = [f"u{rng.getrandbits(40):x}" for _ in range(n)]
            texts.append(" ".join(w))
    sets = S.shingle_sets(texts, 5)
    frame = spark.createDataFrame([(7 if chunk > 1 else i % 2, i, len(x), 1 + (i == 9), x.tobytes()) for i, x in enumerate(sets)], "root long, node long, n long, copies long, shingles binary")
    want = brute_near(texts)
    if chunk == 1:
        for part in (0, 1):
            for i, r in zip(range(part, len(texts), 2), brute_near(texts[part::2])):
                want[i] = part + 2 * r
    root = dict(enumerate(range(len(texts))))
    for r in S.connected_components(S.exact_links(frame, chunk)).collect():
        root[r.node] = r.root
    assert [root[i] for i in range(len(texts))] == want


def test_stage_decides_by_row_where_ids_are_null_or_repeat(spark):
    rng = random.Random(31)
    text = [" ".join(f"u{rng.getrandbits(40):x}" for _ in range(80)) for _ in range(8)]
    rows = [(3, text[0], "a"), (7, text[0], "b"), (7, text[1], "c")]  # 7 goes with one text, stays with the other
    rows += [(None, text[0], "d"), (None, text[2], "e"), (None, text[3], "f")]  # one copy, two of their own
    rows += [(9, text[4], "g"), (9, text[5], "h")]  # two texts of one id
    rows += [(None, text[6], "i"), (None, text[6], "i"), (None, text[6] + " more", "j")]  # null ids only: one stays
    rows += [(11, text[7], "k"), (11, text[7], "k"), (12, None, "l"), (12, "", "l")]
    got = S.keep_one_per_group(spark.createDataFrame(rows, SCHEMA)).collect()
    stay = sorted(r.extra for r in got)
    assert [x for x in stay if x not in "ij"] == ["a", "c", "e", "f", "g", "h", "k", "l"] and len(stay) == 9
