import random
from collections import Counter

import duckdb
import pytest

from ledgerloom.llm import host_rules as H


def brute(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if any(c not in " \t\n\v\f\r" for c in x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), dup, len(covered)


EDGES = [None, "", " \n\t", "a", "a b c", "a b c a b c", "a a a a", "a b c d a b c", "x\nx\n \nx y\nx", "é# ü\x0bß|<>\x0c*", "a\x85b\xa0c   d", "a\r\na\r\n", "one two three " * 400]


def test_counts_against_brute_force():
    rng = random.Random(1)
    texts = EDGES + ["".join(rng.choice(["a", "b", "c", " ", " ", "\n", "#", "\t", "é"]) for _ in range(rng.randint(0, 80))) for _ in range(500)]
    for t in texts:
        assert H.text_counts(t) == brute(t), t


def documents():
    """Hosts of all three verdicts: clean, ordinary and junk ones, a hot one, one of a single document, and null."""
    rng = random.Random(2)
    clean = lambda: " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(rng.randint(60, 90)))
    junk = lambda part: clean() + " " + "#" * part
    rows = []
    for host, n, bad in (("hot", 300, 0.1), ("junk", 60, 0.9), ("fine", 200, 0.0), ("one", 1, 1.0), (None, 40, 0.1), ("mixed", 90, 0.3)):
        rows += [(len(rows) + i, junk(60) if rng.random() < bad else junk(7) if rng.random() < 0.3 else clean(), host) for i in range(n)]
    rows += [(len(rows) + i, t, "hot") for i, t in enumerate(EDGES)]
    return rows + [rows[0], (None, clean(), "hot")]


@pytest.mark.parametrize("most", [H.MOST_BROADCAST_HOSTS, 3])
def test_verdicts_equal_sql(spark, monkeypatch, most):
    monkeypatch.setattr(H, "MOST_BROADCAST_HOSTS", most)
    rows = documents()
    df = spark.createDataFrame([(*r, 5, "x", True) for r in rows], "doc_id long, text string, source string, n long, host string, kept boolean")
    got = H.apply_host_rules(df)
    verdicts = {r.host: r.host_verdict for r in got.select("host", "host_verdict").distinct().collect()}
    assert verdicts["junk"] == "suspect" and verdicts["fine"] == "trusted" and verdicts["hot"] == "plain" and None in verdicts
    con = duckdb.connect()
    import pandas as pd

    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    names = [d[0] for d in con.execute(H.SQL).description]
    want = con.execute(H.SQL).fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted(want, key=key)


def test_clean_documents_stay_and_shrinkage_spares_small_hosts(spark):
    got = {(r.doc_id, r.host): r for r in H.apply_host_rules(spark.createDataFrame(documents(), "doc_id long, text string, source string")).collect()}
    assert all(r.kept for r in got.values() if r.n_symbols == 0 and r.n_words >= 50 and r.n_repeat_words == 0)
    one = next(r for r in got.values() if r.host == "one")
    assert one.host_rate < 1  # one failing document doesn't make a rate of one


def test_empty_table_and_one_host(spark):
    schema = "doc_id long, text string, source string"
    assert H.apply_host_rules(spark.createDataFrame([], schema)).count() == 0
    assert {r.host_verdict for r in H.apply_host_rules(spark.createDataFrame([(1, "a", "h"), (2, None, "h")], schema)).collect()} == {"suspect"}  # all of its documents fail
