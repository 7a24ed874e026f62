import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from ledgerloom.llm import queries as Q


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    rng = random.Random(1)
    voc = ["".join(rng.choices("abcdefghiklmnorstu", k=rng.randint(2, 9))) for _ in range(3000)]
    docs, labels, n = [], [], 0
    for i in range(120):
        lines = [" ".join(rng.choices(voc, k=20)).capitalize() + "." for _ in range(8)]
        bad = i % 6 == 0
        text = "\n".join(x.upper().replace(" ", "!! ") for x in lines) if bad else "\n".join(lines)
        if i % 10 == 1:
            text += f"\nWrite to user.{i}@mail.example.com now."
        for copy in range(3 if i % 12 == 5 else 1):
            docs.append((n, text if copy < 2 else text.replace(lines[3].split()[4], "changed", 1), "en", f"src{i % 3}" if i % 7 else None, len(text)))
            labels.append((n, int(not bad), 0))
            n += 1
    docs.append((n, None, None, None, None))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(base / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(base / "labels.parquet"))
    return str(base), docs, labels


def test_stages_take_effect(spark, tables, tmp_path):
    base, docs, labels = tables
    frame, seen = spark.read.parquet(f"{base}/documents.parquet"), {}
    columns = frame.columns
    for name, stage in C.STAGES:
        stage(spark, frame, base).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        seen[name] = frame
        assert name == "bpe" or frame.columns == columns
    good = {i for i, q, _ in labels if q}
    kept = {r.doc_id for r in seen["quality"].collect()}
    assert len(good - kept) <= 3 and len((kept & {i for i, _, _ in labels}) - good) <= 3
    texts = {i: t for i, t, *_ in docs}
    left = [r.doc_id for r in seen["near_dedup"].collect()]
    assert len(left) == len(set(left)) and sum(texts[i] is None or texts[i] not in {texts[j] for j in left if j != i} for i in left) == len(left)
    assert seen["pii"].where(F.col("text").contains("@mail")).count() == 0 and seen["pii"].where(F.col("text").contains("<EMAIL>")).count() > 0
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    mixed = sorted((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids)) for r in seen["mix"].collect())
    assert sorted((r.doc_id, tuple(r.ids)) for r in seen["bpe"].collect()) == mixed
    assert sorted((r.doc_id, tuple(r.ids)) for r in C.run(spark, base).collect()) == mixed


def test_clashing_columns_ties_and_very_long_texts(spark, tables, tmp_path):
    base, docs, _ = tables
    extra = ["score", "label", "node", "n", "size", "row", "piece", "pieces", "kind", "keep", "root", "text_key", "shard", "taken", "cut", "first"]
    long = "\n".join(docs[2][1].split("\n") * 400)
    rows = [*docs, (9001, long, "en", "src0", len(long)), (9002, long + " tail", "en", "src0", len(long) + 5), docs[4], (None, docs[3][1] + " x", "en", None, 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame = frame.select("*", *(F.lit(f"<{c}>").alias(c) for c in extra))
    columns = frame.columns
    for name, stage in C.STAGES:
        stage(spark, frame, base).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        if name != "bpe":
            assert frame.columns == columns and frame.count() > 0
            assert frame.where(" or ".join(f"`{c}` is null or `{c}` <> '<{c}>'" for c in extra)).count() == 0
        if name == "near_dedup":
            kept = [r.doc_id for r in frame.select("doc_id").collect()]
            assert 9002 not in kept and kept.count(docs[4][0]) <= 1


def test_empty_documents(spark, tables, tmp_path):
    base, *_ = tables
    frame = spark.read.parquet(f"{base}/documents.parquet").limit(0)
    for name, stage in C.STAGES:
        stage(spark, frame, base).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        assert frame.count() == 0


def test_registered_names():
    names = list(Q.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(Q.oracle_sql()) <= set(names)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
