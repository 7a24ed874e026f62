import hashlib
import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import bpe_tree as B

PATH = public_tokenizers.path("word_bpe_49k.json")
BITS = ["<|endoftext|>", "<|startoftext|>", " ", "\n", "'re", "'LL", "É", "é", "é", "x" * 50, "12", "!!", "日本", "\t", "a b c", "\x1c", "᠎", "\0", "　", " Σσς ", "İ", "\xa0", "\x85", "ﬁ", "Ⅷ", "😀👍🏽", "the", "Hello"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_ids_and_decoding_equal_the_library(library):
    rng, bpe = random.Random(2), B.TreeBPE(PATH)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 40))) for _ in range(1500)]
    for t, (n, ids, decoded) in zip(texts, bpe.encode_texts(texts)):
        want = library.encode(t, add_special_tokens=False).ids
        assert (n, ids) == (len(want), " ".join(map(str, want)))
        assert decoded == library.decode(want, skip_special_tokens=False) == bpe.decode(want)


def test_a_small_memo_changes_nothing(library):
    rng, bpe = random.Random(3), B.TreeBPE(PATH, memo=20)
    for _ in range(30):
        texts = ["".join(rng.choices("abcdefgh ", k=60)) for _ in range(5)]
        assert [bpe.encode(t) for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_words(library):
    bpe, text = B.TreeBPE(PATH), "lalaland" * 4000
    assert bpe.encode(text) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("few", [0, 3, 10**6])
def test_words_merge_alike_alone_and_together(library, monkeypatch, few):
    monkeypatch.setattr(B, "FEW", few)
    rng, bpe = random.Random(4), B.TreeBPE(PATH)
    words = ["".join(rng.choices("abcdeilnorst", k=rng.randint(1, 70))) for _ in range(400)]
    assert [bpe.encode(w) for w in words] == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_an_unbroken_megabyte_takes_seconds_and_stays_in_no_memo(library):
    rng, bpe = random.Random(5), B.TreeBPE(PATH)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    began = time.perf_counter()
    assert bpe.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert time.perf_counter() - began < 60
    assert not bpe.words and not bpe.pre


def test_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello  World!", "x"), (3, "Hello  World!", "x"), (None, "ü", "x")]
    schema = "doc_id long, text string, ids string"
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, tuple(r.ids)) for r in B.bpe_encode(spark.createDataFrame(rows, schema), PATH, keep=True).collect()}
    want = set()
    for d, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), tuple(ids)))
    assert got == want
    assert B.bpe_encode(spark.createDataFrame([], schema), PATH).count() == 0
