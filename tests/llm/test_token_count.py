import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import token_count as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["<|endoftext|>", "<|endo", " ", "\n", "  ", "'re", "'ll", "é", "xxx", "12", "!!", "日本", "\t", "a b c", "\x1c", "᠎", "​", "\0", "　", " y", "😀"]
SCHEMA = "doc_id long, text string, n_tokens string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_pieces_count_as_the_whole(library):
    rng, memo = random.Random(1), T.PieceCounts(T.load(PATH))
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 40))) for _ in range(2000)]
    assert memo.counts(texts) == [len(library.encode(t, add_special_tokens=False)) for t in texts]


@pytest.mark.parametrize("chunk,overlap", [(40, 20), (64, 32), (333, 50), (1000, 17)])
def test_spliced_ids_equal_the_whole(library, chunk, overlap):
    rng, tok = random.Random(chunk), T.load(PATH)
    for _ in range(60):
        text = "".join(rng.choices([*BITS, "z" * rng.randint(1, 120)], k=200))
        assert [i for p in T.encode_spliced(tok, text, chunk, overlap) for i in p] == library.encode(text, add_special_tokens=False).ids


def test_a_run_without_boundaries_widens(library):
    tok, text = T.load(PATH), "ab" * 3000
    assert [i for p in T.encode_spliced(tok, text, 100, 20) for i in p] == library.encode(text, add_special_tokens=False).ids


def test_a_long_run_without_boundaries_costs_a_few_passes(library):
    class Counting:
        def __init__(self, tok):
            self.tok, self.chars = tok, 0

        def encode(self, text, **kw):
            self.chars += len(text)
            return self.tok.encode(text, **kw)

    for n in (66_000, 264_000, 1_056_000):
        text, tok = "ab" * (n // 2) + " then words", Counting(T.load(PATH))
        assert sum(map(len, T.encode_spliced(tok, text))) == len(library.encode(text, add_special_tokens=False))
        assert tok.chars < 16 * len(text)


def test_other_pre_tokenizers_are_left_to_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert T.splittable(PATH) and not T.splittable(path)
    texts = ["Hello  World's end", "", "x" * 50_000, "<|endoftext|> a"]
    tok = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in T.count_tokens(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA), path).collect()}
    assert got == {i: len(tok.encode(t, add_special_tokens=False)) for i, t in enumerate(texts)}


def test_rows(spark, library):
    long = "Some words of a long text, repeated. " * 4000
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello world", "x"), (3, "Hello world", "x"), (None, "ü", "x"), (5, long, "x")]
    got = sorted(map(str, T.count_tokens(spark.createDataFrame(rows, SCHEMA), PATH).collect()))
    n = len(library.encode(long, add_special_tokens=False))
    want = [(1, 0, 0, False), (2, 0, 0, False), (3, 11, 2, False), (3, 11, 2, False), (None, 2, len(library.encode("ü").ids), False), (5, len(long), n, n > 512)]
    assert got == sorted(f"Row(doc_id={a}, n_bytes={b}, n_tokens={c}, over_limit={d})" for a, b, c, d in want)
    assert T.count_tokens(spark.createDataFrame([], SCHEMA), PATH).count() == 0
