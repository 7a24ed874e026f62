import random
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest

from ledgerloom.llm import alignment as A

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tok():
    return A.Tokenizers(*PATHS)


def brute(tok, texts):
    """Whole texts under both libraries; groups and links by byte ranges; counts over all texts."""
    seen, counts = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = tok.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tok.b.encode(text) if text else []
        ends = [list(accumulate(len(of[i]) for i in ids)) for ids, of in ((a, tok.a_bytes), (b, tok.b_bytes))]
        if not text or b"".join(tok.a_bytes[i] for i in a) != whole or b"".join(tok.b_bytes[i] for i in b) != whole:
            seen.append(None)
            continue
        starts = [[0, *e[:-1]] for e in ends]
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if max(starts[0][i], starts[1][j]) < min(ends[0][i], ends[1][j])] if len(a) < 400 else None
        if links is None:
            links, i, j = [], 0, 0
            while i < len(a) and j < len(b):
                links.append((a[i], b[j]))
                i, j = i + (ends[0][i] <= ends[1][j]), j + (ends[1][j] <= ends[0][i])
        groups, low = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            pick = lambda ids, side: ",".join(str(x) for x, e in zip(ids, ends[side]) if low < e <= cut)  # noqa: B023, E731
            groups.append(f"{pick(a, 0)}|{pick(b, 1)}" if len(a) < 400 else None)
            low = cut
        seen.append((len(a), len(b), len(groups), links, ";".join(groups) if len(a) < 400 else None))
        counts.update(set(links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    zero = (0, 0, 0, 0, 0, 0, "")
    return [zero if s is None else (*s[:3], len(s[3]), sum(counts[p] == best[p[0]] for p in s[3]), sum(counts[p] for p in s[3]), s[4]) for s in seen]


def check(spark, tok, texts, **more):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    got = A.align(spark.createDataFrame(rows, "doc_id long, text string, block string, piece int").repartition(3), *PATHS, **more).collect()
    want = brute(tok, texts)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.doc_id)] == list(range(len(texts)))
    for r in got:
        w = want[r.doc_id]
        assert tuple(r)[1:7] == w[:6], texts[r.doc_id][:80]
        assert w[6] is None or r.groups == w[6]


EDGES = [
    None, "", " ", "  ", "\n", "\n\n", " \n x", "a", "a b", " a", "  a  b ", "x\ny", "x\n\ny", "x \ny", "x\n y", "x\t y\r\n z", "don't we'll 's", "a▁b", "▁", "<s> </s> <unk> <0x0A> <|endoftext|>",
    "naïve café über", "日本語のテキスト。次の文", "🙂 emoji 🙂🙂", "a\x00b", "﻿bom", "é combining", "1,234.56; (x): y!", "\x1c sep\x85nel\xa0nb", "word.\nNext,\nlast", "x² y³, z", "a", "a b",
]


def test_edges_and_blocks(spark, tok):
    check(spark, tok, EDGES)
    check(spark, tok, EDGES, block_chars=10)


def test_random_texts(spark, tok):
    rng = random.Random(4)
    parts = [*"abcdeéßñ.,;:!?()'\"-_/|#*0123456789", " ", " ", " ", "\n", "\t", "  ", " the", " und", "ing", "▁", "²", "中", "'s", "\r"]
    check(spark, tok, ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300)], block_chars=900)


def test_long_texts_and_shuffled_counts(spark, tok, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "beta,", "gamma.", "x1", "été"]) for _ in range(3000)), "q" * 5000, "ab" * 3000 + "\n" + "z " * 900, *EDGES]
    monkeypatch.setattr(A, "MOST_BROADCAST_PAIRS", 0)
    check(spark, tok, texts)


def test_rows_that_repeat_or_have_no_id(spark, tok):
    rows = [(None, "a b"), (None, "a b"), (1, "a b"), (1, None)]
    got = sorted(map(tuple, A.align(spark.createDataFrame(rows, "doc_id long, text string"), *PATHS).collect()), key=str)
    assert len(got) == 4 and sum(r[6] == 6 for r in got) == 3  # two links, each in three documents
    assert A.align(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0


def test_cutter_refuses_pieces_across_spaces():
    with pytest.raises(ValueError, match="cross"):
        A.Cutter(["a▁b"])
    assert A.Cutter(["a,"]).inner("ab,cd;e") == [" ab,cd", ";e"]  # a mark that a piece joins to a letter cuts nothing
