import random

import pytest

from ledgerlark.llm import p10_spans as p10


def shares(a, b, n=300):
    seen = {a[i : i + n] for i in range(len(a) - n + 1)}
    return any(b[i : i + n] in seen for i in range(len(b) - n + 1))


def corpus(seed=4, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghié 。", k=r.randrange(2, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    pool = [text(120) for _ in range(6)]
    out = []
    for i in range(n):
        p = r.choice(pool)
        k = r.choice([150, 290, 299, 300, 301, 420])
        at = r.randrange(0, max(1, len(p) - k))
        out.append((i, text(r.randrange(0, 60)) + p[at : at + k] + text(r.randrange(0, 60))))
    return out


def test_no_window_without_a_cut():
    for i, t in corpus()[:20]:
        c = p10.cuts(t)
        if len(c):
            assert c[0] <= 31 + p10.WINDOW and all(b - a <= p10.WINDOW for a, b in zip(c, c[1:])) and len(t) - c[-1] <= p10.WINDOW
    assert list(p10.cuts("x" * 50)) == [] and len(p10.cuts("=" * 1000)) > 0


@pytest.mark.parametrize("hot", [64, 2])
def test_pairs_against_brute_force(spark, hot):
    rows = corpus()
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, "short"), (203, "short"), (204, None), (205, ""), (206, "=" * 400), (207, "=" * 350), (208, "=" * 299), (None, rows[1][1])]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, u long")
    got = {tuple(r) for r in p10.document_pairs(docs, hot).collect()}
    known = [(i, t) for i, t in rows if i is not None and t]
    want = {(i, j) for x, (i, a) in enumerate(known) for j, b in known[x + 1 :] if len(a) >= 300 and len(b) >= 300 and shares(a, b)}
    assert got == want and len(want) > 10


def test_share(spark):
    r = random.Random(1)
    text = lambda k: "".join(r.choices("abcdefgh ijklm", k=k))
    span = text(400)
    docs = spark.createDataFrame([(1, text(100) + span), (2, span + text(300)), (3, text(500)), (4, "x" + text(350)), (5, None)], "doc_id long, text string")
    got = {x["doc_id"]: (x["chars"], x["shared_chars"]) for x in p10.shared_share(docs).collect()}
    assert set(got) == {1, 2} and got[1][0] == 500 and 400 <= got[1][1] <= 402 and 400 <= got[2][1] <= 402


def test_nothing(spark):
    assert p10.document_pairs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
