import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlark.llm import p8_packing as p8


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=30))
@settings(max_examples=150, deadline=None)
def test_plan_uses_every_item_and_never_overflows(counts):
    used = {}
    for lengths, times in p8.plan(counts, 50):
        assert sum(lengths) <= 50 and times > 0
        for x in lengths:
            used[x] = used.get(x, 0) + times
    assert used == counts


def test_exact_complements_leave_no_gap():
    patterns = p8.plan({30: 5, 20: 5, 25: 4, 10: 6, 17: 2, 16: 1, 40: 0}, 50)
    total = 30 * 5 + 20 * 5 + 25 * 4 + 10 * 6 + 34 + 16
    assert sum(t for _, t in patterns) == -(-total // 50)


@pytest.mark.parametrize("hot", [False, True])
def test_pack(spark, hot):
    r = random.Random(7)
    sizes = [(i, 300 if hot and i % 3 == 0 else r.choice([0, 1, 5, 60, 255, 300, 700, 2048, 2049, 5000, 10_000])) for i in range(600)]
    counts = spark.createDataFrame(sizes, "doc_id long, tokens long")
    rows = p8.pack(counts).collect()
    by, room = {}, {}
    for x in rows:
        by.setdefault(x["doc_id"], []).append((x["piece"], x["tokens"]))
        if x["container_id"] is not None:
            room[x["container_id"]] = room.get(x["container_id"], 0) + x["tokens"]
    for i, n in sizes:
        assert sum(t for _, t in by[i]) == n and sorted(p for p, _ in by[i]) == list(range(max(1, -(-n // 2048)))), (i, n)
    assert max(room.values()) <= 2048 and set(room) == set(range(len(room)))
    pieces = sorted((min(2048, n - k) for _, n in sizes for k in range(0, n, 2048)), reverse=True)
    bins = []  # best fit decreasing, one by one
    for x in pieces:
        fit = [b for b in range(len(bins)) if bins[b] >= x]
        if fit:
            bins[min(fit, key=bins.__getitem__)] -= x
        else:
            bins.append(2048 - x)
    assert len(room) <= len(bins)


def test_documents(spark):
    rows = [(1, "one two three"), (2, None), (3, ""), (None, "x"), (1, "one"), (4, "word " * 5000)]
    docs = spark.createDataFrame([(*r, "clash", 9) for r in rows], "doc_id long, text string, tokens string, piece long")
    got = {r["doc_id"]: r["tokens"] for r in p8.token_counts(docs).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1] == 3 and got[2] == got[3] == 0 and got[4] > 2048
    assert p8.pack(spark.createDataFrame([], "doc_id long, tokens long")).count() == 0
