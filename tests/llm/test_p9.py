import random

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlark.llm import forms, p9_leaks as p9


def longest(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


@given(st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.sampled_from("abc"), max_size=20), st.integers(2, 4))
@settings(max_examples=300, deadline=None)
def test_tiles(doc, item, k):
    got = p9.tiles(doc, item, k)
    n = longest(doc, item)
    assert max([t[2] for t in got], default=0) == (n if n >= k else 0)
    seen_d, seen_i = set(), set()
    for i, j, m in got:
        assert doc[i : i + m] == item[j : j + m] and m >= k
        assert not seen_d & set(range(i, i + m)) and not seen_i & set(range(j, j + m))
        seen_d |= set(range(i, i + m))
        seen_i |= set(range(j, j + m))


def make(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(words, k=30))) for i in range(8)] + [(8, None), (9, ""), (10, "few words"), (None, "a " * 20), (0, None)]
    docs = []
    for d in range(60):
        own = r.choices(words, k=r.randrange(0, 80))
        item = items[r.randrange(8)][1].split()
        n, at = r.randrange(5, 25), r.randrange(0, 10)
        docs.append((d, (" ".join(own) + ", " + "; ".join(item[at : at + n]).upper()) if d % 3 else " ".join(own)))
    docs += [(100, None), (101, ""), (None, items[0][1]), (102, items[1][1]), (102, items[1][1]), (103, " ".join(items[2][1].split()[15:] + ["gap"] + items[2][1].split()[:15]))]
    return spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id long"), spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id long"), docs, items


def test_both_ways_against_brute_force(spark):
    d, i, docs, items = make(spark)
    want = {(a, b) for a, t in docs for b, s in items if a is not None and b is not None and t and s and longest(forms.words(t), forms.words(s)) >= 12}
    for bound in (10**9, 0):
        got = {(r["doc_id"], r["item_id"]): r for r in p9.leaks(d, i, 12, max_item_words=bound).collect()}
        assert set(got) == want and len(want) > 10, bound
        assert got[103, 2]["covered"] == 30 and got[103, 2]["longest"] == 15  # reordered halves


def test_nothing(spark):
    d, i, *_ = make(spark)
    assert p9.leaks(d.limit(0), i).count() == 0 and p9.leaks(d, i.limit(0)).count() == 0
