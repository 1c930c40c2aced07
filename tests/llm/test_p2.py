import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import common, forms, p2_near as p2


def jaccard(a, b, k=3):
    s = lambda t: set(zip(*[forms.words(forms.skeleton(t))[i:] for i in range(k)]))
    x, y = s(a), s(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def corpus(n=40, seed=1):
    r = random.Random(seed)
    out = []
    while len(out) < n:
        base = [f"w{r.randrange(400)}" for _ in range(r.randrange(30, 120))]
        for _ in range(r.randrange(1, 4)):
            t = list(base)
            for _ in range(r.randrange(0, 6)):
                t[r.randrange(len(t))] = f"x{r.randrange(400)}"
            out.append(" ".join(t))
    return out[:n]


def test_minmax_estimates_similarity():
    a = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    b = np.concatenate([a[300:], np.arange(5000, 5300, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)])
    est = (p2.signature(a, 4000) == p2.signature(b, 4000)).mean()
    assert est == pytest.approx(700 / 1300, abs=0.04)


def test_pairs_against_brute_force(spark, filings):
    texts = corpus()
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(100, None, None), (101, "too short", None), (102, "", "  "), (3, texts[3], None, 4), (None, texts[0], None), (103, texts[0].upper(), None), (104, texts[0].replace("w", "ｗ"), None)]
    got = {(r["filing_id_a"], r["filing_id_b"]) for r in p2.filing_pairs(common.sections(filings(rows))).collect()}
    all_texts = {i: t for i, t, *_ in rows if i is not None and t and t.strip()}
    want = {(i, j) for i in all_texts for j in all_texts if i < j and forms.skeleton(all_texts[i]) != forms.skeleton(all_texts[j]) and jaccard(all_texts[i], all_texts[j]) >= 0.5}
    far = {(i, j) for i, j in want if jaccard(all_texts[i], all_texts[j]) >= 0.6}
    assert far <= got <= want and len(far) > 5


def test_left_out_sections(spark, filings):
    t = " ".join(f"w{i}" for i in range(60))
    f = filings([(1, t), (2, t + " end"), (3, t + " other")])
    without = spark.createDataFrame([(3, "item_1a")], "filing_id long, section string")
    assert {(r[0], r[1]) for r in p2.filing_pairs(common.sections(f), without).collect()} == {(1, 2)}


def test_groups_are_connected_components(spark, filings):
    base = [f"w{i}" for i in range(200)]
    chain = [" ".join(base[4 * i : 4 * i + 150]) for i in range(5)]  # neighbours are similar, the ends less so
    f = filings([(i, t) for i, t in enumerate(chain)] + [(9, " ".join(f"z{i}" for i in range(80)))])
    rows = p2.groups(*p2.near(common.sections(f), None, 5, 0.8, 50, 8)).collect()
    assert {r["filing_id"] for r in rows} == set(range(5)) and len({r["group_id"] for r in rows}) == 1


def test_long_chains_are_one_group_each(spark):
    """Chains of edited versions whose ids are in no order, in falling order, and as a star."""
    r = random.Random(7)
    shuffled = r.sample(range(1000), 500)
    falling = list(range(1500, 1200, -1))
    edges = [*zip(shuffled, shuffled[1:]), *zip(falling, falling[1:]), *((2000, 2000 + i) for i in range(1, 40))]
    ids = {*shuffled, *falling, *range(2000, 2040)}
    members = spark.createDataFrame([(i, "mda", i) for i in ids], "filing_id long, section string, id long")
    pairs = spark.createDataFrame([(min(e), max(e), 0.9) for e in edges], "a long, b long, similarity double")
    rows = p2.groups(members, pairs).collect()
    assert len(rows) == len(ids) and {r["filing_id"] for r in rows} == ids
    for part in (shuffled, falling, range(2000, 2040)):
        assert {r["group_id"] for r in rows if r["filing_id"] in set(part)} == {min(part)}
    assert sum(r["links"] for r in rows) == 2 * len(edges)
    assert p2.groups(members, pairs.limit(0)).collect() == []


def test_a_hot_band_is_split_and_whole(spark):
    """One band holds 1,500 texts: all its pairs come out, from parts of PART texts on one side."""
    n = 1500
    texts = spark.range(n).select("id", F.array(F.lit(7).cast("long"), F.col("id") + 100).alias("bands"))
    got = p2.candidates(texts)
    assert got.count() == n * (n - 1) // 2
    assert spark.range(3).select("id", F.array(F.col("id")).alias("bands")).transform(p2.candidates).count() == 0


def test_groups_of_many_copies(spark, filings):
    """A third of the rows hold one text, written in many ways; a near text is linked with each of them."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base.replace(" ", " " * (1 + i % 3))) for i in range(60)] + [(100 + i, " ".join(f"z{i}x{j}" for j in range(40))) for i in range(120)] + [(500, base + " end")]
    got = {(r[0], r[1]) for r in p2.filing_pairs(common.sections(filings(rows))).collect()}
    assert got == {(i, 500) for i in range(60)}


def test_nothing(filings):
    assert p2.filing_pairs(common.sections(filings([]))).collect() == []


def test_batches_give_what_single_texts_give():
    r = random.Random(5)
    words = [[f"w{r.randrange(50)}" for _ in range(r.choice([0, 1, 2, 3, 7, 400, 9000]))] for _ in range(40)]
    h, at = p2.shingles_of_texts(words, 3)
    full = [i for i in range(40) if at[i + 1] > at[i]]
    sig = p2.signatures(h, at[[*full, 40]], 100)
    for i in range(40):
        assert (h[at[i] : at[i + 1]] == p2.shingles(words[i], 3)).all()
    for k, i in enumerate(full):
        one = p2.signature(p2.shingles(words[i], 3), 100)
        assert (sig[k] == one).all() and (p2.bands_of(sig, 20, 5)[k] == p2.bands_of(one, 20, 5)).all()
    assert p2.shingles_of_texts([], 3)[0].size == 0 and p2.shingles_of_texts([[], ["a"]], 3)[1].tolist() == [0, 0, 0]
