import random

from ledgerlark.llm import p5_reading as p5

EASY = "We sold the boats to our buyers. They paid us with cash and that is good. The price of our beds was low.".split(". ")
HARD = "Notwithstanding the {} considerations of the {} arrangements which our {} counterparties have, the {} obligations of the organization would {} the {} of our {} and {} which are {} with the {} of the {}"


def text(r, band):
    if band == 1:
        return " ".join(s.rstrip(".") + "." for s in r.choices(EASY, k=8))
    word = lambda: "".join(r.choices("abcdefghij", k=12))
    return " ".join(HARD.format(*[word() for _ in range(11)]) + "." for _ in range(4))


def test_bands(spark, filings):
    r = random.Random(3)
    bands = {i: 3 if i % 3 else 4 for i in range(60)}
    rows = [(i, text(r, 1 if b == 3 else 4)) for i, b in bands.items()]
    rows = [(i, "## Head\n\n" + t if i % 5 == 0 else t) for i, t in rows] + [(99, "El margen de la compañía bajó en el año y no subió más."), (98, None), (97, " ")]
    labels = spark.createDataFrame([(i, "item_1a", bands[i]) for i in range(20)] + [(0, "item_1a", None), (500, "mda", 4)], "filing_id long, section string, reading_band int")
    got = {x["filing_id"]: x["band"] for x in p5.levels(filings(rows), labels).collect()}
    assert got == bands


def test_without_labels(spark, filings):
    none = spark.createDataFrame([], "filing_id long, section string, reading_band int")
    rows = p5.levels(filings([(1, text(random.Random(1), 1))]), none).collect()
    assert rows[0]["band"] is None
    assert p5.levels(filings([]), none).collect() == []


def test_fit():
    share, length, limits = p5.fit([(1, 0.1, 8.0), (1, 0.12, 9.0), (2, 0.2, 15.0), (2, 0.22, 16.0), (4, 0.9, 40.0)])
    assert set(limits) == {2} and 0.12 * share + 9 * length < limits[2] < 0.2 * share + 15 * length
    assert p5.fit([])[2] == {}


def test_the_latest_delivery_counts(spark, filings):
    none = spark.createDataFrame([], "filing_id long, section string, reading_band int")
    easy = text(random.Random(1), 1)
    rows = [(1, easy, None, 1), (1, "El margen de la compañía bajó en el año y no subió más.", None, 4), (2, "El margen bajó.", None, 1), (2, easy, None, 2), (2, easy, None, 2), (None, easy)]
    assert [r["filing_id"] for r in p5.levels(filings(rows), none).collect()] == [2]
