import pytest
from pyspark.sql import functions as F

from ledgerlark.config import CATEGORIES
from ledgerlark.functions import lexicon
from ledgerlark.sources import files

WORDS = {"negative": ["loss", "litigation", "decline"], "positive": ["gain", "improve"], "uncertainty": ["may", "risk"], "litigious": ["litigation", "claim"], "strong_modal": ["must"], "weak_modal": ["could"], "constraining": ["covenant"]}


@pytest.fixture(scope="module")
def lex(spark):
    return spark.createDataFrame([(w.upper(), c) for c, ws in WORDS.items() for w in ws] + [("LOSS", "negative"), (None, "negative")], "word string, category string")


def test_scores(spark, lex):
    rows = spark.createDataFrame([(1, ["loss", "Litigation", "gain", "other", "loss"]), (2, []), (3, ["x"])], "i int, t array<string>")
    table = lexicon.categories_of(lex)
    got = {r["i"]: r for r in rows.select("i", lexicon.score("t", table).alias("s")).select("i", "s.*").collect()}
    a = got[1]
    assert (a["negative_count"], a["litigious_count"], a["positive_count"], a["total_lm_words"], a["total_words"]) == (3, 1, 1, 5, 5)
    assert a["net_sentiment"] == pytest.approx(-0.4) and a["net_sentiment_normalized"] == pytest.approx(-2 / 5) and a["negative_pct"] == pytest.approx(0.6)
    assert all(v == 0 for k, v in got[2].asDict().items() if k != "i")
    joined = {r["i"]: r for r in lexicon.count_by_join(rows, "i", "t", lex).collect()}
    for i in got:
        assert joined[i].asDict() == pytest.approx(got[i].asDict())


def test_columns_with_prefix_and_tokenizer(spark, lex):
    df = spark.createDataFrame([("LOSS loss gain",), (None,)], "t string")
    got = lexicon.score_columns(df, lex, "t", "lm_", lambda c: F.split(c, " ")).orderBy("t").collect()
    assert got[0]["lm_total_words"] in (0, 1) and got[1]["lm_negative_count"] == 2
    assert len([c for c in got[0].asDict() if c.startswith("lm_")]) == len(lexicon.metric_names()) == 2 * len(CATEGORIES) + 4


def test_too_many_words_raise(lex):
    with pytest.raises(ValueError):
        lexicon.categories_of(lex, limit=2)


def test_read_lexicon_csv(spark, tmp_path):
    p = tmp_path / "lm.csv"
    p.write_text("Word,Negative,Positive,Uncertainty,StrongModal\nloss,2009,0,0,0\nold,-2020,0,0,0\nnone,NaN,0,x,0\nmust,0,0,0,2011\n")
    assert {tuple(r) for r in files.read_lexicon(spark, str(p)).collect()} == {("LOSS", "negative"), ("MUST", "strong_modal")}
    t = tmp_path / "lm.tsv"
    t.write_text("WORD\tNEGATIVE\tPOSITIVE\tWeak_Modal\ngain\t0\t1\t0\n")
    assert {tuple(r) for r in files.read_lexicon(spark, str(t)).collect()} == {("GAIN", "positive")}
    with pytest.raises(FileNotFoundError):
        files.read_lexicon(spark, str(tmp_path / "absent.csv"))


def test_empty_lexicon(spark):
    empty = spark.createDataFrame([], "word string, category string")
    df = spark.createDataFrame([("loss",)], "t string")
    assert lexicon.score_columns(df, empty, "t", "").first()["total_lm_words"] == 0


def test_words_beyond_the_constant_are_joined(spark, lex, monkeypatch):
    df = spark.createDataFrame([(1, "LOSS loss gain x"), (2, None), (3, "")], "i int, t string")
    cut = lambda c: F.split(c, " ")
    want = [r.asDict() for r in lexicon.score_columns(df, lex, "t", "", cut, ("i",)).orderBy("i").collect()]
    monkeypatch.setattr(lexicon, "MAX_LITERAL_WORDS", 3)
    assert [r.asDict() for r in lexicon.score_columns(df, lex, "t", "", cut, ("i",)).orderBy("i").collect()] == want


def test_every_word_of_a_large_lexicon_is_found(spark):
    words = [f"W{i:05d}" for i in range(5000)]
    table = {w: ["negative"] for w in words}
    df = spark.createDataFrame([([*words, "OTHER"],)], "t array<string>")
    assert df.select(lexicon.score("t", table).alias("s")).first()["s"]["negative_count"] == 5000


def test_spellings_of_categories(spark):
    lex = spark.createDataFrame([("MUST", "StrongModal"), ("COULD", "weak modal"), ("MAY", "Weak_Modal")], "word string, category string")
    assert lexicon.categories_of(lex) == {"MUST": ["strong_modal"], "COULD": ["weak_modal"], "MAY": ["weak_modal"]}
    got = lexicon.score_columns(spark.createDataFrame([("must could may",)], "t string"), lex, "t", "", lambda c: F.split(c, " ")).first()
    assert (got["strong_modal_count"], got["weak_modal_count"]) == (1, 2)
