import pytest

from ledgerlark.operators import model

MAKE = model.word_list_scorer(frozenset(("gain", "rose")), frozenset(("loss", "fell")))


def failing():
    def score(sentences):
        if any("bad" in s for s in sentences):
            raise RuntimeError("no")
        return [{"label": "POSITIVE", "score": 0.9}] * len(sentences)

    return score


def test_failing_batch_is_neutral():
    got = model.safe_scores(failing(), ["a", "b", "bad", "c", "d"], 2)
    assert got == [("positive", 0.9)] * 2 + [("neutral", 0.0)] * 2 + [("positive", 0.9)]


def test_aggregate(spark):
    rows = [(1, "positive", 0.88), (1, "negative", 0.76), (1, "neutral", 0.92), (1, "positive", 0.65)]
    r = model.aggregate_scores(spark.createDataFrame(rows, "k int, label string, score double"), ["k"]).first()
    assert (r["positive_pct"], r["negative_pct"], r["neutral_pct"], r["avg_score"], r["net_sentiment"], r["n_sentences"]) == pytest.approx((0.5, 0.25, 0.25, 0.1925, 0.25, 4))
    a = spark.createDataFrame([([(x[1], x[2]) for x in rows],), ([],)], "s array<struct<label:string,score:double>>").select(model.aggregate_array("s").alias("m")).select("m.*").collect()
    assert tuple(a[0]) == pytest.approx((0.5, 0.25, 0.25, 0.1925, 0.25, 4)) and tuple(a[1]) == (0, 0, 0, 0, 0, 0)


def test_score_text_and_cache(spark):
    df = spark.createDataFrame([(1, "Profit rose on strong gain. It fell to a loss here."), (2, None), (3, "Profit rose on strong gain. It fell to a loss here.")], "i int, t string")
    got, fresh = model.batch_sentiment(df, ["i"], "t", MAKE)
    rows = {r["i"]: r for r in got.collect()}
    assert rows[1]["n_sentences"] == 2 and rows[1]["positive_pct"] == 0.5 and rows[2]["n_sentences"] == 0 and rows[3]["n_sentences"] == 2

    def broken():
        raise RuntimeError("never made")

    again, new = model.batch_sentiment(df, ["i"], "t", broken, fresh)
    assert new.count() == 0 and {tuple(r) for r in again.collect()} == {tuple(r) for r in got.collect()}


def test_sentences_past_the_splitters_limit_count(spark):
    df = spark.createDataFrame([(1, "Profit rose on strong gain " + "x" * 1_500_000 + ". It fell to a loss here.")], "i int, t string")
    r = model.batch_sentiment(df, ["i"], "t", MAKE)[0].first()
    assert (r["n_sentences"], r["positive_pct"], r["negative_pct"]) == (2, 0.5, 0.5)
    assert model.model_columns(df, ["i"], {"fb_": "t"}, MAKE).first()["fb_finbert_n_sentences"] == 2
    assert model.score_text(df, ["i"], "t", MAKE, cap=1_000_000).first()["n_sentences"] == 1
