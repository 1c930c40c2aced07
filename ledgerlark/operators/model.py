"""Model sentiment (M1 to M8): batched scoring of sentences, aggregation, cached scoring of sections.

A scorer is made once in each Python worker by a factory; batches span documents. A failing batch scores neutral, 0."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.config import DEFAULT
from ledgerlark.functions import text

Scorer = Callable[[list[str]], list[dict]]
AGGREGATES = ("positive_pct", "negative_pct", "neutral_pct", "avg_score", "net_sentiment", "n_sentences")


def word_list_scorer(positive: frozenset[str], negative: frozenset[str]) -> Callable[[], Scorer]:
    """A deterministic stand-in for a model: the label by the words of either list, the score by their share."""

    def make() -> Scorer:
        def score(sentences: list[str]) -> list[dict]:
            out = []
            for s in sentences:
                words = s.lower().split()
                p, n = sum(w.strip(".,;:!?") in positive for w in words), sum(w.strip(".,;:!?") in negative for w in words)
                label = "positive" if p > n else "negative" if n > p else "neutral"
                out.append({"label": label, "score": round(0.5 + 0.5 * abs(p - n) / max(1, p + n), 6)})
            return out

        return score

    return make


def pipeline_scorer(path: str, batch: int = DEFAULT.model_batch, max_tokens: int = 512, device: int | str | None = None) -> Callable[[], Scorer]:
    """M1: a classification pipeline over a model in a local folder, loaded once in each worker; on GPU 0 where there is one.

    Needs the transformers package, which is imported on the worker only."""

    def make() -> Scorer:
        from transformers import pipeline

        where = device
        if where is None:
            try:
                import torch

                where = 0 if torch.cuda.is_available() else -1
            except ImportError:
                where = -1
        classify = pipeline("sentiment-analysis", model=path, tokenizer=path, device=where)
        return lambda sentences: classify(sentences, batch_size=batch, truncation=True, max_length=max_tokens)

    return make


def safe_scores(scorer: Scorer, sentences: list[str], batch: int) -> list[tuple[str, float]]:
    """M4: labels in lower case and scores, in order; every sentence of a failing batch is neutral, 0."""
    out: list[tuple[str, float]] = []
    for i in range(0, len(sentences), batch):
        part = sentences[i : i + batch]
        try:
            got = [(str(r["label"]).lower(), float(r["score"])) for r in scorer(part)]
            if len(got) != len(part):
                raise ValueError("a score for each sentence is needed")
        except Exception:
            got = [("neutral", 0.0)] * len(part)
        out += got
    return out


def score_sentences(rows: DataFrame, sentence: str, make: Callable[[], Scorer], batch: int = DEFAULT.model_batch) -> DataFrame:
    """M1, M4: adds label and score to rows of one sentence each."""

    @F.pandas_udf("label string, score double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = None  # made once a task, on the worker, if there is anything to score
        for s in parts:
            scorer = scorer or (make() if len(s) else None)
            yield pd.DataFrame(safe_scores(scorer, s.fillna("").tolist(), batch), columns=["label", "score"])

    return rows.withColumn("_s", run(F.col(sentence))).select("*", "_s.label", "_s.score").drop("_s")


def aggregate_scores(scored: DataFrame, keys: list[str]) -> DataFrame:
    """M5: shares of positive and negative, the rest neutral, signed mean, net, count by key."""
    sign = F.when(F.col("label") == "positive", F.col("score")).when(F.col("label") == "negative", -F.col("score")).otherwise(0.0)
    share = lambda k: F.avg((F.col("label") == k).cast("double"))
    return scored.groupBy(*keys).agg(
        share("positive").alias("positive_pct"), share("negative").alias("negative_pct"), (1.0 - share("positive") - share("negative")).alias("neutral_pct"),
        F.round(F.avg(sign), 6).alias("avg_score"), (share("positive") - share("negative")).alias("net_sentiment"), F.count("*").alias("n_sentences"),
    )


def aggregate_array(scores: Column | str) -> Column:
    """M5 inside a row: the same struct from an array of (sentence, label, score); zeros for an empty one."""
    s = F.col(scores) if isinstance(scores, str) else scores
    n = F.size(s)
    part = lambda k: F.coalesce(F.try_divide(F.size(F.filter(s, lambda x: x["label"] == k)).cast("double"), n.cast("double")), F.lit(0.0))
    sign = lambda x: F.when(x["label"] == "positive", x["score"]).when(x["label"] == "negative", -x["score"]).otherwise(0.0)
    total = F.aggregate(s, F.lit(0.0), lambda a, x: a + sign(x))
    pos, neg = part("positive"), part("negative")
    return F.struct(
        pos.alias("positive_pct"), neg.alias("negative_pct"), F.when(n == 0, F.lit(0.0)).otherwise(1.0 - pos - neg).alias("neutral_pct"),
        F.coalesce(F.round(F.try_divide(total, n.cast("double")), 6), F.lit(0.0)).alias("avg_score"), (pos - neg).alias("net_sentiment"), n.cast("long").alias("n_sentences"),
    )


def section_sentences(df: DataFrame, keys: list[str], text_col: str, cap: int | None = None) -> DataFrame:
    """(keys, pos, sentence) of a text column; of its first cap characters, if cap is given."""
    pieces = text.prepare_sentences(text.get_sentences(text_col, cap=cap))
    return df.select(*keys, F.posexplode(pieces).alias("pos", "sentence"))


def score_text(df: DataFrame, keys: list[str], text_col: str, make: Callable[[], Scorer], batch: int = DEFAULT.model_batch, cap: int | None = None) -> DataFrame:
    """M6: the aggregates of each row's text; a text without sentences has zeros."""
    scored = score_sentences(section_sentences(df, keys, text_col, cap), "sentence", make, batch)
    rows = df.select(*keys).distinct().join(aggregate_scores(scored, keys), keys, "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) if c == "n_sentences" else F.coalesce(c, F.lit(0.0)) for c in AGGREGATES})


def batch_sentiment(df: DataFrame, keys: list[str], text_col: str, make: Callable[[], Scorer], cache: DataFrame | None = None, model: str = "stand-in", batch: int = DEFAULT.model_batch) -> tuple[DataFrame, DataFrame]:
    """(aggregates by key, new cache rows). The cache is keyed by model and content, so a changed text is a miss.

    cache: (cache_key, six aggregates)."""
    rows = df.withColumn("cache_key", F.sha2(F.concat_ws("\x00", F.lit(model), text.text_of(text_col)), 256))
    todo = rows.select("cache_key", text_col).dropDuplicates(["cache_key"])
    if cache is not None:
        todo = todo.join(cache, "cache_key", "left_anti")
    fresh = score_text(todo, ["cache_key"], text_col, make, batch).select("cache_key", *AGGREGATES)
    known = fresh.unionByName(cache.select("cache_key", *AGGREGATES)) if cache is not None else fresh
    return rows.select(*keys, "cache_key").join(known, "cache_key", "left").drop("cache_key"), fresh


def model_columns(df: DataFrame, keys: list[str], columns: dict[str, str], make: Callable[[], Scorer]) -> DataFrame:
    """M8: adds fb_<section>_finbert_<aggregate> for each section {prefix: text column}."""
    for prefix, c in columns.items():
        got, _ = batch_sentiment(df, keys, c, make)
        df = df.join(got.withColumnsRenamed({a: f"{prefix}finbert_{a}" for a in AGGREGATES}), keys, "left")
    return df
