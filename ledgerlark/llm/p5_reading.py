"""Problem 5: reading level by a familiar-word formula.

A word is familiar when at least FAMILIAR of the English sections hold it (document frequencies over the whole corpus;
the list has at most 1 / FAMILIAR times as many words as a section has different ones on average, so it is small
whatever the size of the corpus). A section's level rises with the share of its words outside that list and with its
average sentence length. The weights of the two, and the limits between bands, are fitted on labelled sections: at most
MAX_LABELS of them, those with the least hash. Everything is measured on the text as a reader sees it: without markup
(problem 3) and in the form of problem 1; names and numbers are no words of the formula.

Results: only English sections have a level (share of English function words). Without labels of two neighbouring bands
there is no limit between them and no section gets the higher one. NULL and blank sections, and rows without filing_id,
give nothing. Of a filing delivered several times the latest delivery counts."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import common, forms, markup
from ledgerlark.llm.p4_sentences import split

FAMILIAR = 0.2
MAX_LABELS = 5000
TOP_BAND = 4
#: Share of either band's labelled sections beyond the places between which a limit lies.
EDGE = 0.01
# English function words.
FUNCTION_WORDS = frozenset("the of and to our we with by that is are was they their its it which from this have has not at would".split())
LEAST_FUNCTION_SHARE = 0.1
LEAST_WORDS = 5
LETTERS = re.compile(r"[^\W\d_]+")


def visible(text: str) -> str:
    """The text as a reader sees it."""
    if markup.MAYBE.search(text):
        n, blocks = markup.parse(text)
        if n:
            text = markup.render([b for b in blocks if b.kind not in ("code", "formula")])
    return forms.folded(forms.shape(text))


def sentences(text: str) -> list[str]:
    """The sentences of a text; units without a terminator, such as headings, only count where there is nothing else."""
    ends = split(text)
    parts = [text[b:e].strip() for b, e in zip([0, *ends], ends)]
    return [x for x in parts if x.rstrip("\"'”’»)]")[-1:] in tuple(".?!…")] or parts


def measure(text: str) -> tuple[int, int, list[str], list[int]] | None:
    """(words, sentences, different common words, how often each) of an English text."""
    t = visible(text)
    words = LETTERS.findall(t)
    n = Counter(words)
    english = sum(c for w, c in n.items() if w.lower() in FUNCTION_WORDS)
    if len(words) < LEAST_WORDS or english < LEAST_FUNCTION_SHARE * len(words):
        return None
    whole = sentences(t)
    n = Counter(LETTERS.findall("\n".join(whole)))
    own = [w for w in n if w.islower()]
    return n.total(), len(whole), own, [n[w] for w in own]


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The figures of each section of a batch; those of other languages have none."""
    rows = [measure(t) or (None, None, None, None) for t in batch.column("text").to_pylist()]
    words, sents, own, times = zip(*rows)
    cols = {c: batch.column(c) for c in batch.schema.names if c != "text"}
    cols |= {"words": pa.array(words, pa.int64()), "sentences": pa.array(sents, pa.int64()), "own": pa.array(own, pa.list_(pa.string())), "times": pa.array(times, pa.list_(pa.int64()))}
    return pa.RecordBatch.from_pydict(cols)


MEASURED = "filing_id long, loaded_at timestamp, section string, words long, sentences long, own array<string>, times array<long>"


def measured(secs: DataFrame) -> DataFrame:
    """(filing_id, section, unfamiliar, length) of each section that is English in its latest delivery.

    Document frequencies are those of all deliveries; only figures are shuffled, not words."""
    rows = common.written(common.arrow_batches(secs, _measure, MEASURED), "p5-words")
    english = rows.where("words is not null")
    n = english.count()
    seen = english.select(F.explode("own").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    familiar = frozenset(r["word"] for r in seen.where(F.col("df") >= FAMILIAR * n).collect())  # bounded, see above

    def features(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for own, times in zip(pdf["own"], pdf["times"]):
            strange = sum(c for w, c in zip(own, times) if w not in familiar)
            out.append(strange / max(1, sum(times)))
        length = pdf["words"] / pdf["sentences"].clip(lower=1)
        return pdf[["filing_id", "loaded_at", "section"]].assign(english=True, unfamiliar=out, length=length)

    figures = common.batches(english, features, "filing_id long, loaded_at timestamp, section string, english boolean, unfamiliar double, length double")
    other = rows.where("words is null").select("filing_id", "loaded_at", "section", F.lit(False).alias("english"), F.lit(None).cast("double").alias("unfamiliar"), F.lit(None).cast("double").alias("length"))
    last = common.latest(figures.unionByName(other), ["filing_id", "section"], ["english", "unfamiliar", "length"])
    return last.where("english").drop("english")


def limit(low: np.ndarray, high: np.ndarray) -> float:
    """The score that parts two bands."""
    a, b = np.quantile(low, 1 - EDGE), np.quantile(high, EDGE)
    if a < b:
        return float((a + b) / 2)
    at = np.unique(np.concatenate([low, high]))
    errors = [(low >= t).mean() + (high < t).mean() for t in at]
    return float(np.median(at[np.array(errors) == min(errors)]))


def fit(sample: list[tuple[int, float, float]]) -> tuple[float, float, dict[int, float]]:
    """Weights of the unfamiliar share and the length, and the least score of each band, from (band, share, length).

    The weights are Fisher's direction between the two highest bands; a limit lies halfway between what EDGE of the lower
    band exceed and what EDGE of the upper band stay under; where these overlap, it is the one with the fewest errors."""
    x = {b: np.array([r[1:] for r in sample if r[0] == b]) for b in {r[0] for r in sample}}
    bands = sorted(x)
    pairs = [(a, b) for a, b in zip(bands, bands[1:]) if b == a + 1 and len(x[a]) > 1 and len(x[b]) > 1]
    if not pairs:
        return 15.79, 0.0496, {}
    a, b = pairs[-1]
    within = np.cov(x[a].T) + np.cov(x[b].T) + np.diag([1e-6, 1e-3])
    w = np.maximum(np.linalg.solve(within, x[b].mean(0) - x[a].mean(0)), 0)
    if not w.any():
        w = np.array([15.79, 0.0496])
    limits = {}
    for a, b in pairs:
        limits[b] = limit(x[a] @ w, x[b] @ w)
    return float(w[0]), float(w[1]), limits


def levels(filings: DataFrame, labels: DataFrame) -> DataFrame:
    """(filing_id, section, unfamiliar, length, score, band) of each English section."""
    rows = common.written(measured(common.sections(filings)), "p5-measured")
    labels = labels.where("reading_band is not null").groupBy("filing_id", "section").agg(F.max("reading_band").alias("band"))
    sample = rows.join(labels, ["filing_id", "section"]).orderBy(F.xxhash64("filing_id", "section"), "filing_id", "section").limit(MAX_LABELS)
    share, length, limits = fit([(r["band"], r["unfamiliar"], r["length"]) for r in sample.select("band", "unfamiliar", "length").collect()])
    score = F.col("unfamiliar") * share + F.col("length") * length
    band = F.lit(min(limits) - 1 if limits else None).cast("int")
    for b in sorted(limits):
        band = F.when(F.col("score") >= limits[b], F.lit(b)).otherwise(band)
    return rows.withColumn("score", score).withColumn("band", band)


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(common.table(spark, sf_dir, "filings_df"), common.table(spark, sf_dir, "reading_labels"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).where(F.col("band") == TOP_BAND).select("filing_id", "section")


def p5_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _levels(spark, sf_dir)
    return rows.select("filing_id", "section", *[F.round(c, 6).alias(c) for c in ("unfamiliar", "length", "score")], "band")


QUERIES = {"p5_found": p5_found, "p5_levels": p5_levels}
SQL: dict[str, str] = {}
