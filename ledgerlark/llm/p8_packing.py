"""Problem 8: documents, measured in tokens, in containers of fixed capacity.

Only the histogram of lengths decides how containers are filled, and it has at most ``capacity`` entries however many
documents there are: it is planned on the driver. Each pattern starts with the longest length left; single, pair and
triple sums of available lengths are looked up for an exact complement of the gap; where there is none the largest
length that fits goes in (best fit) and the lookup is repeated. A pattern is used as often as the counts allow at once,
so that each one exhausts a length and the number of patterns stays within a small multiple of the capacity. The items
of a length are then numbered in parallel (salted, so a hot length is split) and an item's number gives its container.

Results: a document over the capacity is cut into full pieces and a rest; others are never split. NULL and empty texts
have no tokens and no container (container_id NULL). Rows without doc_id are left out; of rows with the same doc_id the
one with most tokens counts."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.llm import common

CAPACITY = 2048
#: More than there are items of one length.
SHIFT = 1 << 48
VOCABULARY = "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, tokens) of each document."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        enc = _encoding(path or tokenizer_path())
        return pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]})

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.batches(rows, count, "doc_id long, tokens long").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


class Stock:
    """Counts of available lengths with lookups of exact complements."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.n = np.zeros(capacity + 1, dtype=np.int64)
        for length, c in counts.items():
            self.n[length] += c
        self.pairs = self._pairs()

    def take(self, lengths: np.ndarray, counts: np.ndarray) -> None:
        self.n[lengths] -= counts
        if not self.n[lengths].all():  # a length is used up, so some sums are gone
            self.pairs = self._pairs()

    def _pairs(self) -> np.ndarray:
        """Which sums two available lengths have, for all sums at once (one length may be counted twice here)."""
        there = np.fft.rfft((self.n > 0).astype(float), 2 * len(self.n))
        return np.fft.irfft(there * there, 2 * len(self.n))[: len(self.n)] > 0.5

    def pair(self, n: np.ndarray, gap: int) -> tuple[int, int] | None:
        """The pair with the largest first length that sums to the gap."""
        x = np.arange(gap - 1, (gap - 1) // 2, -1)  # x >= gap - x >= 1
        if not len(x):
            return None
        ok = (n[x] > 0) & (n[gap - x] > 0) & ((2 * x != gap) | (n[x] > 1))
        i = int(ok.argmax())
        return (int(x[i]), gap - int(x[i])) if ok[i] else None

    def complement(self, used: list[int], gap: int) -> list[int] | None:
        n = self.n.copy()
        for x in used:
            n[x] -= 1
        if n[gap] > 0:
            return [gap]
        if self.pairs[gap] and (p := self.pair(n, gap)):
            return list(p)
        z = np.arange(gap - 2, 0, -1)
        for z in z[(n[z] > 0) & self.pairs[gap - z]]:  # a pair fills what is left of the gap
            n[z] -= 1
            p = self.pair(n, gap - int(z))
            n[z] += 1
            if p:
                return [int(z), *p]
        return None

    def largest(self, used: list[int], most: int) -> int | None:
        n = self.n[: most + 1].copy()
        for x in used:
            if x <= most:
                n[x] -= 1
        fit = np.flatnonzero(n > 0)
        return int(fit[-1]) if len(fit) else None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how often each is used."""
    stock, out = Stock(counts, capacity), []
    while (first := stock.largest([], capacity)) is not None:
        used, gap = [first], capacity - first
        while gap:
            if more := stock.complement(used, gap):
                used += more
                break
            if (x := stock.largest(used, gap)) is None:
                break
            used.append(x)
            gap -= x
        lengths, need = np.unique(used, return_counts=True)
        times = int((stock.n[lengths] // need).min())
        stock.take(lengths, need * times)
        out.append((used, times))
    return out


def slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, lo, hi, each, first): items of a length numbered lo <= i < hi lie `each` to a container from `first` on."""
    rows, used, first = [], {}, 0
    for lengths, times in patterns:
        for x in sorted(set(lengths)):
            each = lengths.count(x)
            lo = used.get(x, 0)
            used[x] = lo + each * times
            rows.append((x, lo, used[x], each, first))
        first += times
    return rows


def pack(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, tokens, container_id) for (doc_id, tokens). ``counts`` is read three times: pass a written table."""
    spark = counts.sparkSession
    n = F.ceil(F.col("tokens") / capacity).cast("int")
    pieces = counts.where("tokens > 0").select("doc_id", F.col("tokens").alias("all_tokens"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(capacity), F.col("all_tokens") - F.col("piece").cast("long") * capacity).alias("tokens"))
    histogram = pieces.groupBy("tokens").count().collect()  # at most `capacity` rows
    rows = slots(plan({r["tokens"]: r["count"] for r in histogram}, capacity))
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("tokens", "salt").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("tokens", "salt", before.alias("start"))
    ranked = salted.withColumn("i", F.row_number().over(Window.partitionBy("tokens", "salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(starts, ["tokens", "salt"]).withColumn("i", F.col("i") + F.col("start"))
    # at most capacity lengths in a few times capacity patterns, whatever the number of documents
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    held = spark.sparkContext.broadcast(table)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        """The container of item i of its length, by binary search among the length's slots."""
        t, length, i = held.value, pdf["tokens"].to_numpy(), pdf["i"].to_numpy()
        at = np.searchsorted(t[:, 0] * SHIFT + t[:, 1], length * SHIFT + i, side="right") - 1
        return pdf[["doc_id", "piece", "tokens"]].assign(container_id=t[at, 4] + (i - t[at, 1]) // t[at, 3])

    placed = common.batches(ranked.select("doc_id", "piece", "tokens", "i"), place, "doc_id long, piece int, tokens long, container_id long")
    empty = counts.where("tokens = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("tokens"), F.lit(None).cast("long").alias("container_id"))
    return placed.unionByName(empty)


def assignment(spark: SparkSession, sf_dir: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(common.written(token_counts(common.table(spark, sf_dir, "documents")), "p8-tokens"), capacity)


def p8_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignment(spark, sf_dir)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that had to be split: those with a second piece in the assignment."""
    return assignment(spark, sf_dir).where("piece = 1 and container_id is not null").select("doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, the least possible number, and the share of their room that is unused."""
    rows = assignment(spark, sf_dir).where("container_id is not null").groupBy("container_id").agg(F.sum("tokens").alias("t"))
    rows = rows.agg(F.count("*").alias("containers"), F.ceil(F.sum("t") / CAPACITY).alias("least"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    return rows.withColumn("unused", F.round(1 - F.col("tokens") / (F.col("containers") * CAPACITY), 6))


QUERIES = {"p8_found": p8_found, "p8_assignment": p8_assignment, "p8_fill": p8_fill}
SQL: dict[str, str] = {}
