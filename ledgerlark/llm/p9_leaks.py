"""Problem 9: evaluation texts inside training documents, by greedy string tiling.

Seeds are windows of ``min_match`` words that a document and a test item share; their hashes are rolled over the word
numbers of a whole batch of documents (Karp-Rabin). Within each seeded pair the longest match of words not yet covered
is marked, again and again, until none of ``min_match`` words is left; the tiles give the share of the item that the
document holds, whatever the order of the passages.

The test items are the query set. While they stay under MAX_ITEM_WORDS words in all (counted first), each task gets
them and the documents are read once, without a shuffle; beyond that, the windows of both sides are joined by hash.

Results: a text without words holds nothing. Rows without doc_id or item_id are left out. Repeated rows count once."""

from __future__ import annotations

from collections import defaultdict
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import common, forms

#: Words in a row that make a leak.
MIN_WORDS = 12
#: Shortest tile that counts for the coverage of an item.
MIN_TILE = 8
#: Share of an item's words in tiles from which the whole item counts as leaked.
COVERAGE = 0.5
#: Words of all items together up to which every task may hold them (about 100 bytes a word).
MAX_ITEM_WORDS = 300_000

BASE = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all windows of k numbers."""
    if len(ids) < k:
        return np.zeros(0, dtype=np.uint64)
    x = ids.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    n = len(x) - k + 1
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = h * BASE + x[i : i + n]
    return h


def tiles(doc: list, item: list, k: int, at: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(place in doc, place in item, length) of the longest non-overlapping common runs of at least k words.

    at: places in doc where a window may match; all by default."""
    by = defaultdict(list)
    for j in range(len(item) - k + 1):
        by[tuple(item[j : j + k])].append(j)
    used_d, used_i, out = bytearray(len(doc)), bytearray(len(item)), []
    seeds = [(i, j) for i in (range(len(doc) - k + 1) if at is None else at) for j in by.get(tuple(doc[i : i + k]), ())]
    here = set(seeds)
    runs = []
    for i, j in seeds:  # maximal runs: those that a seed begins
        if (i - 1, j - 1) in here:
            continue
        n = k
        while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
            n += 1
        runs.append((-n, i, j))
    heapify(runs)
    while runs:
        n, i, j = heappop(runs)
        n = -n
        cut = [p for p in range(n) if used_d[i + p] or used_i[j + p]]
        if not cut:
            out.append((i, j, n))
            used_d[i : i + n] = b"\1" * n
            used_i[j : j + n] = b"\1" * n
        else:  # what earlier tiles leave of the run
            edges = [-1, *cut, n]
            for a, b in zip(edges, edges[1:]):
                if b - a - 1 >= k:
                    heappush(runs, (a + 1 - b, i + a + 1, j + a + 1))
    return out


class Items:
    """The test items with the sorted hashes of their windows."""

    def __init__(self, rows: list[tuple[int, list[str]]], k: int) -> None:
        self.k, self.vocabulary = k, {}
        self.words = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws]) for i, ws in rows]
        pairs = [(h, n) for n, (_, ids) in enumerate(self.words) for h in window_hashes(np.array(ids, dtype=np.int64), k)]
        pairs.sort()
        self.hashes = np.array([h for h, _ in pairs], dtype=np.uint64)
        self.owner = np.array([n for _, n in pairs], dtype=np.int64)

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(row, item_id, words in tiles, longest tile, words of the item) for each document and item that share a seed."""
        get = self.vocabulary.get
        ids, starts = [], [0]
        for t in texts:
            if t:
                ids += [get(w, 0) for w in forms.words(t)]
            ids.append(0)  # ends every window
            starts.append(len(ids))
        x, k, out = np.array(ids, dtype=np.int64), self.k, []
        if len(x) < k or not len(self.hashes):
            return out
        known = np.convolve(x == 0, np.ones(k, dtype=np.int64), "valid") == 0
        at = np.flatnonzero(known)
        if not len(at):
            return out
        h = window_hashes(x, k)[at]
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        hit = hi > lo
        pairs: dict[tuple[int, int], list[int]] = defaultdict(list)
        rows = np.searchsorted(starts, at, "right") - 1
        for p, row, a, b in zip(at[hit], rows[hit], lo[hit], hi[hit]):
            for n in set(self.owner[a:b].tolist()):
                pairs[int(row), n].append(int(p) - starts[row])
        for (row, n), places in pairs.items():
            item_id, item = self.words[n]
            found = tiles(ids[starts[row] : starts[row + 1] - 1], item, k, places)
            if found:
                out.append((row, item_id, sum(f[2] for f in found), max(f[2] for f in found), len(item)))
        return out


OUT = "doc_id long, item_id long, covered long, longest long, item_words long"


def leaks(docs: DataFrame, items: DataFrame, min_match: int = MIN_WORDS, max_item_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """(doc_id, item_id, covered, longest, item_words) of each document and item that share min_match words in a row."""
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.size(F.split("text", r"[^\p{L}\p{N}]+"))).alias("n")).first()["n"] or 0
    if size <= max_item_words:
        held = spark.sparkContext.broadcast(Items([(r["item_id"], forms.words(r["text"])) for r in items.collect()], min_match))

        def search(pdf: pd.DataFrame) -> pd.DataFrame:
            ids = pdf["doc_id"].tolist()
            return pd.DataFrame([(ids[row], *rest) for row, *rest in held.value.search(pdf["text"].tolist())], columns=["doc_id", "item_id", "covered", "longest", "item_words"])

        rows = common.batches(docs, search, OUT)
    else:
        rows = _joined(docs, items, min_match)
    best = F.max(F.struct("longest", "covered", "item_words")).alias("b")
    return rows.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.covered", "b.longest", "b.item_words")


def _joined(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The same for a set of items of any size: windows of both sides are joined by hash, then the seeded pairs tiled."""

    def windows(name: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            for i, t in zip(pdf[name], pdf["text"]):
                ids = np.array([xxhash.xxh3_64_intdigest(w) >> 1 for w in forms.words(t)], dtype=np.int64)
                out += [(i, int(h)) for h in np.unique(window_hashes(ids, k).view(np.int64))]
            return pd.DataFrame(out, columns=[name, "h"])

        return run

    a = common.batches(docs, windows("doc_id"), "doc_id long, h long")
    b = common.batches(items, windows("item_id"), "item_id long, h long")
    pairs = a.join(b, "h").select("doc_id", "item_id").distinct()
    rows = pairs.join(docs, "doc_id").join(items.withColumnRenamed("text", "item"), "item_id")

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for d, i, text, item in zip(pdf["doc_id"], pdf["item_id"], pdf["text"], pdf["item"]):
            ws = forms.words(item)
            if found := tiles(forms.words(text), ws, k):
                out.append((d, i, sum(f[2] for f in found), max(f[2] for f in found), len(ws)))
        return pd.DataFrame(out, columns=["doc_id", "item_id", "covered", "longest", "item_words"])

    return common.batches(rows.select("doc_id", "item_id", "text", "item"), tile, OUT)


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "eval_items")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(*_tables(spark, sf_dir)).where(F.col("longest") >= MIN_WORDS).select("doc_id", "item_id")


def p9_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of an item each document holds in tiles of MIN_TILE words, in any order."""
    rows = leaks(*_tables(spark, sf_dir), min_match=MIN_TILE)
    rows = rows.withColumn("coverage", F.round(F.col("covered") / F.col("item_words"), 4))
    return rows.withColumn("leaked", F.col("coverage") >= COVERAGE)


QUERIES = {"p9_found": p9_found, "p9_coverage": p9_coverage}
_WINDOWS = """SELECT {k}, array_to_string(ws[i:i + 11], ' ') AS h FROM (SELECT {k}, ws, unnest(range(1, len(ws) - 10)) AS i FROM (
  SELECT {k}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM {t} WHERE {k} IS NOT NULL AND text IS NOT NULL) WHERE len(ws) >= 12)"""
SQL = {
    "p9_found": f"SELECT DISTINCT doc_id, item_id FROM ({_WINDOWS.format(k='doc_id', t='documents')}) JOIN ({_WINDOWS.format(k='item_id', t='eval_items')}) USING (h)",
}
