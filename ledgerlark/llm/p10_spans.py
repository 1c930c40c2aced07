"""Problem 10: long exact spans shared between documents, by content-defined chunking with a gear rolling hash.

The gear hash at a place depends on the last 32 characters only. A place is a cut when its hash is the least of some
window of WINDOW places, so cuts follow the content, shift with insertions, and no two are further apart than WINDOW.
A chunk runs from a cut to the first cut at least CHUNK characters on. Any span of SPAN characters holds a whole chunk,
because 32 + WINDOW + CHUNK + WINDOW <= SPAN: equal spans can't be missed. Chunks are deduplicated by digest;
texts that share one are candidates, and an exact comparison of all SPAN-windows of both texts decides.

Work is done on distinct texts (exact copies only meet again at the end). A chunk in more than HOT texts (boilerplate
shorter than SPAN, say) isn't joined with itself: its texts are compared through hashes of all SPAN-windows around the
chunk, of which only those are joined that begin a shared run, so cost follows the occurrences and the true pairs.

Results: texts shorter than SPAN, empty and NULL share nothing. Rows without doc_id are left out. Of rows with the
same doc_id and different texts each text counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.llm import common

SPAN = 300
WINDOW = 80
CHUNK = SPAN - 32 - 2 * WINDOW
#: Texts that hold a chunk up to which all its pairs are candidates.
HOT = 64
BASE = 6364136223846793005


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    return x ^ (x >> np.uint32(13))


def gear(codes: np.ndarray) -> np.ndarray:
    """h[i] = sum of mix(codes[i-k]) << k over the last 32 characters, by doubling."""
    h = _mix(codes)
    for s in (1, 2, 4, 8, 16):
        h, old = h.copy(), h
        h[s:] += old[:-s] << np.uint32(s)
    return h


def cuts(text: str) -> np.ndarray:
    """Places of the cuts, in order; none in the first 31 characters, where the hash lacks its window."""
    n = len(text)
    if n < 32 + WINDOW:
        return np.zeros(0, dtype=np.int64)
    h = gear(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)  # the low bits hang on few characters
    key = (h.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    least, width = key[31:], 1
    while width < WINDOW:
        d = min(width, WINDOW - width)
        least, width = np.minimum(least[:-d], least[d:]), width + d
    return np.unique(np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)


def chunks(text: str) -> list[tuple[int, int, int]]:
    """(begin, end, digest) of each chunk."""
    at = cuts(text)
    ends = np.searchsorted(at, at + CHUNK)
    keep = ends < len(at)
    pairs = zip(at[keep].tolist(), at[ends[keep]].tolist())
    return [(b, e, xxhash.xxh3_64_intdigest(text[b:e].encode("utf-8", "surrogatepass")) - (1 << 63)) for b, e in pairs]


def span_hashes(text: str, span: int = SPAN) -> np.ndarray:
    """Hashes of all windows of `span` characters (polynomial modulo 2**64)."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(x) - span + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    x = (x ^ (x << np.uint64(21))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    power = np.ones(len(x), np.uint64)
    power[1:] = np.multiply.accumulate(np.full(len(x) - 1, BASE, np.uint64))
    inverse = np.ones(n, np.uint64)
    inverse[1:] = np.multiply.accumulate(np.full(n - 1, pow(BASE, -1, 1 << 64), np.uint64))
    total = np.zeros(len(x) + 1, np.uint64)
    total[1:] = np.cumsum(x * power, dtype=np.uint64)
    return ((total[span:] - total[:-span]) * inverse).view(np.int64)


def _chunk_rows(it):
    """(digest, u) of each chunk, once for each distinct text of the task."""
    seen: set[int] = set()
    for pdf in it:
        digests, owners = [], []
        for u, t in zip(pdf["u"], pdf["text"]):
            if u in seen:
                continue
            seen.add(u)
            own = {d for _, _, d in chunks(t)}
            digests += own
            owners += [u] * len(own)
        yield pd.DataFrame({"digest": pd.Series(digests, dtype="int64"), "u": pd.Series(owners, dtype="int64")})


def _hot_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """(w, prev, u): hashes of the windows around hot chunks, and of the window one character before."""
    out = []
    for u, t, hot in zip(pdf["u"], pdf["text"], pdf["digests"]):
        hot, h, starts = set(hot), span_hashes(t), set()
        for b, e, d in chunks(t):
            if d in hot:
                starts.update(range(max(0, e - SPAN), min(b, len(h) - 1) + 1))
        alone = (u * 0x9E3779B97F4A7C15) % (1 << 64) - (1 << 63)  # no other text has it: a run may begin here
        best: dict[int, int] = {}
        for s in sorted(starts):
            best.setdefault(int(h[s]), int(h[s - 1]) if s - 1 in starts else alone)
        out += [(w, p, u) for w, p in best.items()]
    return pd.DataFrame(out, columns=["w", "prev", "u"])


def _intervals(marks: np.ndarray) -> list[tuple[int, int]]:
    """Union of [i, i + SPAN) over sorted starts."""
    breaks = np.flatnonzero(np.diff(marks) > SPAN)
    begins, ends = marks[np.r_[0, breaks + 1]], marks[np.r_[breaks, len(marks) - 1]] + SPAN
    return list(zip(begins.tolist(), ends.tolist()))


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs that do share a span, with the shared stretches of both texts."""
    out = []
    for ua, ub, a, b in zip(pdf["ua"], pdf["ub"], pdf["text_a"], pdf["text_b"]):
        ha, hb = span_hashes(a), span_hashes(b)
        ia = np.flatnonzero(np.isin(ha, hb))
        if len(ia) and a[ia[0] : ia[0] + SPAN] in b:
            ib = np.flatnonzero(np.isin(hb, ha))
            out.append((ua, ub, [{"b": x, "e": y} for x, y in _intervals(ia)], [{"b": x, "e": y} for x, y in _intervals(ib)]))
    return pd.DataFrame(out, columns=["ua", "ub", "in_a", "in_b"])


PAIRS = "ua long, ub long, in_a array<struct<b:long,e:long>>, in_b array<struct<b:long,e:long>>"


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, u, v, text) of the documents long enough; u and v are two hashes of the text."""
    rows = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= SPAN))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("u"), F.xxhash64(F.lit("v"), "text").alias("v"), "text")


def text_pairs(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs ua < ub of different texts that share a span, with the shared stretches."""
    found = rows.select("u", "text").mapInPandas(_chunk_rows, "digest long, u long").repartition("digest").dropDuplicates(["digest", "u"])
    several = found.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    shared = common.written(found.join(several, "digest"), "p10-shared")
    few, many = shared.where(F.col("n") <= hot), shared.where(F.col("n") > hot)
    a, b = few.alias("a"), few.alias("b")
    pairs = a.join(b, (F.col("a.digest") == F.col("b.digest")) & (F.col("a.u") < F.col("b.u"))).select(F.col("a.u").alias("ua"), F.col("b.u").alias("ub"))
    # one document for each text that is needed, so that copies don't move
    holders = rows.groupBy("u").agg(F.min("doc_id").alias("doc_id")).join(shared.select("u").distinct(), "u", "left_semi")
    held = rows.select("doc_id", "u", "text").join(holders, ["doc_id", "u"]).select("u", "text").dropDuplicates(["u"])
    held = common.written(held, "p10-texts")
    around = held.join(many.groupBy("u").agg(F.collect_list("digest").alias("digests")), "u")
    w = common.batches(around.select("u", "text", "digests"), _hot_rows, "w long, prev long, u long").repartition("w")
    begins = w.groupBy("w").agg(F.min("prev").alias("x"), F.max("prev").alias("y")).where("x <> y").select("w")
    w = common.written(w.join(begins, "w"), "p10-hot")
    a, b = w.alias("a"), w.alias("b")
    run = (F.col("a.w") == F.col("b.w")) & (F.col("a.u") < F.col("b.u")) & (F.col("a.prev") != F.col("b.prev"))
    pairs = pairs.unionByName(a.join(b, run).select(F.col("a.u").alias("ua"), F.col("b.u").alias("ub"))).distinct()
    both = pairs.join(held.select(F.col("u").alias("ua"), F.col("text").alias("text_a")), "ua")
    both = both.join(held.select(F.col("u").alias("ub"), F.col("text").alias("text_b")), "ub")
    return common.batches(both.select("ua", "ub", "text_a", "text_b"), _compare, PAIRS)


def document_pairs(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id_a, doc_id_b), smaller id first, of documents that share a span of SPAN characters."""
    rows = texts(docs)
    members = common.written(rows.select("doc_id", "u", "v").distinct(), "p10-members")
    pairs = text_pairs(rows, hot).select("ua", "ub")
    a, b = members.select(F.col("doc_id").alias("x"), F.col("u").alias("ua")), members.select(F.col("doc_id").alias("y"), F.col("u").alias("ub"))
    cross = pairs.join(a, "ua").join(b, "ub").where("x <> y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
    several = members.groupBy("u", "v").agg(F.count("*").alias("n")).where("n > 1")
    same = members.join(several, ["u", "v"], "left_semi")
    a, b = same.alias("a"), same.alias("b")
    copies = a.join(b, (F.col("a.u") == F.col("b.u")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.doc_id") < F.col("b.doc_id")))
    return cross.unionByName(copies.select(F.col("a.doc_id").alias("doc_id_a"), F.col("b.doc_id").alias("doc_id_b"))).distinct()


def shared_share(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, chars, shared_chars, share) of each document of which a span, or a copy, lies elsewhere."""
    rows = texts(docs)
    pairs = common.written(text_pairs(rows, hot), "p10-pairs")
    parts = pairs.select(F.col("ua").alias("u"), F.explode("in_a").alias("p")).unionByName(pairs.select(F.col("ub").alias("u"), F.explode("in_b").alias("p")))
    parts = parts.select("u", "p.b", "p.e").distinct()
    w = Window.partitionBy("u").orderBy("b", "e").rowsBetween(Window.unboundedPreceding, -1)
    reached = parts.withColumn("r", F.greatest("b", F.coalesce(F.max("e").over(w), F.lit(0))))
    part = reached.groupBy("u").agg(F.sum(F.greatest(F.col("e") - F.col("r"), F.lit(0))).alias("part"))
    members = rows.select("doc_id", "u", "v", F.length("text").cast("long").alias("chars"))
    copies = members.groupBy("u", "v").agg(F.count_distinct("doc_id").alias("copies"))
    out = members.join(copies, ["u", "v"]).join(part, "u", "left")
    out = out.withColumn("shared_chars", F.when(F.col("copies") > 1, F.col("chars")).otherwise(F.coalesce("part", F.lit(0))))
    out = out.where("shared_chars > 0").select("doc_id", "chars", "shared_chars", F.round(F.col("shared_chars") / F.col("chars"), 4).alias("share"))
    return out.distinct()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_pairs(common.table(spark, sf_dir, "documents"))


def p10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_share(common.table(spark, sf_dir, "documents"))


QUERIES = {"p10_found": p10_found, "p10_share": p10_share}
SQL = {
    "p10_found": """WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 300),
w AS (SELECT DISTINCT doc_id, md5(substring(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM d)),
s AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1), x AS (SELECT w.doc_id, h FROM w JOIN s USING (h))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p10_share": """WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 300),
w AS (SELECT doc_id, length(text) AS chars, i, md5(substring(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM d)),
s AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1), m AS (SELECT doc_id, chars, i FROM w JOIN s USING (h)),
c AS (SELECT doc_id, chars, least(300, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 300)) AS n FROM m)
SELECT doc_id, chars::BIGINT AS chars, sum(n)::BIGINT AS shared_chars, round(sum(n) / chars, 4) AS share FROM c GROUP BY doc_id, chars""",
}
