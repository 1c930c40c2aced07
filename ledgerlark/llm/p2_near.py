"""Problem 2: near-duplicate sections with small edits, by min-max hashing.

A section's shingles are its different runs of SHINGLE words, taken from the form of problem 1 in lower case. Under each
of half as many permutations as the signature has values, both the least and the greatest hash are kept; these values
are cut into bands, texts that agree in a band are candidates, and an exact comparison of the shingle sets decides.
Before that, one byte of each of SKETCH values estimates the similarity, and pairs six standard errors under the
threshold are dropped, so that few shingle sets move.

Texts with the same form are one text throughout: their filings only meet again in the result.

Results: a section of fewer than SHINGLE words has no shingles and is similar to nothing. NULL and blank sections are
left out, as are rows without filing_id. Of a filing delivered several times the latest delivery counts."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.llm import common, forms, p1_lookalike, p7_garbled

SHINGLE = 3
THRESHOLD = 0.5
#: Chance that an edge of similarity s is missed: (1 - s**ROWS)**BANDS, 0.0003 at 0.6 and 1e-8 at 0.7.
BANDS, ROWS = 100, 5
SKETCH = 128
CHUNK = 2048
#: Texts of one band that a part of its self-join holds.
PART = 256


@lru_cache(4)
def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)


def shingles(words: list[str], k: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the different runs of k words."""
    if len(words) < k:
        return np.zeros(0, dtype=np.uint64)
    w = np.array([xxhash.xxh3_64_intdigest(x) for x in words], dtype=np.uint64)
    h = np.zeros(len(w) - k + 1, dtype=np.uint64)
    for i in range(k):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + w[i : i + len(h)]
    return np.unique(h)


def signature(sh: np.ndarray, values: int) -> np.ndarray:
    """The least and the greatest of each permutation, alternately: `values` numbers of 32 bits."""
    a, b = permutations(values // 2)
    low, high = np.full(values // 2, 0xFFFFFFFF, dtype=np.uint32), np.zeros(values // 2, dtype=np.uint32)
    x = (sh >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), CHUNK):  # long texts in blocks
        p = x[at : at + CHUNK, None] * a + b
        low, high = np.minimum(low, p.min(0)), np.maximum(high, p.max(0))
    return np.stack([low, high], 1).ravel()


def shingles_of_texts(texts: list[list[str]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted different shingles of each text, one after the other, and where each text begins (and the last ends)."""
    known: dict[str, int] = {}
    for w in set().union(*texts) if texts else ():
        known[w] = xxhash.xxh3_64_intdigest(w)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(size)
    w = np.fromiter((known[x] for t in texts for x in t), dtype=np.uint64, count=int(size.sum()))
    owner = np.repeat(np.arange(len(texts)), size)
    n = max(0, len(w) - k + 1)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
    inside = np.arange(n) + k <= ends[owner[:n]] if n else np.zeros(0, dtype=bool)  # not over the end of a text
    h, owner = h[inside], owner[:n][inside]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def signatures(h: np.ndarray, at: np.ndarray, values: int) -> np.ndarray:
    """The signature of each text that has shingles."""
    out = np.empty((len(at) - 1, values), np.uint32)
    for i in range(len(out)):
        out[i] = signature(h[at[i] : at[i + 1]], values)
    return out


def bands_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band of each signature."""
    x = sig[..., : bands * rows].reshape(*sig.shape[:-1], bands, rows).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.zeros(x.shape[:-1], np.uint64)
    for i in range(rows):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + x[..., i]
    return (h ^ (h >> np.uint64(32))).view(np.int64)


SIGNED = "filing_id long, loaded_at timestamp, section string, raw long, id long, twin long, n int, bands array<long>, sketch binary"


def signed(secs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Each section's form digest (id, twin: two halves, with the section), number of shingles, band hashes and sketch.

    The shingles themselves aren't kept: they are made again for the few texts that need an exact comparison."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [forms.skeleton(t) for t in batch.column("text").to_pylist()]
        digests = b"".join(xxhash.xxh3_128_digest(f"{s} {f}".encode("utf-8", "surrogatepass")) for s, f in zip(batch.column("section").to_pylist(), found))
        names = np.frombuffer(digests, np.int64).reshape(-1, 2)
        h, at = shingles_of_texts([forms.words(f) for f in found], shingle)
        n = np.diff(at)
        sig = signatures(h, at[np.r_[n > 0, True]], bands * rows)  # texts without shingles have no signature
        ends = np.cumsum(np.r_[0, (n > 0) * bands], dtype=np.int32)
        sketch = iter((sig[:, :SKETCH] & np.uint32(0xFF)).astype(np.uint8))
        cols = {c: batch.column(c) for c in batch.schema.names if c != "text"} | {"id": pa.array(names[:, 0]), "twin": pa.array(names[:, 1]), "n": pa.array(n.astype(np.int32))}
        cols |= {"bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(bands_of(sig, bands, rows).ravel())), "sketch": pa.array([next(sketch).tobytes() if k else b"" for k in n], pa.binary())}
        return pa.RecordBatch.from_pydict(cols)

    rows_ = secs.select("filing_id", "loaded_at", "section", F.xxhash64("text").alias("raw"), "text")
    return common.arrow_batches(rows_, run, SIGNED)


def _likely(threshold: float):
    least = threshold - 6 * (threshold * (1 - threshold) / SKETCH) ** 0.5

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.frombuffer(b"".join(pdf["sketch_a"]), np.uint8).reshape(-1, SKETCH)
        b = np.frombuffer(b"".join(pdf["sketch_b"]), np.uint8).reshape(-1, SKETCH)
        return pdf[(a == b).mean(1) >= least][["a", "b"]]

    return run


def _similar(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a, b, x, y in zip(pdf["a"], pdf["b"], pdf["set_a"], pdf["set_b"]):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            s = both / (len(x) + len(y) - both)
            if s >= threshold:
                out.append((a, b, s))
        return pd.DataFrame(out, columns=["a", "b", "similarity"])

    return run


def candidates(texts: DataFrame) -> DataFrame:
    """(a, b) with a < b of texts (id, bands) that agree in a band.

    Only rows whose band has others go on; a band of many texts is split into parts of PART on one side, each of which
    meets the whole band on the other, so no task holds a band's pairs alone."""
    rows = common.spread(texts.select("id", "bands"), "id").select("id", F.explode("bands").alias("band"))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("band"))).where("n > 1")
    rows = common.written(rows.withColumn("parts", F.ceil(F.col("n") / PART).cast("int")), "p2-bands")
    a = rows.select(F.col("id").alias("a"), "band", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    b = rows.select(F.col("id").alias("b"), "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return a.join(b.hint("merge"), ["band", "part"]).where("a < b").select("a", "b").distinct()


def text_pairs(texts: DataFrame, shingles_for: Callable[[DataFrame], DataFrame], threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity) of different texts (id, n, bands, sketch) at or over the threshold. Pass a written table.

    shingles_for: (id, shingles) of the texts of a frame (id)."""
    texts = texts.where("n > 0")

    def beside(df: DataFrame, other: DataFrame, what: str, name: str) -> DataFrame:
        x, y = (other.select(F.col("id").alias(k), F.col(what).alias(f"{name}_{k}")) for k in "ab")
        return df.join(x, "a").join(y, "b").select("a", "b", f"{name}_a", f"{name}_b")

    likely = common.batches(beside(candidates(texts), texts, "sketch", "sketch"), _likely(threshold), "a long, b long")
    likely = common.written(likely, "p2-likely")
    asked = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct()
    sets = common.written(shingles_for(asked), "p2-sets")
    return common.batches(beside(likely, sets, "shingles", "set"), _similar(threshold), "a long, b long, similarity double")


def near(secs: DataFrame, without: DataFrame | None = None, shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Members (filing_id, section, id) and similar texts (a, b, similarity). without: (filing_id, section) to leave out.

    Texts are told apart by 128 bits of their form and named by 64 of them: of two texts with one name, were there ever
    any, the one with the lesser other half is compared, and the members of both halves kept apart."""
    all_rows = common.written(signed(secs, shingle, bands, rows), "p2-signed")
    members = common.latest(all_rows.select("filing_id", "loaded_at", "section", "raw", "id", "twin"), ["filing_id", "section"], ["raw", "id", "twin"])
    if without is not None:
        members = members.join(without, ["filing_id", "section"], "left_anti")
    members = common.written(members, "p2-members")
    # one filing stands for each text
    stands = members.groupBy("id").agg(F.min(F.struct("twin", "filing_id", "section", "raw")).alias("s")).select("id", "s.*")
    stands = common.written(stands, "p2-stands")
    # copies are merged in each task first, so a text that a third of the rows hold is moved once a task
    texts = all_rows.select("id", "twin", "n", "bands", "sketch").dropDuplicates(["id", "twin"]).join(stands.select("id", "twin"), ["id", "twin"], "left_semi").drop("twin")

    def shingles_for(asked: DataFrame) -> DataFrame:
        where = stands.join(asked, "id").select("id", "filing_id", "section", "raw")
        rows_ = secs.select("filing_id", "section", F.xxhash64("text").alias("raw"), "text").join(where, ["filing_id", "section", "raw"]).select("id", "text")
        return common.batches(rows_, lambda pdf: pd.DataFrame({"id": pdf["id"], "shingles": [shingles(forms.words(forms.skeleton(t)), shingle).tobytes() for t in pdf["text"]]}), "id long, shingles binary").dropDuplicates(["id"])

    members = members.join(stands.select("id", "twin"), ["id", "twin"], "left_semi").select("filing_id", "section", "id")
    return members, text_pairs(common.written(texts, "p2-texts"), shingles_for, threshold)


def filing_pairs(secs: DataFrame, without: DataFrame | None = None) -> DataFrame:
    members, pairs = near(secs, without)
    pairs = common.written(pairs.select("a", "b"), "p2-pairs")
    asked = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    mine = common.written(members.join(asked, "id"), "p2-mine")
    x = common.join_salted(mine.select(F.col("filing_id").alias("x"), "section", F.col("id").alias("a")), pairs, "a", "x")
    rows = common.join_salted(x, mine.select(F.col("filing_id").alias("y"), F.col("id").alias("b")), "b", "x").where("x <> y")
    return rows.select(F.least("x", "y").alias("filing_id_a"), F.greatest("x", "y").alias("filing_id_b"), "section").distinct()


def _large_star(e: DataFrame) -> DataFrame:
    """Every greater neighbour of a text goes to the least of the text and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every lesser neighbour of a text, and the text, go to the least of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    rest = e.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> DataFrame:
    """(a, l): each text of the edges with the least text of its connected component.

    Large-star and small-star take turns on edges (u, v) with u > v until neither changes one, which is so when each
    component is a star; every turn keeps the components, and the rounds grow with the square of the logarithm at most."""
    content = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    star = common.written(edges.where("a > b").select(F.col("a").alias("u"), F.col("b").alias("v")), "p2-stars")
    now = content(star)
    while True:
        old, star = now, common.written(_small_star(_large_star(star)), "p2-stars")
        now = content(star)
        if now == old:
            break
    return star.select(F.col("u").alias("a"), F.col("v").alias("l")).unionByName(star.select(F.col("v").alias("a"), F.col("v").alias("l")).distinct())


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(filing_id, section, group_id, links): connected groups of similar texts, one row per section that has any.

    A group is named by its least filing."""
    edges = common.written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "p2-edges")
    links = edges.groupBy("a").agg(F.count("*").alias("links"))
    rows = common.join_salted(members.withColumnRenamed("id", "a"), _stars(edges).join(links, "a"), "a", "filing_id")
    rows = common.written(rows.select("filing_id", "section", "l", "links"), "p2-grouped")
    name = rows.groupBy("l").agg(F.min("filing_id").alias("group_id"))
    return common.join_salted(rows, name, "l", "filing_id").select("filing_id", "section", "group_id", "links")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filing_pairs(common.sections(common.table(spark, sf_dir, "filings_df")), p7_garbled.p7_found(spark, sf_dir))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups at the general setting: five words in a row and a similarity of 0.8."""
    return groups(*near(common.sections(common.table(spark, sf_dir, "filings_df")), None, shingle=5, threshold=0.8, bands=50, rows=8))


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
SQL = {
    "p2_groups": "WITH RECURSIVE " + p1_lookalike.sql_forms().removeprefix("WITH ") + """,
u AS (SELECT DISTINCT section, form, md5(section || form) AS id FROM t WHERE form <> ''), m AS (SELECT filing_id, section, md5(section || form) AS id FROM t WHERE form <> ''),
ws AS (SELECT id, section, regexp_extract_all(lower(form), '[\\p{L}\\p{N}]+') AS w FROM u),
sh AS (SELECT DISTINCT id, section, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT id, section, w, unnest(range(1, len(w) - 3)) AS i FROM ws WHERE len(w) >= 5)),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
b AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.section = y.section AND x.id <> y.id GROUP BY x.id, y.id),
e AS (SELECT a, b FROM b JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k / (x.n + y.n - k) >= 0.8),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
g AS (SELECT r.a AS id, min(m.filing_id) AS group_id FROM r JOIN m ON m.id = r.b GROUP BY r.a), l AS (SELECT a AS id, count(*) AS links FROM e GROUP BY a)
SELECT filing_id, section, group_id, links FROM m JOIN g USING (id) JOIN l USING (id)""",
}
