"""Statistics over the panel: quantile bins, event study, Newey-West, OLS with HAC errors, two-pass regressions.

Everything is a sum over rows: executors add up small matrices, and the driver solves a k by k system (k is the number
of regressors and quarter dummies). NaN is missing."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.config import DEFAULT
from ledgerlark.functions import tdist


def missing_to_null(c: str) -> Column:
    return F.nullif(F.col(c).cast("double"), F.lit(float("nan")))


def require(df: DataFrame, columns: list[str]) -> None:
    """P8."""
    if absent := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns not found: {absent}")


def complete(df: DataFrame, numeric: list[str], other: list[str] = ()) -> DataFrame:
    """The columns named, rows with all numeric ones; other columns stay as they are."""
    require(df, [*numeric, *other])
    return df.select(*[missing_to_null(c).alias(c) for c in numeric], *other).dropna(subset=list(numeric))


#: Rows up to which a quantile is taken from the values in one task; beyond, they are narrowed down first.
SMALL = 1_000_000
#: Accuracy of the approximate quantiles that narrow values down: ranks are within rows / ACCURACY.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Quantiles with linear interpolation, exact for any number of rows; [] without values.

    Up to SMALL rows the values are sorted in one task. Beyond, one pass of approximate quantiles gives two bounds around
    each wanted rank and one counts the rows below; what lies between (rows / ACCURACY or so) is narrowed down further
    until it is small or one value."""
    rows = df.select(missing_to_null(column).alias("v")).where("v is not null")
    n = rows.count()
    return [_at(rows, p * (n - 1), n) for p in shares] if n > SMALL else list(rows.agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).first()["q"] or [])


def _at(rows: DataFrame, position: float, n: int) -> float:
    """The value at a position between 0 and n - 1 of the n rows in order."""
    while n > SMALL:
        share, margin = position / (n - 1), 2 / ACCURACY
        low, high = rows.agg(F.percentile_approx("v", F.array(F.lit(max(0.0, share - margin)), F.lit(min(1.0, share + margin))), ACCURACY).alias("b")).first()["b"]
        below, among = rows.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
        if low == high:
            return low
        if not below <= position <= below + among - 1 or among >= n:
            raise ArithmeticError("the bounds miss the rank")
        rows, position, n = rows.where(F.col("v").between(low, high)), position - below, among
    return rows.agg(F.percentile("v", F.lit(position / max(1, n - 1))).alias("q")).first()["q"]


def edges(df: DataFrame, column: str, q: int) -> list[float]:
    """Least value, inner quantiles (linear interpolation), greatest value."""
    return exact_quantiles(df, column, [k / q for k in range(q + 1)])


def quantile_bin(df: DataFrame, column: str, q: int, name: str = "quantile", on_ties: str = "error") -> DataFrame:
    """Bins 1..q, (a, b] with the least value in the first; equal edges raise, or are merged with on_ties='merge'."""
    e = edges(df, column, q)
    if len(set(e)) < len(e) and on_ties == "error":
        raise ValueError("bin edges must be unique")
    inner = sorted(set(e))[1:-1] if on_ties == "merge" else e[1:-1]
    c = F.lit(len(inner) + 1)
    for k in range(len(inner), 0, -1):
        c = F.when(F.col(column) <= inner[k - 1], F.lit(k)).otherwise(c)
    return df.withColumn(name, F.when(F.col(column).isNotNull(), c))


def z_score(df: DataFrame, columns: list[str]) -> DataFrame:
    """Over the whole table, with ddof 1 and 1e-12 in the denominator."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    z = {c: (F.col(c) - F.col(f"_m_{c}")) / (F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) + 1e-12) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(z).drop(*stats.columns)


def z_score_within(df: DataFrame, columns: list[str], period: str) -> DataFrame:
    """Within each period, with ddof 0; a deviation under 1e-12 counts as 1."""
    stats = df.groupBy(period).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < 1e-12, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return df.join(stats, period).withColumns(z).drop(*[c for c in stats.columns if c != period])


def stars(p: Column) -> Column:
    """X6."""
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")


def newey_west(series: DataFrame, value: str, order: list[str], lags: int = DEFAULT.nw_lags) -> DataFrame:
    """One row (n, mean, se, t_stat) of a short series in order; NULL statistics under 3 values.

    Bartlett weights, no small-sample correction. The series has one value per period, so its order is one window."""
    rows = series.select(missing_to_null(value).alias("y"), *order).where("y is not null")
    rows = rows.crossJoin(F.broadcast(rows.agg(F.avg("y").alias("_m"), F.count("*").alias("_n")))).withColumn("u", F.col("y") - F.col("_m"))
    w = Window.orderBy(*order)
    rows = rows.select("y", "_n", "_m", "u", *[F.lag("u", k).over(w).alias(f"u{k}") for k in range(1, lags + 1)])
    s = F.sum(F.col("u") * F.col("u"))
    for k in range(1, lags + 1):
        s = s + 2.0 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("u") * F.col(f"u{k}")), F.lit(0.0))
    out = rows.agg(F.count("*").alias("n"), F.avg("y").alias("mean"), s.alias("s"))
    se = F.when((F.col("n") >= 3) & (F.col("s") > 0), F.sqrt(F.col("s")) / F.col("n"))
    return out.select("n", "mean", se.alias("se"), F.try_divide(F.col("mean"), se).alias("t_stat"))


def newey_west_array(y: np.ndarray, lags: int) -> tuple[float, float]:
    """(t, p) of a small array."""
    y = y[~np.isnan(y)]
    n = len(y)
    if n < 3:
        return math.nan, math.nan
    u = y - y.mean()
    s = float(u @ u) + 2 * sum((1 - k / (lags + 1)) * float(u[k:] @ u[:-k]) for k in range(1, min(lags, n - 1) + 1))
    if s <= 0:
        return math.nan, math.nan
    t = float(y.mean() / (math.sqrt(s) / n))
    return t, tdist.two_sided_p(t, n - 1)


def welch(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """R2 without quarters: (t_stat, df) of the means of two groups with unequal variances."""
    m = lambda g, f: f(F.when(F.col(group) == g, F.col(value)))
    row = df.agg(*[m(g, f).alias(f"{n}{i}") for i, g in enumerate((a, b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    va, vb = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    t = F.try_divide(F.col("m0") - F.col("m1"), F.sqrt(va + vb))
    dof = F.try_divide((va + vb) * (va + vb), va * va / (F.col("n0") - 1) + vb * vb / (F.col("n1") - 1))
    return row.select(t.alias("t_stat"), dof.alias("df"))


def quantile_means(df: DataFrame, signal: str, outcome: str, q: int = DEFAULT.quantiles, on_ties: str = "error") -> DataFrame:
    """A4: (quantile, mean_return, n)."""
    rows = quantile_bin(complete(df, [signal, outcome]), signal, q, on_ties=on_ties)
    return rows.groupBy("quantile").agg(F.avg(outcome).alias("mean_return"), F.count(outcome).alias("n"))


def spread_series(df: DataFrame, signal: str, outcome: str, q: int = DEFAULT.quantiles, period: str = "filing_quarter", on_ties: str = "error") -> DataFrame:
    """(period, spread) of the top less the bottom group, for periods that have both."""
    rows = quantile_bin(complete(df, [signal, outcome], [period]).where(F.col(period).isNotNull()), signal, q, on_ties=on_ties)
    rows = rows.groupBy(period).agg(F.avg(F.when(F.col("quantile") == q, F.col(outcome))).alias("_t"), F.avg(F.when(F.col("quantile") == 1, F.col(outcome))).alias("_b"))
    return rows.select(period, (F.col("_t") - F.col("_b")).alias("spread")).where("spread is not null")


@dataclass(frozen=True)
class EventStudy:
    quantile_means: list[float]
    quantile_counts: list[int]
    spread: float
    t_stat: float
    p_value: float
    sentiment_column: str
    return_column: str
    n_quantiles: int


def event_study(df: DataFrame, signal: str, outcome: str, q: int = DEFAULT.quantiles, lags: int = DEFAULT.nw_lags, on_ties: str = "error") -> EventStudy:
    """R2: means and counts of the outcome by quantile of the signal, spread, and its test (quarters, else Welch)."""
    rows = complete(df, [signal, outcome])
    if rows.count() < q * 5:
        return EventStudy([], [], math.nan, math.nan, math.nan, signal, outcome, q)
    binned = quantile_bin(rows, signal, q, on_ties=on_ties)
    by = binned.groupBy("quantile").agg(F.avg(outcome).alias("m"), F.count(outcome).alias("n")).orderBy("quantile").collect()  # q rows
    means, counts = [r["m"] for r in by], [r["n"] for r in by]
    t = p = spread = math.nan
    if len(means) >= 2:
        spread = means[-1] - means[0]
        if "filing_quarter" in df.columns:
            r = newey_west(spread_series(df, signal, outcome, q, on_ties=on_ties), "spread", ["filing_quarter"], lags).first()
            if r["t_stat"] is not None:
                t, p = r["t_stat"], tdist.two_sided_p(r["t_stat"], r["n"] - 1)
        else:
            r = welch(binned, outcome, "quantile", by[-1]["quantile"], by[0]["quantile"]).first()
            if r["t_stat"] is not None:
                t, p = r["t_stat"], tdist.two_sided_p(r["t_stat"], r["df"])
    return EventStudy(means, counts, spread, t, p, signal, outcome, q)


def ols(df: DataFrame, y: str, x: list[str], controls: list[str] | None = None, quarter_fe: bool = True, lags: int = DEFAULT.nw_lags, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(term, coef, std_err, t, p, ci_low, ci_high) and (n, k, r_squared, df_resid).

    Regressors are standardised, quarters after the first are dummies (W11; a missing quarter has all 0), errors are HAC
    in the order of `order` (the panel's row order; a row number over it is the only global sort). Rows are numbered by
    their sorted partition, so no single task sees all of them; X'X, X'y and the lagged products are added up in
    partial matrices on the executors."""
    xs = x + (controls or [])
    order = order or [c for c in ("ticker", "filing_type", "filing_date") if c in df.columns]
    require(df, [y, *xs])
    quarter = ["filing_quarter"] if quarter_fe and "filing_quarter" in df.columns else []
    extra = [c for c in dict.fromkeys([*order, *quarter]) if c not in (y, *xs)]
    rows = complete(df, [y, *xs], extra).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fitted(rows, y, xs, quarter, lags, order, extra)
    finally:
        rows.unpersist()


def quarter_dummies(df: DataFrame, column: str = "filing_quarter") -> dict[str, Column]:
    """A 0/1 column by name for each category in order but the first; a missing category has all 0.

    There are as many categories as the calendar has quarters."""
    found = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())
    return {f"q_{q}": F.when(F.col(column) == q, 1.0).otherwise(0.0) for q in found[1:]}


def _fitted(rows: DataFrame, y: str, xs: list[str], quarter: list[str], lags: int, order: list[str], extra: list[str]) -> tuple[DataFrame, DataFrame]:
    spark = rows.sparkSession
    dummies = quarter_dummies(rows, quarter[0]) if quarter else {}
    moments = rows.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(xs) for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    n = moments["n"]
    if n < len(xs) + 10:
        raise ValueError(f"too few observations ({n}) for {len(xs)} regressors")
    terms = ["const", *xs, *dummies]
    k = len(terms)
    z = [(F.col(c) - F.lit(moments[f"m{i}"])) / F.lit((moments[f"s{i}"] or 0.0) + 1e-12) for i, c in enumerate(xs)]
    cells = [F.lit(1.0), *z, *dummies.values()]
    design = rows.select(*extra, F.array(*[c.cast("double") for c in cells]).alias("_x"), F.col(y).alias("_y"))

    def gram(it):
        a, b, yy, s = np.zeros((k, k)), np.zeros(k), 0.0, 0.0
        for pdf in it:
            X, Y = np.array(pdf["_x"].tolist()).reshape(-1, k), pdf["_y"].to_numpy()
            a, b, yy, s = a + X.T @ X, b + X.T @ Y, yy + Y @ Y, s + Y.sum()
        yield pd.DataFrame({"m": [[*a.ravel().tolist(), *b.tolist(), float(yy), float(s)]]})

    # one small array from each task, added up by position in one pass
    total = _sum_arrays(design.select("_x", "_y").mapInPandas(gram, "m array<double>"), "m", k * k + k + 2)
    A, b, tot = total[: k * k].reshape(k, k), total[k * k : k * k + k], {"yy": float(total[-2]), "s": float(total[-1])}
    inv = np.linalg.pinv(A)
    beta = inv @ b
    # HAC: products of a row's x u with those of the rows up to `lags` before it in the order
    bc = beta.tolist()
    resid = F.col("_y") - F.aggregate(F.zip_with("_x", F.array(*[F.lit(v) for v in bc]), lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    scored = design.withColumn("_u", resid)
    scored = scored.withColumn("_xu", F.transform("_x", lambda v: v * F.col("_u")))
    nulls_last = [F.col(c).asc_nulls_last() for c in order] or [F.monotonically_increasing_id()]
    ordered = scored.orderBy(*nulls_last).select("_xu", "_u", F.spark_partition_id().alias("_p"))

    def meat(it):
        """Products inside a sorted partition, with its first and last rows for the seams."""
        prev, head, acc, sse, part = np.zeros((0, k)), np.zeros((0, k)), np.zeros((lags + 1, k, k)), 0.0, None
        for pdf in it:
            if not len(pdf):
                continue
            part = int(pdf["_p"].iloc[0])
            G = np.array(pdf["_xu"].tolist()).reshape(-1, k)
            sse += float((pdf["_u"] ** 2).sum())
            head = np.vstack([head, G])[:lags] if len(head) < lags else head
            both = np.vstack([prev, G])
            for lag in range(lags + 1):
                hi = both[max(len(prev), lag) :]
                acc[lag] += hi.T @ both[max(len(prev), lag) - lag : len(both) - lag]
            prev = both[-lags:] if lags else both[:0]
        if part is not None:
            yield pd.DataFrame({"p": [part], "acc": [acc.ravel().tolist()], "head": [head.ravel().tolist()], "tail": [prev.ravel().tolist()], "sse": [sse]})

    seams = ordered.mapInPandas(meat, "p int, acc array<double>, head array<double>, tail array<double>, sse double").orderBy("p").collect()  # one row a task
    S, sse, tail = np.zeros((lags + 1, k, k)), 0.0, np.zeros((0, k))
    for r in seams:
        S += np.array(r["acc"]).reshape(lags + 1, k, k)
        sse += r["sse"]
        head = np.array(r["head"]).reshape(-1, k)
        both = np.vstack([tail, head])
        for lag in range(1, lags + 1):
            for i in range(len(tail), min(len(both), len(tail) + lag)):
                if i - lag >= 0:
                    S[lag] += np.outer(both[i], both[i - lag])
        own = np.array(r["tail"]).reshape(-1, k)
        tail = np.vstack([tail, own])[-lags:] if lags else tail
    M = S[0] + sum((1 - lag / (lags + 1)) * (S[lag] + S[lag].T) for lag in range(1, lags + 1))
    se = np.sqrt(np.maximum(np.diag(inv @ M @ inv), 0))
    dof = n - int(np.linalg.matrix_rank(A))
    t = np.divide(beta, se, out=np.full(k, np.nan), where=se > 0)
    half = tdist.quantile(0.975, dof) * se
    table = [(n_, float(c), float(s), float(v), tdist.two_sided_p(float(v), dof), float(c - h), float(c + h)) for n_, c, s, v, h in zip(terms, beta, se, t, half)]
    coefs = spark.createDataFrame(table, "term string, coef double, std_err double, t double, p double, ci_low double, ci_high double")
    sst = tot["yy"] - tot["s"] ** 2 / n
    fit = spark.createDataFrame([(n, k, 1 - sse / sst if sst > 0 else None, dof)], "n long, k long, r_squared double, df_resid long")
    return coefs, fit


def _sum_arrays(df: DataFrame, column: str, size: int) -> np.ndarray:
    rows = df.select(F.posexplode(column)).groupBy("pos").agg(F.sum("col").alias("v")).collect()  # one row a position
    out = np.zeros(size)
    for r in rows:
        out[r["pos"]] = r["v"]
    return out


def period_slopes(df: DataFrame, y: str, x: list[str], period: str = "filing_quarter", min_obs: int = 10) -> DataFrame:
    """R4, pass 1: (period, n, slopes) of each period with min_obs rows, regressors standardised within it.

    Each period is reduced to its sums of products, so a hot period is never in one task."""
    rows = complete(df, [y, *x], [period]).where(F.col(period).isNotNull())
    z = z_score_within(rows, x, period)
    v = [F.lit(1.0), *[F.col(c) for c in x], F.col(y)]
    k = len(x) + 1
    sums = [F.sum(v[i] * v[j]).alias(f"s{i}_{j}") for i in range(k + 1) for j in range(i, k + 1) if not (i == k and j == k)]
    sums = z.groupBy(period).agg(F.count("*").alias("n"), *sums).where(F.col("n") >= min_obs)

    def solve(it):
        for pdf in it:
            out = []
            for _, r in pdf.iterrows():
                A = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                b = np.array([r[f"s{i}_{k}"] for i in range(k)])
                out.append((r[period], int(r["n"]), (np.linalg.pinv(A, rcond=1e-12) @ b)[1:].tolist()))
            yield pd.DataFrame(out, columns=["period", "n", "slopes"])

    return sums.mapInPandas(solve, "period string, n long, slopes array<double>")


def fama_macbeth(df: DataFrame, y: str, x: list[str], period: str = "filing_quarter", lags: int = DEFAULT.nw_lags, min_obs: int = 10) -> DataFrame:
    """(variable, mean_coef, std_coef, t_stat, p_value, n_periods)."""
    slopes = period_slopes(df, y, x, period, min_obs)

    def second(pdf: pd.DataFrame) -> pd.DataFrame:  # one value a period
        b = pdf.sort_values("period")["slope"].to_numpy()
        t, p = newey_west_array(b, lags)
        std = round(float(np.std(b, ddof=1)), 6) if len(b) > 1 else None
        return pd.DataFrame([(pdf["variable"].iloc[0], round(float(b.mean()), 6), std, None if math.isnan(t) else round(t, 4), None if math.isnan(p) else round(p, 4), len(b))], columns=OUT)

    OUT = ["variable", "mean_coef", "std_coef", "t_stat", "p_value", "n_periods"]
    names = F.array(*[F.lit(c) for c in x])
    long = slopes.select("period", F.explode(F.arrays_zip(names.alias("variable"), F.col("slopes").alias("slope"))).alias("s")).select("period", "s.variable", "s.slope")
    return long.groupBy("variable").applyInPandas(second, "variable string, mean_coef double, std_coef double, t_stat double, p_value double, n_periods long")


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature_a, feature_b, corr) of all pairs over the rows that have both, in one pass."""
    there = [c for c in columns if c in df.columns]
    rows = df.select(*[missing_to_null(c).alias(c) for c in there])
    pairs = [(a, b) for i, a in enumerate(there) for b in there[i:]]
    one = rows.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, mean, median, std, min, max, p25, p75), exact quantiles, in one pass up to SMALL rows.

    Beyond, the quantiles are narrowed down column by column (``exact_quantiles``)."""
    rows = df.select(*[missing_to_null(c).alias(c) for c in columns])
    shares, names = (0.25, 0.5, 0.75), ["n", "mean", "std", "min", "max"]
    large = rows.count() > SMALL
    per = lambda c: [F.count(c), F.avg(c), F.stddev_samp(c), F.min(c), F.max(c)]
    aggs = [f.alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in zip(names, per(c))]
    if large:
        one = rows.agg(*aggs).withColumns({f"q_{i}": F.array(*[F.lit(v) for v in exact_quantiles(rows, c, list(shares))]) for i, c in enumerate(columns)})
    else:  # one buffer a column
        one = rows.agg(*aggs, *[F.percentile(c, F.array(*map(F.lit, shares))).alias(f"q_{i}") for i, c in enumerate(columns)])
    q = lambda i, k, n: F.try_element_at(F.col(f"q_{i}"), F.lit(k)).alias(n)
    cells = [F.struct(F.lit(c).alias("feature"), *[F.col(f"{n}_{i}").alias(n) for n in ("n", "mean")], q(i, 2, "median"), *[F.col(f"{n}_{i}").alias(n) for n in ("std", "min", "max")], q(i, 1, "p25"), q(i, 3, "p75")) for i, c in enumerate(columns)]
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, high, n) of equal bins from the least to the greatest value; the last bin is closed."""
    rows = df.select(missing_to_null(column).alias("v")).where("v is not null")
    lim = F.broadcast(rows.agg(F.min("v").alias("a"), F.max("v").alias("b")))
    w = F.when(F.col("b") > F.col("a"), F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * bins)).otherwise(0)
    counts = rows.crossJoin(lim).groupBy(F.least(w, F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    grid = lim.where("a is not null").select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("i"))
    step = (F.col("b") - F.col("a")) / bins
    grid = grid.select(F.col("i").cast("long").alias("bin"), (F.col("a") + F.col("i") * step).alias("low"), (F.col("a") + (F.col("i") + 1) * step).alias("high"))
    return grid.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def trend(df: DataFrame, x: str, y: str, points: int = 100, min_obs: int = 11) -> DataFrame:
    """(x, y) of the least-squares line at equally spaced points; none under min_obs rows."""
    rows = complete(df, [x, y])
    one = rows.agg(F.regr_slope(y, x).alias("m"), F.regr_intercept(y, x).alias("c"), F.min(x).alias("a"), F.max(x).alias("b"), F.count("*").alias("n")).where(F.col("n") >= min_obs)
    at = one.select("m", "c", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    at = at.withColumn("x", F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / (points - 1))
    return at.select("x", (F.col("m") * F.col("x") + F.col("c")).alias("y"))
