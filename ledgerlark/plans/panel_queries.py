"""Queries of the panel, report and statistics families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators import report, stats
from ledgerlark.plans import base, market_queries, oracles, panel, text_queries
from ledgerlark.plans.base import FILINGS, NUMERIC, PANEL, PRICES

COLUMNS = ("filing_id", "ticker", "filing_type", "filing_date", "event_date", "sector", "filing_year", "filing_quarter", *NUMERIC)
SIGNAL, OUTCOME = "lm_1a_net_sentiment", "abret_21d"
CONTROLS = ("stat_1a_fog_index", "trailing_vol_63d")
UP, DOWN = ("gains", "rose", "improved", "grew"), ("declined", "fell", "weak", "lost", "hurt")


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.panel(spark, sf_dir, *COLUMNS)


def _r(df: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(F.col(c) + F.lit(0.0), digits).alias(c) if t == "double" else c for c, t in df.dtypes if c not in keys])


def built_panel(spark: SparkSession, sf_dir: str, scorer=None) -> DataFrame:
    rows = base.filings(spark, sf_dir, "ticker", "filing_type", "filing_date", "word_count", "item_1a_text", "mda_text")
    return panel.build_feature_panel(rows, base.prices(spark, sf_dir), base.lexicon(spark, sf_dir), base.table(spark, sf_dir, "sector_map"), scorer)


def q_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ["filing_id", "sector", "filing_year", "filing_quarter", "event_date"]
    cols = ["stat_1a_word_count", "stat_1a_fog_index", "lm_1a_negative_pct", "lm_1a_net_sentiment", "lm_1a_total_words", "delta_stat_1a_word_count", "delta_lm_1a_net_sentiment", "abret_21d", "trailing_vol_63d", "forward_vol_63d"]
    return _r(built_panel(spark, sf_dir).select(*keep, *cols), keep, 8)


def q_panel_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2 with the stand-in scorer."""
    from ledgerlark.operators.model import word_list_scorer

    rows = built_panel(spark, sf_dir, word_list_scorer(frozenset(UP), frozenset(DOWN)))
    return _r(rows.select("filing_id", "fb_1a_finbert_net_sentiment", "fb_mda_finbert_net_sentiment", "fb_mda_finbert_n_sentences", "delta_fb_mda_finbert_net_sentiment"), ["filing_id", "fb_mda_finbert_n_sentences"], 8)


def q_sector_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sector_breakdown(_panel(spark, sf_dir), NUMERIC, digits=6)


def q_sector_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _panel(spark, sf_dir).groupBy("sector").agg(F.avg("lm_1a_net_sentiment").alias("net"), F.avg("abret_21d").alias("ret"))
    return _r(rows.orderBy("net"), ["sector"])


def q_quarter_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(report.quarter_means(_panel(spark, sf_dir), SIGNAL), ["quarter"])


def q_sentiment_and_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(report.sentiment_and_market(_panel(spark, sf_dir), SIGNAL, base.prices(spark, sf_dir)), ["quarter"])


def q_summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary_stats(_panel(spark, sf_dir))


def q_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(stats.summary(base.filings(spark, sf_dir, "word_count").where("word_count > 0"), ["word_count"]), ["feature", "n"])


def q_corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(stats.correlation(_panel(spark, sf_dir), list(report.CORRELATED)), ["feature_a", "feature_b"])


def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.coverage(base.filings(spark, sf_dir, "filing_type", "filing_date"))
    return rows.select("filing_year", F.col("10-K").alias("n_10k"), F.col("10-Q").alias("n_10q"))


def q_filings_per_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.filings_per_ticker(base.filings(spark, sf_dir, "ticker", "filing_type"), "10-K")


def q_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.date_range(base.filings(spark, sf_dir, "filing_date"))


def q_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.filings(spark, sf_dir, "item_1a_text", "mda_text").select(F.length("item_1a_text").alias("a"), F.length("mda_text").alias("m"))
    return _r(report.completeness(rows, {"item_1a": "a", "mda": "m"}), ["part", "complete"])


def q_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(report.kpis(_panel(spark, sf_dir), [SIGNAL, OUTCOME, "stat_1a_fog_index", "trailing_vol_63d"]), ["n"])


def q_distinct_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.distinct_values(_panel(spark, sf_dir), "sector")


def q_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(stats.histogram(_panel(spark, sf_dir), "stat_1a_fog_index", 40), ["bin", "n"])


def q_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10 and O4 for every ticker: the types and the years are set."""
    rows = report.dashboard_filter(_panel(spark, sf_dir), None, ["10-K", "10-Q"], 2018, 2023)
    return _r(report.history(rows, ["filing_id", SIGNAL, OUTCOME]), ["ticker", "filing_type", "filing_date", "filing_id"])


def q_quantile_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.quantile_means(_panel(spark, sf_dir), SIGNAL, OUTCOME, on_ties="merge").withColumn("quantile", F.col("quantile").cast("long"))
    return _r(rows, ["quantile", "n"])


def q_spread_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(stats.spread_series(_panel(spark, sf_dir), SIGNAL, OUTCOME, on_ties="merge"), ["filing_quarter"])


def q_event_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.event_study(_panel(spark, sf_dir), SIGNAL, OUTCOME, on_ties="merge")
    rows = spark.createDataFrame([(s.quantile_means[0], s.quantile_means[-1], s.spread, s.t_stat)], "low double, high double, spread double, t_stat double")
    return _r(rows, [])


def q_event_study_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _panel(spark, sf_dir)
    return _r(report.event_study_table(stats.event_study(df, SIGNAL, OUTCOME, on_ties="merge"), df), ["label", "n", "stars"])


def q_newey_west(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.quarter_means(_panel(spark, sf_dir), OUTCOME)
    return _r(stats.newey_west(rows, "avg_sentiment", ["quarter"]), ["n"])


def q_welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(stats.welch(_panel(spark, sf_dir), OUTCOME, "filing_type", "10-K", "10-Q"), [])


def q_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(stats.trend(_panel(spark, sf_dir), SIGNAL, OUTCOME), [])


def q_ols_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    coefs, fit = stats.ols(_panel(spark, sf_dir), OUTCOME, [SIGNAL], quarter_fe=False, order=["ticker", "filing_type", "filing_date", "panel_id"])
    return _r(coefs.crossJoin(fit).select("term", "coef", "n", "r_squared"), ["term", "n"])


def q_ols_hac(spark: SparkSession, sf_dir: str) -> DataFrame:
    coefs, _ = stats.ols(_panel(spark, sf_dir), OUTCOME, [SIGNAL], [*CONTROLS], order=["ticker", "filing_type", "filing_date", "panel_id"])
    return _r(coefs, ["term"])


def q_topk_coef(spark: SparkSession, sf_dir: str) -> DataFrame:
    coefs, _ = stats.ols(_panel(spark, sf_dir), OUTCOME, [SIGNAL], [*CONTROLS], order=["ticker", "filing_type", "filing_date", "panel_id"])
    return _r(report.top_coefficients(coefs), ["term", "stars"])


def q_period_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.period_slopes(_panel(spark, sf_dir), OUTCOME, [SIGNAL])
    return rows.select("period", "n", F.round(F.col("slopes")[0] + F.lit(0.0), 6).alias("slope"))


def q_fama_macbeth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.fama_macbeth(_panel(spark, sf_dir), OUTCOME, [SIGNAL]).select("variable", "mean_coef", "std_coef", "t_stat", "n_periods")


def q_fama_macbeth_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.fama_macbeth(_panel(spark, sf_dir), OUTCOME, [SIGNAL, *CONTROLS])


def q_z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _panel(spark, sf_dir).where("filing_quarter is not null").select("panel_id", "filing_quarter", SIGNAL, F.col(SIGNAL).alias("within"))
    rows = stats.z_score_within(stats.z_score(rows, [SIGNAL]), ["within"], "filing_quarter")
    return rows.select("panel_id", F.round(F.col(SIGNAL) + F.lit(0.0), 6).alias("z"), F.round(F.col("within") + F.lit(0.0), 6).alias("z_within"))


def q_quarter_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each dummy marks, the first category left out."""
    rows = _panel(spark, sf_dir)
    dummies = stats.quarter_dummies(rows)
    sums = rows.agg(*[F.sum(c).cast("long").alias(n) for n, c in dummies.items()])
    return sums.unpivot([], list(dummies), "dummy", "n") if dummies else spark.createDataFrame([], "dummy string, n long")


def q_vol_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete rows, and the limit of both axes."""
    rows = stats.complete(_panel(spark, sf_dir), ["trailing_vol_63d", "forward_vol_63d", SIGNAL])
    return _r(rows.agg(F.count("*").alias("n"), (F.max(F.greatest("trailing_vol_63d", "forward_vol_63d")) * 1.05).alias("axis_limit"), F.corr("trailing_vol_63d", "forward_vol_63d").alias("corr")), ["n"])


def q_text_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.filings(spark, sf_dir, "filing_type", "filing_date", "mda_text")
    rows = report.text_samples(rows, "mda_text", "filing_type", ["filing_date", "filing_id"])
    return rows.select("filing_type", "filing_id", F.length("mda_text").cast("long").alias("chars"))


def q_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.scatter(_panel(spark, sf_dir), SIGNAL, OUTCOME, "sector")
    return rows.groupBy("sector").agg(F.count("*").alias("n"), F.round(F.sum(SIGNAL), 6).alias("sum_x"), F.round(F.sum(OUTCOME), 6).alias("sum_y"))


def q_word_count_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist, mid = report.word_count_distribution(base.filings(spark, sf_dir, "word_count"), "word_count")
    return _r(hist.crossJoin(F.broadcast(mid)), ["bin", "n"])  # one row of median and mean


def q_ticker_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13 for all tickers: how many filings with a signal lie beside how many closes."""
    own, closes = report.sentiment_beside_price(_panel(spark, sf_dir), base.prices(spark, sf_dir), SIGNAL)
    closes = closes.groupBy("ticker").agg(F.count("*").alias("closes"), F.min("dt").alias("first"), F.max("dt").alias("last"))
    return own.groupBy("ticker").agg(F.count("*").alias("filings")).join(closes, "ticker", "left")


_Q3 = "quantile_cont({s}, 1/3.0) AS e1, quantile_cont({s}, 2/3.0) AS e2"
_C = f"c AS (SELECT {SIGNAL} AS s, {OUTCOME} AS r, filing_quarter FROM v WHERE {SIGNAL} IS NOT NULL AND {OUTCOME} IS NOT NULL)"
_BIN = "CASE WHEN s <= e1 THEN 1 WHEN s <= e2 THEN 2 ELSE 3 END"
_SPREAD = f"""{_C}, k AS (SELECT * FROM c WHERE filing_quarter IS NOT NULL), e AS (SELECT {_Q3.format(s='s')} FROM k),
b AS (SELECT filing_quarter, r, {_BIN} AS q FROM k, e),
sp AS (SELECT filing_quarter, avg(CASE WHEN q = 3 THEN r END) - avg(CASE WHEN q = 1 THEN r END) AS spread FROM b GROUP BY filing_quarter)"""


def _nw(source: str, value: str, order: str) -> str:
    lags = ", ".join(f"lag(u, {k}) OVER (ORDER BY o) AS u{k}" for k in range(1, 6))
    terms = " + ".join(f"2.0 * (1 - {k} / 6.0) * coalesce(sum(u * u{k}), 0)" for k in range(1, 6))
    return f"""y AS (SELECT {value} AS y, {order} AS o FROM {source} WHERE {value} IS NOT NULL), u AS (SELECT y, o, y - avg(y) OVER () AS u FROM y),
l AS (SELECT y, u, {lags} FROM u), nw AS (SELECT count(*) AS n, avg(y) AS mean, sqrt(sum(u * u) + {terms}) / count(*) AS se FROM l)"""


_SUMMARY = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max, "
    f"round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.75), 4) AS p75 FROM v" for c in NUMERIC
)
# of the fixed features those that the table has, spelled out apart from the operator's list
_THERE = ["lm_1a_net_sentiment", "stat_1a_fog_index", "abret_1d", "abret_5d", "abret_21d", "abret_63d", "forward_vol_63d"]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}) + 0.0, 6) AS corr FROM v" for i, a in enumerate(_THERE) for b in _THERE[i:])
_SLOPES = f"""{_C}, sl AS (SELECT filing_quarter AS period, count(*) AS n, regr_slope(r, s) * CASE WHEN stddev_pop(s) < 1e-12 THEN 1.0 ELSE stddev_pop(s) END AS slope
FROM c WHERE filing_quarter IS NOT NULL GROUP BY 1 HAVING count(*) >= 10)"""
_LX = text_queries._lex_sql("item_1a_text").replace(", 6)", ", 15)")

NAMES = (
    "q_panel q_panel_model q_sector_breakdown q_sector_compare q_quarter_mean q_sentiment_and_market q_summary_stats q_describe q_corr_matrix q_coverage q_filings_per_ticker q_date_range "
    "q_completeness q_kpis q_distinct_sectors q_hist q_dashboard q_quantile_means q_spread_series q_event_study q_event_study_table q_newey_west q_welch q_trend q_ols_single q_ols_hac "
    "q_topk_coef q_period_slopes q_fama_macbeth q_fama_macbeth_many q_z_scores q_quarter_dummies q_vol_scatter "
    "q_text_samples q_scatter q_word_count_distribution q_ticker_overview"
).split()
QUERIES = {n: globals()[n] for n in NAMES}
SQL = {
    "q_panel": f"""WITH {FILINGS}, {PRICES}, {market_queries._LR}, {market_queries._ER}, {_LX},
mk AS (SELECT dt, ticker, {market_queries._fwd('er', 'abret')}, {market_queries._VOL} FROM e {market_queries._FRAMES}{market_queries._BACK}),
ft AS (SELECT * FROM f WHERE length(coalesce(item_1a_text, '')) > 50 OR length(coalesce(mda_text, '')) > 50),
st AS (SELECT filing_id, len({text_queries._W1})::BIGINT AS wc, {text_queries._fog(text_queries._W1, text_queries._S1)} AS fog FROM ft),
j AS (SELECT ft.filing_id, ft.ticker, filing_date, wc, fog, negative_pct, net_sentiment, total_words,
  wc - lag(wc) OVER w AS dwc, net_sentiment - lag(net_sentiment) OVER w AS dnet,
  CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.ticker = ft.ticker) THEN (SELECT min(dt) FROM p WHERE p.dt >= ft.filing_date) END AS event_date
  FROM ft JOIN st USING (filing_id) JOIN l USING (filing_id) WINDOW w AS (PARTITION BY ft.ticker, ft.filing_type ORDER BY ft.filing_date ASC NULLS LAST, ft.filing_id)),
s AS (SELECT ticker, max(sector) AS sector FROM sector_map WHERE ticker IS NOT NULL GROUP BY ticker)
SELECT filing_id, coalesce(sector, 'Unknown') AS sector, year(filing_date) AS filing_year, coalesce(year(filing_date) || 'Q' || quarter(filing_date), 'NaT') AS filing_quarter, event_date,
  wc AS stat_1a_word_count, round(fog, 8) AS stat_1a_fog_index, round(negative_pct, 8) AS lm_1a_negative_pct, round(net_sentiment, 8) AS lm_1a_net_sentiment, total_words AS lm_1a_total_words,
  dwc AS delta_stat_1a_word_count, round(dnet + 0.0, 8) AS delta_lm_1a_net_sentiment, round(abret_21d, 8) AS abret_21d, round(trailing_vol_63d, 8) AS trailing_vol_63d, round(forward_vol_63d, 8) AS forward_vol_63d
FROM j LEFT JOIN s USING (ticker) LEFT JOIN mk ON mk.ticker = j.ticker AND mk.dt = j.event_date""",
    "q_sector_breakdown": f"WITH {PANEL} SELECT sector, {', '.join(f'round(avg({c}), 6) AS {c}' for c in NUMERIC)} FROM v GROUP BY sector",
    "q_sector_compare": f"WITH {PANEL} SELECT sector, round(avg(lm_1a_net_sentiment), 6) AS net, round(avg(abret_21d), 6) AS ret FROM v GROUP BY sector",
    "q_quarter_mean": f"WITH {PANEL} SELECT filing_quarter AS quarter, round(avg({SIGNAL}), 6) AS avg_sentiment FROM v WHERE filing_quarter IS NOT NULL GROUP BY 1",
    "q_sentiment_and_market": f"""WITH {PANEL}, {PRICES}, q AS (SELECT year(dt) || 'Q' || quarter(dt) AS quarter, arg_max(close, dt) AS c FROM p WHERE ticker = 'SPY' GROUP BY 1),
x AS (SELECT quarter, c / lag(c) OVER (ORDER BY quarter) - 1 AS r FROM q),
a AS (SELECT filing_quarter AS quarter, avg({SIGNAL}) AS s FROM v WHERE filing_quarter IS NOT NULL GROUP BY 1)
SELECT quarter, round(s, 6) AS avg_sentiment, round(r, 6) AS quarter_return FROM a LEFT JOIN x USING (quarter)""",
    "q_summary_stats": f"WITH {PANEL} {_SUMMARY}",
    "q_describe": f"""WITH {FILINGS} SELECT 'word_count' AS feature, count(*) AS n, round(avg(word_count), 6) AS mean, round(quantile_cont(word_count, 0.5), 6) AS median, round(stddev_samp(word_count), 6) AS std,
  min(word_count)::DOUBLE AS min, max(word_count)::DOUBLE AS max, round(quantile_cont(word_count, 0.25), 6) AS p25, round(quantile_cont(word_count, 0.75), 6) AS p75 FROM f WHERE word_count > 0""",
    "q_corr_matrix": f"WITH {PANEL} {_CORR}",
    "q_coverage": f"""WITH {FILINGS} SELECT year(filing_date) AS filing_year, count(*) FILTER (WHERE filing_type = '10-K') AS n_10k, count(*) FILTER (WHERE filing_type = '10-Q') AS n_10q
FROM f WHERE filing_date IS NOT NULL GROUP BY 1""",
    "q_filings_per_ticker": f"WITH {FILINGS} SELECT ticker, count(*) AS n FROM f WHERE filing_type = '10-K' GROUP BY ticker",
    "q_date_range": f"WITH {FILINGS} SELECT min(filing_date) AS first_date, max(filing_date) AS last_date, min(year(filing_date)) AS first_year, max(year(filing_date)) AS last_year FROM f",
    "q_completeness": f"""WITH {FILINGS} SELECT 'item_1a' AS part, count(*) FILTER (WHERE length(item_1a_text) > 50) AS complete, round(avg((coalesce(length(item_1a_text), 0) > 50)::INT), 6) AS share FROM f
UNION ALL SELECT 'mda', count(*) FILTER (WHERE length(mda_text) > 50), round(avg((coalesce(length(mda_text), 0) > 50)::INT), 6) FROM f""",
    "q_kpis": f"WITH {PANEL} SELECT count(*) AS n, {', '.join(f'round(avg({c}), 6) AS avg_{c}' for c in (SIGNAL, OUTCOME, 'stat_1a_fog_index', 'trailing_vol_63d'))} FROM v",
    "q_distinct_sectors": f"WITH {PANEL} SELECT DISTINCT sector FROM v WHERE sector IS NOT NULL",
    "q_hist": f"""WITH {PANEL}, x AS (SELECT stat_1a_fog_index AS y FROM v WHERE stat_1a_fog_index IS NOT NULL), m AS (SELECT min(y) AS a, max(y) AS b FROM x),
c AS (SELECT least(floor((y - a) / (b - a) * 40), 39)::BIGINT AS bin, count(*) AS n FROM x, m GROUP BY 1)
SELECT i AS bin, round(a + i * ((b - a) / 40), 6) AS low, round(a + (i + 1) * ((b - a) / 40), 6) AS high, coalesce(n, 0) AS n FROM range(40) r(i) CROSS JOIN m LEFT JOIN c ON c.bin = i""",
    "q_dashboard": f"""WITH {PANEL} SELECT ticker, filing_type, strftime(filing_date, '%Y-%m-%d') AS filing_date, filing_id, round({SIGNAL} + 0.0, 6) AS {SIGNAL}, round({OUTCOME} + 0.0, 6) AS {OUTCOME}
FROM v WHERE filing_type IN ('10-K', '10-Q') AND filing_year BETWEEN 2018 AND 2023""",
    "q_quantile_means": f"WITH {PANEL}, {_C}, e AS (SELECT {_Q3.format(s='s')} FROM c) SELECT {_BIN}::BIGINT AS quantile, round(avg(r), 6) AS mean_return, count(*) AS n FROM c, e GROUP BY 1",
    "q_spread_series": f"WITH {PANEL}, {_SPREAD} SELECT filing_quarter, round(spread + 0.0, 6) AS spread FROM sp WHERE spread IS NOT NULL",
    "q_event_study": f"""WITH {PANEL}, {_SPREAD}, {_nw('sp', 'spread', 'filing_quarter')}, e0 AS (SELECT {_Q3.format(s='s')} FROM c),
g AS (SELECT avg(CASE WHEN s <= e1 THEN r END) AS low, avg(CASE WHEN s > e2 THEN r END) AS high FROM c, e0)
SELECT round(low, 6) AS low, round(high, 6) AS high, round(high - low, 6) AS spread, round(mean / se, 6) AS t_stat FROM g, nw""",
    "q_newey_west": f"""WITH {PANEL}, a AS (SELECT filing_quarter AS quarter, avg({OUTCOME}) AS m FROM v WHERE filing_quarter IS NOT NULL GROUP BY 1), {_nw('a', 'm', 'quarter')}
SELECT n, round(mean, 6) AS mean, round(se, 6) AS se, round(mean / se, 6) AS t_stat FROM nw""",
    "q_welch": f"""WITH {PANEL}, a AS (SELECT filing_type AS k, count({OUTCOME}) AS n, avg({OUTCOME}) AS m, var_samp({OUTCOME}) AS s FROM v GROUP BY 1),
b AS (SELECT x.m - y.m AS d, x.s / x.n AS va, y.s / y.n AS vb, x.n AS na, y.n AS nb FROM a x, a y WHERE x.k = '10-K' AND y.k = '10-Q')
SELECT round(d / sqrt(va + vb), 6) AS t_stat, round((va + vb) * (va + vb) / (va * va / (na - 1) + vb * vb / (nb - 1)), 6) AS df FROM b""",
    "q_trend": f"""WITH {PANEL}, {_C}, l AS (SELECT regr_slope(r, s) AS m, regr_intercept(r, s) AS k, min(s) AS a, max(s) AS b FROM c)
SELECT round(a + (b - a) * i / 99 + 0.0, 6) AS x, round(m * (a + (b - a) * i / 99) + k, 6) AS y FROM l CROSS JOIN range(100) r(i)""",
    "q_ols_single": f"""WITH {PANEL}, {_C}, l AS (SELECT regr_slope(r, s) * stddev_samp(s) AS b, avg(r) AS a, count(*) AS n, regr_r2(r, s) AS r2 FROM c)
SELECT 'const' AS term, round(a + 0.0, 6) AS coef, n, round(r2 + 0.0, 6) AS r_squared FROM l UNION ALL SELECT '{SIGNAL}', round(b + 0.0, 6), n, round(r2 + 0.0, 6) FROM l""",
    "q_period_slopes": f"WITH {PANEL}, {_SLOPES} SELECT period, n, round(slope + 0.0, 6) AS slope FROM sl",
    "q_fama_macbeth": f"""WITH {PANEL}, {_SLOPES}, {_nw('sl', 'slope', 'period')}
SELECT '{SIGNAL}' AS variable, round(mean, 6) AS mean_coef, (SELECT round(stddev_samp(slope), 6) FROM sl) AS std_coef, round(mean / se, 4) AS t_stat, n AS n_periods FROM nw""",
    "q_z_scores": f"""WITH {PANEL}, x AS (SELECT panel_id, filing_quarter, {SIGNAL} AS s FROM v WHERE filing_quarter IS NOT NULL),
a AS (SELECT avg(s) AS m, stddev_samp(s) AS d FROM x), b AS (SELECT filing_quarter, avg(s) AS qm, stddev_pop(s) AS qd FROM x GROUP BY 1)
SELECT panel_id, round((s - m) / (d + 1e-12) + 0.0, 6) AS z, round((s - qm) / CASE WHEN qd < 1e-12 THEN 1.0 ELSE qd END + 0.0, 6) AS z_within FROM x JOIN b USING (filing_quarter) CROSS JOIN a""",
    "q_quarter_dummies": f"""WITH {PANEL}, a AS (SELECT 'q_' || filing_quarter AS dummy, count(*) AS n FROM v WHERE filing_quarter IS NOT NULL GROUP BY 1)
SELECT dummy, n FROM a WHERE dummy <> (SELECT min(dummy) FROM a)""",
    "q_vol_scatter": f"""WITH {PANEL} SELECT count(*) AS n, round(max(greatest(trailing_vol_63d, forward_vol_63d)) * 1.05, 6) AS axis_limit, round(corr(trailing_vol_63d, forward_vol_63d), 6) AS corr
FROM v WHERE trailing_vol_63d IS NOT NULL AND forward_vol_63d IS NOT NULL AND {SIGNAL} IS NOT NULL""",
    "q_text_samples": f"""WITH {FILINGS} SELECT filing_type, filing_id, length(mda_text)::BIGINT AS chars FROM (
  SELECT *, row_number() OVER (PARTITION BY filing_type ORDER BY coalesce(filing_date::VARCHAR, '~'), filing_id::VARCHAR) AS k FROM f WHERE length(mda_text) > 200) WHERE k = 1""",
    "q_scatter": f"WITH {PANEL} SELECT sector, count(*) AS n, round(sum({SIGNAL}), 6) AS sum_x, round(sum({OUTCOME}), 6) AS sum_y FROM v WHERE {SIGNAL} IS NOT NULL AND {OUTCOME} IS NOT NULL GROUP BY sector",
    "q_word_count_distribution": f"""WITH {FILINGS}, x AS (SELECT word_count::DOUBLE AS y FROM f WHERE word_count > 0), m AS (SELECT min(y) AS a, max(y) AS b, quantile_cont(y, 0.5) AS median, avg(y) AS mean FROM x),
c AS (SELECT least(floor((y - a) / (b - a) * 40), 39)::BIGINT AS bin, count(*) AS n FROM x, m GROUP BY 1)
SELECT i AS bin, round(a + i * ((b - a) / 40), 6) AS low, round(a + (i + 1) * ((b - a) / 40), 6) AS high, coalesce(n, 0) AS n, round(median, 6) AS median, round(mean, 6) AS mean
FROM range(40) r(i) CROSS JOIN m LEFT JOIN c ON c.bin = i""",
    "q_ticker_overview": f"""WITH {PANEL}, {PRICES}, o AS (SELECT ticker, count(*) AS filings FROM v WHERE {SIGNAL} IS NOT NULL AND ticker IS NOT NULL GROUP BY 1),
k AS (SELECT ticker, count(*) AS closes, min(dt) AS first, max(dt) AS last FROM p GROUP BY 1) SELECT * FROM o LEFT JOIN k USING (ticker)""",
    "q_ols_hac": oracles.ols_all(OUTCOME, (SIGNAL, *CONTROLS)),
    "q_topk_coef": oracles.ols_top(OUTCOME, (SIGNAL, *CONTROLS)),
    "q_fama_macbeth_many": oracles.fama_macbeth(OUTCOME, (SIGNAL, *CONTROLS)),
    "q_event_study_table": oracles.event_table(_C, _SPREAD, _nw("sp", "spread", "filing_quarter")),
    "q_panel_model": oracles.panel_model(text_queries._SENTENCES.format(c="item_1a_text"), text_queries._SENTENCES.format(c="mda_text"), UP, DOWN),
}
