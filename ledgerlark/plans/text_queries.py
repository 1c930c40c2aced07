"""Queries of the scan, path, text and lexicon families."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.config import CATEGORIES, STOP_WORDS
from ledgerlark.functions import lexicon, text
from ledgerlark.operators import model, sections
from ledgerlark.plans import base, oracles
from ledgerlark.plans.base import FILINGS
from ledgerlark.sources import edgar, files

WS = "[ \\t\\n\\r\\f\\v]+"


def q_scan_filter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.filings(spark, sf_dir, "item_1a_text", "mda_text")
    rows = rows.where((F.length(text.text_of("item_1a_text")) > 50) | (F.length(text.text_of("mda_text")) > 50))
    return rows.select("filing_id", text.word_count("item_1a_text").alias("words_1a"), text.word_count("mda_text").alias("words_mda"))


def q_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.filings(spark, sf_dir, "item_1a_text").select("filing_id", text.text_stats("item_1a_text").alias("s")).select("filing_id", "s.*")


def q_fog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.filings(spark, sf_dir, "mda_text").select("filing_id", text.readability("mda_text").alias("fog_index"))


def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.filings(spark, sf_dir, "item_1a_text").withColumn("c", text.clean_text("item_1a_text"))
    return rows.select("filing_id", F.length("c").cast("long").alias("chars"), F.md5("c").alias("digest"))


def q_clean_text_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.filings(spark, sf_dir, "item_1a_text").withColumn("c", text.clean_text_exact("item_1a_text"))
    return rows.select("filing_id", F.length("c").cast("long").alias("chars"), F.md5("c").alias("digest"))


def q_tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.filings(spark, sf_dir, "mda_text").withColumn("t", text.tokenize("mda_text"))
    return rows.select("filing_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"))


def q_lexicon_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexicon.score_columns(base.filings(spark, sf_dir, "item_1a_text"), base.lexicon(spark, sf_dir), "item_1a_text", "")
    return rows.select("filing_id", *[F.round(c, 6).alias(c) if c.endswith("_pct") or c.startswith("net_") else F.col(c) for c in lexicon.metric_names()])


def q_lexicon_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.filings(spark, sf_dir, "item_1a_text").select("filing_id", text.tokenize("item_1a_text").alias("t"))
    rows = lexicon.count_by_join(rows, "filing_id", "t", base.lexicon(spark, sf_dir))
    return rows.select("filing_id", *[F.round(c, 6).alias(c) if c.endswith("_pct") or c.startswith("net_") else F.col(c) for c in lexicon.metric_names()])


def q_lexicon_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexicon.union_lexicons([base.lexicon(spark, sf_dir).select(F.upper("word").alias("word"), lexicon.category_name("category").alias("category"))])
    return rows.where("word is not null and category is not null").groupBy("category").agg(F.count("*").alias("words"))


def q_sector_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexicon.score_columns(base.filings(spark, sf_dir, "ticker", "mda_text"), base.lexicon(spark, sf_dir), "mda_text", "lm_mda_")
    one = base.table(spark, sf_dir, "sector_map").where("ticker is not null").groupBy("ticker").agg(F.max("sector").alias("sector"))
    rows = rows.drop("mda_text").join(one, "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    means = [F.round(F.avg(f"lm_mda_{m}"), 6).alias(f"avg_{m}") for m in ("negative_pct", "positive_pct", "uncertainty_pct", "net_sentiment")]
    return rows.groupBy("sector").agg(F.count("*").alias("filings"), *means)


def q_table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.filings(spark, sf_dir, "mda_text").withColumn("l", text.text_of("mda_text")).withColumn("lines", sections.lines("l"))
    kept = F.filter("lines", lambda x: ~sections.is_table_line(x))
    return rows.select("filing_id", F.size("lines").cast("long").alias("all_lines"), F.size(kept).cast("long").alias("kept_lines"), F.md5(F.array_join(kept, "\n")).alias("digest"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings as documents again: headers, sections and closing parts, by form."""
    rows = base.filings(spark, sf_dir, "ticker", "filing_type", "filing_date", "item_1a_text", "mda_text").where(F.col("filing_type").isin("10-K", "10-Q"))
    a, m = text.text_of("item_1a_text"), text.text_of("mda_text")
    k = F.concat(F.lit("COVER\nITEM 1A. RISK FACTORS\n"), a, F.lit("\nITEM 1B. UNRESOLVED\nnone\nItem 7. Management's Discussion\n"), m, F.lit("\nItem 8. Financial Statements\n1 2 3\n"))
    q = F.concat(F.lit("COVER\nItem 2. Management's Discussion\n"), m, F.lit("\nItem 3. Quantitative\nPart II Item 1A. Risk Factors\n"), a, F.lit("\nItem 2. Unregistered Sales\nnone\n"))
    return rows.select("filing_id", "ticker", "filing_type", "filing_date", "item_1a_text", "mda_text", F.when(F.col("filing_type") == "10-K", k).otherwise(q).alias("doc"))


def q_section_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).withColumn("l", sections.lines("doc"))

    def cut(name: str):
        out = F.lit("")
        for form, rule in sections.RULES.items():
            start, ends = rule[name]
            out = F.when(F.col("filing_type") == form, sections.extract_section(F.col("l"), sections.HEADERS[start], tuple(sections.HEADERS[e] for e in ends))).otherwise(out)
        return out

    return rows.select("filing_id", F.md5(cut("item_1a")).alias("digest_1a"), F.md5(cut("mda")).alias("digest_mda"))


def q_parse_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N12 from HTML and a path: rows as the directory reader gives them."""
    rows = _documents(spark, sf_dir)
    safe = F.replace(F.replace(F.col("doc"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    path = F.concat_ws("/", F.lit("file:/filings"), "ticker", "filing_type", F.concat(F.coalesce(F.date_format("filing_date", "yyyy-MM-dd"), F.lit("undated")), F.lit("_"), F.col("filing_id").cast("string"), F.lit(".htm")))
    raw = rows.select(path.alias("path"), F.concat(F.lit("<html><head><style>x</style></head><body><p>"), safe, F.lit("</p></body></html>")).alias("content"))
    return sections.parse_filings(raw).drop("item_1a_text", "mda_text")


def q_html_text_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.filings(spark, sf_dir, "item_1a_text")
    doc = F.concat(F.lit("<!-- c --><html><head><style>p { x }</style></head><body><p>"), text.text_of("item_1a_text"), F.lit("</p>A &amp; B<br/>&copy; 2020</body></html>"))
    t = sections.html_text_fast(doc)
    return rows.select("filing_id", F.length(t).cast("long").alias("chars"), F.md5(t).alias("digest"))


def q_html_text_dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1, N2 by the parser, on documents with nested noise around the escaped text."""
    safe = F.replace(F.replace(text.text_of("item_1a_text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    doc = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>T</title><style>p { x }</style></head><body><!-- c --><ix:header>a<ix:nonNumeric>b</ix:nonNumeric><p>c</p></ix:header><div><p>"),
        safe, F.lit("</p></div><b>A &amp; B</b><script>var a = '<p>';</script><p>&copy; 2020 &#169;</p></body></html>"),
    )
    rows = base.filings(spark, sf_dir, "item_1a_text").select("filing_id", sections.html_text(doc).alias("t"))
    return rows.select("filing_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("digest"))


def q_path_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = base.table(spark, sf_dir, "manifest").select("filepath").distinct()
    day = F.date_format(sections.infer_date("filepath"), "yyyy-MM-dd")
    return p.select("filepath", sections.infer_ticker("filepath").alias("ticker"), sections.infer_type("filepath").alias("filing_type"), day.alias("filing_date"))


def q_manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, K5, X11: the listed files as a manifest, with what counts as landed and the name of a cache entry."""
    rows = base.table(spark, sf_dir, "manifest").where(F.lower("filepath").rlike("\\.(html?|txt)$"))
    listed = rows.groupBy(F.col("filepath").alias("path")).agg((F.max("file_size_kb") * 1024).alias("length"))
    size = listed.select(F.col("path").alias("filepath"), F.coalesce(F.col("length") > edgar.LANDED_BYTES, F.lit(False)).alias("landed"))
    return files.manifest(listed).join(size, "filepath").select("ticker", "filing_type", "filepath", "file_size_kb", "landed", files.cache_name("filepath").alias("cache_name"))


def q_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.filings(spark, sf_dir, "mda_text").withColumn("s", text.get_sentences("mda_text", cap=None))
    return rows.select("filing_id", F.size("s").cast("long").alias("sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


def q_pack_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.filings(spark, sf_dir, "mda_text").withColumn("s", text.prepare_sentences(text.get_sentences("mda_text", cap=None), max_words=20))
    return rows.select("filing_id", F.posexplode("s").alias("pos", "part"))


def q_display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.filings(spark, sf_dir, "filing_type", "filing_date", "word_count", "item_1a_text")
    share = F.col("word_count") / 10000
    return rows.select("filing_id", text.label("filing_date", "filing_type").alias("label"), text.percent(share).alias("share"), F.md5(text.shorten("item_1a_text", 300)).alias("digest"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.filings(spark, sf_dir, "mda_text").select("filing_id", F.posexplode(text.get_sentences("mda_text", cap=None)).alias("pos", "sentence"))
    up, down = F.col("sentence").rlike("rose|increase|gains|grew"), F.col("sentence").rlike("declin|fall|weak|hurt|lost")
    label = F.when(up & ~down, "positive").when(down & ~up, "negative").otherwise("neutral")
    return rows.select("filing_id", "sentence", label.alias("label"), (F.pmod(F.length("sentence"), F.lit(100)) / 100).alias("score"))


def q_sentence_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.aggregate_scores(_labelled(spark, sf_dir), ["filing_id"])
    return rows.select("filing_id", *[F.round(F.col(c) + F.lit(0.0), 6).alias(c) for c in model.AGGREGATES[:-1]], "n_sentences")


def q_sentence_agg_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).groupBy("filing_id").agg(F.collect_list(F.struct("sentence", "label", "score")).alias("a"))
    rows = rows.select("filing_id", model.aggregate_array("a").alias("m")).select("filing_id", "m.*")
    return rows.select("filing_id", *[F.round(F.col(c) + F.lit(0.0), 6).alias(c) for c in model.AGGREGATES[:-1]], "n_sentences")


def scored_filings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Callable]:
    """The filings and the stand-in scorer made of the lexicon's words."""
    lex = lexicon.categories_of(base.lexicon(spark, sf_dir))
    pick = lambda k: frozenset(w.lower() for w, cs in lex.items() if k in cs)
    make = model.word_list_scorer(pick("positive"), pick("negative"))
    return base.filings(spark, sf_dir, "filing_type", "mda_text"), make


def rounded_scores(got: DataFrame) -> DataFrame:
    return got.select("filing_id", *[F.round(F.col(c) + F.lit(0.0), 6).alias(c) for c in model.AGGREGATES[:-1]], "n_sentences")


def q_model_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, make = scored_filings(spark, sf_dir)
    return rounded_scores(model.batch_sentiment(rows, ["filing_id"], "mda_text", make)[0])


def _landed_indexes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Landed JSON put together from the filings: a map (ticker, cik) and an index (cik, value) for each company."""
    rows = base.filings(spark, sf_dir, "ticker", "filing_type", "filing_date").where("filing_date is not null and ticker is not null")
    cik = rows.groupBy("ticker").agg(F.min("filing_id").alias("cik"))
    entry = F.struct(F.lower("ticker").alias("ticker"), F.col("cik").alias("cik_str"))
    landed_map = cik.select(F.to_json(F.create_map(F.lit("0"), entry)).alias("value"))
    one = F.struct(F.date_format("filing_date", "yyyy-MM-dd").alias("d"), F.col("filing_type").alias("f"), F.lpad(F.col("filing_id").cast("string"), 10, "0").alias("a"))
    # an index comes in pages of at most 1,000 filings, however many a company has
    by = rows.join(cik, "ticker").groupBy("cik", F.floor(F.col("filing_id") / 1000).alias("page")).agg(F.sort_array(F.collect_list(one)).alias("r"))
    recent = F.struct(F.col("r.f").alias("form"), F.col("r.d").alias("filingDate"), F.col("r.a").alias("accessionNumber"), F.transform("r", lambda x: F.concat(x["a"], F.lit(".htm"))).alias("primaryDocument"))
    return landed_map, by.select("cik", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("value"))


def q_submissions_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 to S3 on indexes put together from the filings table."""
    landed_map, landed = _landed_indexes(spark, sf_dir)
    got = edgar.select_filings(edgar.filing_rows(landed), "10-K", "2016-01-01", "2023-12-31").join(edgar.ticker_map(landed_map), "cik")
    url = edgar.document_url("https://host/data", F.col("cik"), F.col("accession"), F.col("document"))
    return got.select("ticker", "form", "day", url.alias("url"))


def q_cross_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be fetched of tickers times forms, files that are there left out."""
    landed_map, landed = _landed_indexes(spark, sf_dir)
    tickers = base.table(spark, sf_dir, "sector_map").select("ticker").where("ticker is not null")
    # a landed file has the day of the manifest's name and the number of the filing
    names = base.table(spark, sf_dir, "manifest").select(F.regexp_replace("filepath", "_(\\d{10})[^/.]*(\\.[^.]*)$", "_$1.htm").alias("path"), (F.col("file_size_kb") * 1024).alias("length"))
    return edgar.to_fetch(tickers, ("10-K", "10-Q"), edgar.ticker_map(landed_map), edgar.filing_rows(landed), names, "https://host/data", "filings")


_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_TOK = "list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{M}}]+'), lambda x: length(x) >= 2 AND NOT list_contains(" + _STOP.replace("{", "{{").replace("}", "}}") + ", x))"
_WORDS = "list_filter(regexp_split_to_array(coalesce({c}, ''), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')"
_SENT = "list_filter(regexp_split_to_array(coalesce({c}, ''), '[.!?]+'), lambda x: regexp_replace(x, '[ \\t\\n\\r\\f\\v]+', '', 'g') <> '')"
_HARD = "len(list_filter({w}, lambda x: greatest(1, len(regexp_extract_all(lower(x), '[aeiou]+'))) >= 3))"


def _fog(w: str, s: str) -> str:
    return f"CASE WHEN len({w}) < 10 OR len({s}) = 0 THEN 0.0 ELSE round(0.4 * (len({w}) / greatest(1, len({s})) + 100.0 * {_HARD.format(w=w)} / greatest(1, len({w}))), 4) END"


_PLAIN = "replace(replace(replace(replace(replace(w, 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"  # upper() of a ligature is letters


def _lex_sql(col: str, key: str = "filing_id") -> str:
    counts = ", ".join(f"coalesce(sum(CASE WHEN category = '{k}' THEN 1 ELSE 0 END), 0)::BIGINT AS {k}_count" for k in CATEGORIES)
    total = " + ".join(f"{k}_count" for k in CATEGORIES)
    pct = ", ".join(f"round(CASE WHEN n > 0 THEN {k}_count / n ELSE 0.0 END, 6) AS {k}_pct" for k in CATEGORIES)
    return f"""
t AS (SELECT {key}, {_TOK.format(c=col)} AS toks FROM f),
x AS (SELECT DISTINCT upper(word) AS word, regexp_replace(lower(category), '^(strong|weak)[ _-]?modal$', '\\1_modal') AS category FROM lexicon WHERE word IS NOT NULL AND category IS NOT NULL),
h AS (SELECT {key}, {counts} FROM (SELECT {key}, upper({_PLAIN}) AS word FROM (SELECT {key}, unnest(toks) AS w FROM t)) JOIN x USING (word) GROUP BY {key}),
m AS (SELECT t.{key}, len(toks)::BIGINT AS n, {", ".join(f"coalesce({k}_count, 0) AS {k}_count" for k in CATEGORIES)} FROM t LEFT JOIN h ON t.{key} = h.{key}),
l AS (SELECT {key}, {", ".join(f"{k}_count" for k in CATEGORIES)}, {pct},
  round(CASE WHEN n > 0 THEN (positive_count - negative_count) / n ELSE 0.0 END, 6) AS net_sentiment,
  round((positive_count - negative_count) / (positive_count + negative_count + 1), 6) AS net_sentiment_normalized,
  ({total})::BIGINT AS total_lm_words, n AS total_words FROM m)"""


_LINES = "list_filter(list_transform(regexp_split_to_array({c}, '\\r\\n|\\n|\\r'), lambda x: regexp_replace(x, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')), lambda x: x <> '')"
_SOLID = "regexp_replace(x, '[ \\t\\n\\r\\f\\v]', '', 'g')"
_TABLE = f"((length({_SOLID}) > 0 AND length(regexp_replace({_SOLID}, '[^0-9$%,.()\\-]', '', 'g')) / greatest(1, length({_SOLID})) > 0.6 AND length(x) < 120) OR regexp_matches(x, '(?:(?:\\$[ \\t\\n\\r\\f\\v]*[0-9,]+)|(?:[0-9,]+\\.[0-9]{{2}})){{2,}}'))"
_KEPT = "list_filter(" + _LINES + ", lambda x: NOT " + _TABLE.replace("{", "{{").replace("}", "}}") + ")"
_A, _B = "".join(a for a, _ in text._PAIRS), "".join(b for _, b in text._PAIRS)
_STRIP = "regexp_replace({c}, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')"
_SENTENCES = (
    "flatten(list_transform(list_filter(list_transform(string_split(regexp_replace(coalesce({c}, ''), '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(30), 'g'), chr(30)), lambda x: "
    + _STRIP.replace("{c}", "x") + "), lambda x: x <> ''), lambda x: CASE WHEN len(regexp_split_to_array(x, '[ \\t\\n\\r\\f\\v]+')) > 400 THEN list_filter(list_transform(regexp_split_to_array(x, '[;,]'), lambda y: "
    + _STRIP.replace("{c}", "y") + "), lambda y: y <> '') ELSE [x] END))"
)
_LABELLED = f"""s AS (SELECT filing_id, unnest({_SENTENCES.format(c='mda_text')}) AS sentence FROM f),
a AS (SELECT *, regexp_matches(sentence, 'rose|increase|gains|grew') AS up, regexp_matches(sentence, 'declin|fall|weak|hurt|lost') AS down FROM s),
b AS (SELECT filing_id, CASE WHEN up AND NOT down THEN 'positive' WHEN down AND NOT up THEN 'negative' ELSE 'neutral' END AS label, (length(sentence) % 100) / 100 AS score FROM a)"""
_AGG = f"WITH {FILINGS}, {_LABELLED} SELECT filing_id, " + (
    "round(avg((label = 'positive')::INT), 6) + 0.0 AS positive_pct, round(avg((label = 'negative')::INT), 6) + 0.0 AS negative_pct, "
    "round(1.0 - avg((label = 'positive')::INT) - avg((label = 'negative')::INT), 6) + 0.0 AS neutral_pct, "
    "round(avg(CASE label WHEN 'positive' THEN score WHEN 'negative' THEN -score ELSE 0.0 END), 6) + 0.0 AS avg_score, "
    "round(avg((label = 'positive')::INT) - avg((label = 'negative')::INT), 6) + 0.0 AS net_sentiment, count(*) AS n_sentences FROM b GROUP BY filing_id"
)
_FAST = "coalesce(item_1a_text, '')"
_HTML = f"'<!-- c --><html><head><style>p {{ x }}</style></head><body><p>' || {_FAST} || '</p>A &amp; B<br/>&copy; 2020</body></html>'"
_H = f"regexp_replace({_HTML}, '(?s)<!--.*?-->', '', 'g')"
for _t in sections.NOISE:
    _H = f"regexp_replace({_H}, '(?is)<{_t}\\b[^>]*>.*?</{_t}\\s*>', '', 'g')"
_H = f"regexp_replace({_H}, '(?s)<[^>]+>', chr(10), 'g')"
for _e, _v in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&amp;", "'&'")):
    _H = f"replace({_H}, '{_e}', {_v})"
_HTML_SQL = f"WITH {FILINGS}, h AS (SELECT filing_id, array_to_string({_LINES.replace('{c}', _H)}, chr(10)) AS t FROM f) SELECT filing_id, length(t)::BIGINT AS chars, md5(t) AS digest FROM h"

NAMES = (
    "q_scan_filter_text q_text_stats q_fog q_clean_text q_clean_text_exact q_tokenize_counts q_lexicon_scores q_lexicon_by_join q_lexicon_categories q_sector_sentiment q_table_lines "
    "q_section_extract q_parse_filings q_html_text_fast q_html_text_dom q_path_infer q_manifest_files q_sentences q_pack_clauses q_display_labels q_sentence_agg q_sentence_agg_array "
    "q_model_score q_submissions_json q_cross_plan"
).split()
QUERIES = {n: globals()[n] for n in NAMES}
_W1, _S1, _WM, _SM = (_WORDS.format(c="item_1a_text"), _SENT.format(c="item_1a_text"), _WORDS.format(c="mda_text"), _SENT.format(c="mda_text"))
_ALPHA = f"list_transform(list_filter({_W1}, lambda x: regexp_full_match(x, '\\p{{L}}+')), lambda x: lower(x))"
_LEX = f"WITH {FILINGS}, {_lex_sql('item_1a_text')} SELECT * FROM l"
SQL = {
    "q_scan_filter_text": f"WITH {FILINGS} SELECT filing_id, len({_W1})::BIGINT AS words_1a, len({_WM})::BIGINT AS words_mda FROM f WHERE length(coalesce(item_1a_text, '')) > 50 OR length(coalesce(mda_text, '')) > 50",
    "q_text_stats": f"""WITH {FILINGS} SELECT filing_id, len({_W1})::BIGINT AS word_count,
  CASE WHEN coalesce(item_1a_text, '') = '' THEN 0 ELSE greatest(1, len({_S1})) END::BIGINT AS sentence_count,
  CASE WHEN coalesce(item_1a_text, '') = '' THEN 0.0 ELSE round(len({_W1}) / greatest(1, len({_S1})), 2) END AS avg_sentence_length,
  {_fog(_W1, _S1)} AS fog_index, round(len(list_distinct({_ALPHA})) / greatest(1, len({_ALPHA})), 4) AS vocabulary_richness,
  length(coalesce(item_1a_text, ''))::BIGINT AS char_count FROM f""",
    "q_fog": f"WITH {FILINGS} SELECT filing_id, {_fog(_WM, _SM)} AS fog_index FROM f",
    "q_clean_text": f"""WITH {FILINGS},
a AS (SELECT filing_id, regexp_replace(translate(regexp_replace(coalesce(item_1a_text, ''), '<[^>]+>', ' ', 'g'), '{_A}', '{_B}'), '[^\\x00-\\x7F]', '', 'g') AS t FROM f),
b AS (SELECT filing_id, {_STRIP.format(c="regexp_replace(regexp_replace(lower(t), '[^a-z \\t\\n\\r\\f\\v.,]', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')")} AS c FROM a)
SELECT filing_id, length(c)::BIGINT AS chars, md5(c) AS digest FROM b""",
    "q_tokenize_counts": f"WITH {FILINGS}, t AS (SELECT filing_id, {_TOK.format(c='mda_text')} AS t FROM f) SELECT filing_id, len(t)::BIGINT AS tokens, len(list_distinct(t))::BIGINT AS distinct_tokens FROM t",
    "q_lexicon_scores": _LEX,
    "q_lexicon_by_join": _LEX,
    "q_lexicon_categories": "SELECT category, count(*) AS words FROM (SELECT DISTINCT upper(word) AS word, regexp_replace(lower(category), '^(strong|weak)[ _-]?modal$', '\\1_modal') AS category FROM lexicon WHERE word IS NOT NULL AND category IS NOT NULL) GROUP BY category",
    "q_sector_sentiment": f"""WITH {FILINGS}, {_lex_sql('mda_text').replace(', 6)', ', 15)')},
s AS (SELECT ticker, max(sector) AS sector FROM sector_map WHERE ticker IS NOT NULL GROUP BY ticker)
SELECT coalesce(sector, 'Unknown') AS sector, count(*) AS filings, round(avg(negative_pct), 6) AS avg_negative_pct, round(avg(positive_pct), 6) AS avg_positive_pct,
  round(avg(uncertainty_pct), 6) AS avg_uncertainty_pct, round(avg(net_sentiment), 6) AS avg_net_sentiment
FROM f JOIN l USING (filing_id) LEFT JOIN s USING (ticker) GROUP BY 1""",
    "q_table_lines": f"""WITH {FILINGS} SELECT filing_id, len({_LINES.format(c="coalesce(mda_text, '')")})::BIGINT AS all_lines, len({_KEPT.format(c="coalesce(mda_text, '')")})::BIGINT AS kept_lines,
  md5(array_to_string({_KEPT.format(c="coalesce(mda_text, '')")}, chr(10))) AS digest FROM f""",
    "q_section_extract": f"""WITH {FILINGS},
a AS (SELECT filing_id, filing_type, {_LINES.format(c="coalesce(item_1a_text, '')")} AS la, {_LINES.format(c="coalesce(mda_text, '')")} AS lm FROM f WHERE filing_type IN ('10-K', '10-Q')),
b AS (SELECT *, length(array_to_string(la, chr(10))) AS na, length(array_to_string(lm, chr(10))) AS nm,
  la || ['ITEM 1B. UNRESOLVED', 'none'] AS la2, ['Item 8. Financial Statements', '1 2 3'] AS k_rest, ['Item 2. Unregistered Sales', 'none'] AS q_rest FROM a),
c AS (SELECT filing_id,
  CASE WHEN na >= 200 THEN la WHEN filing_type = '10-Q' THEN la || q_rest WHEN length(array_to_string(la2, chr(10))) >= 200 THEN la2
    ELSE la2 || ['Item 7. Management''s Discussion'] || lm || k_rest END AS xa,
  CASE WHEN nm >= 200 THEN lm WHEN filing_type = '10-K' THEN lm || k_rest ELSE lm || ['Item 3. Quantitative', 'Part II Item 1A. Risk Factors'] || la || q_rest END AS xm FROM b),
d AS (SELECT filing_id, array_to_string(list_filter(xa, lambda x: NOT {_TABLE}), chr(10)) AS ta, array_to_string(list_filter(xm, lambda x: NOT {_TABLE}), chr(10)) AS tm FROM c)
SELECT filing_id, md5(CASE WHEN length(ta) >= 200 THEN ta ELSE '' END) AS digest_1a, md5(CASE WHEN length(tm) >= 200 THEN tm ELSE '' END) AS digest_mda FROM d""",
    "q_html_text_fast": _HTML_SQL,
    "q_path_infer": """SELECT DISTINCT filepath, upper(regexp_extract(filepath, '^(?:.*/)?([^/]+)/10-[KQ](?:/|$)', 1)) AS ticker,
  coalesce(nullif(regexp_extract(filepath, '(?:^|/)(10-[KQ])(?:/|$)', 1), ''), 'unknown') AS filing_type,
  strftime(try_cast(nullif(regexp_extract(filepath, '(?:^|/)(\\d{4}-\\d{2}-\\d{2})[^/]*$', 1), '') AS DATE), '%Y-%m-%d') AS filing_date FROM manifest""",
    "q_manifest_files": """SELECT upper(regexp_extract(filepath, '^(?:.*/)?([^/]+)/10-[KQ](?:/|$)', 1)) AS ticker, coalesce(nullif(regexp_extract(filepath, '(?:^|/)(10-[KQ])(?:/|$)', 1), ''), 'unknown') AS filing_type,
  filepath, round(max(file_size_kb), 1) AS file_size_kb, coalesce(max(file_size_kb) * 1024 > 1000, false) AS landed, regexp_replace(filepath, '[^\\w\\-]', '_', 'g') AS cache_name
FROM manifest WHERE regexp_matches(lower(filepath), '\\.(html?|txt)$') GROUP BY filepath""",
    "q_sentences": f"WITH {FILINGS}, s AS (SELECT filing_id, {_SENTENCES.format(c='mda_text')} AS s FROM f) SELECT filing_id, len(s)::BIGINT AS sentences, md5(array_to_string(s, '|')) AS digest FROM s",
    "q_display_labels": f"""WITH {FILINGS} SELECT filing_id, coalesce(strftime(filing_date, '%Y-%m-%d'), '?') || ' | ' || coalesce(filing_type, '?') AS label,
  coalesce(printf('%.2f%%', word_count / 10000 * 100), '—') AS share,
  md5(replace(CASE WHEN length(coalesce(item_1a_text, '')) > 300 THEN substring(item_1a_text, 1, 300) || '...' ELSE coalesce(item_1a_text, '') END, chr(10), '<br>')) AS digest FROM f""",
    "q_sentence_agg": _AGG,
    "q_sentence_agg_array": _AGG,
    "q_submissions_json": f"""WITH {FILINGS}, c AS (SELECT ticker, min(filing_id) AS cik FROM f WHERE filing_date IS NOT NULL AND ticker IS NOT NULL GROUP BY ticker)
SELECT ticker, filing_type AS form, strftime(filing_date, '%Y-%m-%d') AS day,
  'https://host/data/' || cik || '/' || lpad(filing_id::VARCHAR, 10, '0') || '/' || lpad(filing_id::VARCHAR, 10, '0') || '.htm' AS url
FROM f JOIN c USING (ticker) WHERE filing_type = '10-K' AND filing_date BETWEEN DATE '2016-01-01' AND DATE '2023-12-31'""",
    "q_cross_plan": f"""WITH {FILINGS}, c AS (SELECT ticker, min(filing_id) AS cik FROM f WHERE filing_date IS NOT NULL AND ticker IS NOT NULL GROUP BY ticker),
m AS (SELECT DISTINCT regexp_replace(filepath, '_(\\d{{10}})[^/.]*(\\.[^.]*)$', '_\\1.htm') AS path FROM manifest WHERE file_size_kb * 1024 > 1000),
x AS (SELECT DISTINCT ticker, filing_type, 'https://host/data/' || cik || '/' || lpad(filing_id::VARCHAR, 10, '0') || '/' || lpad(filing_id::VARCHAR, 10, '0') || '.htm' AS url,
  'filings/' || ticker || '/' || filing_type || '/' || strftime(filing_date, '%Y-%m-%d') || '_' || lpad(filing_id::VARCHAR, 10, '0') || '.htm' AS path
  FROM f JOIN c USING (ticker) WHERE filing_type IN ('10-K', '10-Q') AND filing_date BETWEEN DATE '2015-01-01' AND DATE '2024-12-31' AND ticker IN (SELECT ticker FROM sector_map))
SELECT * FROM x WHERE path NOT IN (SELECT path FROM m)""",
    "q_model_score": oracles.model_score(_SENTENCES.format(c="mda_text")),
    "q_pack_clauses": oracles.pack_clauses(_SENTENCES.format(c="mda_text"), 20),
    "q_clean_text_exact": oracles.clean_text_exact("item_1a_text"),
    "q_parse_filings": oracles.parse_filings(_TABLE),
    "q_html_text_dom": oracles.html_text("item_1a_text", ["T"], ["A & B", "© 2020 ©"]),
}
