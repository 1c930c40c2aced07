"""Lexicon sentiment as expressions over token arrays: one look-up per token in a hashed constant, no join and no shuffle.

The lexicon is a constant of the plan, as an array of small maps; a token's checksum names its map, so a look-up takes as
long for 100,000 words as for 60. Lexicons beyond MAX_LITERAL_WORDS go by ``count_by_join``."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.config import CATEGORIES
from ledgerlark.functions import text

#: Words up to which a lexicon is a constant of the plan (about 40 bytes a word); checked, with ``count_by_join`` beyond it.
MAX_LITERAL_WORDS = 200_000


def category_name(c: Column | str) -> Column:
    """A category as this module spells it, in lower case: StrongModal and strong modal are strong_modal."""
    return F.regexp_replace(F.lower(c), "^(strong|weak)[ _-]?modal$", "$1_modal")


def categories_of(lexicon: DataFrame, limit: int = MAX_LITERAL_WORDS) -> dict[str, list[str]]:
    """{upper-case word: its categories} of a (word, category) table of at most `limit` words (checked)."""
    rows = lexicon.where("word is not null and category is not null")
    rows = rows.select(F.upper("word").alias("word"), category_name("category").alias("category")).distinct().groupBy("word").agg(F.sort_array(F.collect_set("category")).alias("c"))
    out = {r["word"]: list(r["c"]) for r in rows.limit(limit + 1).collect()}
    if len(out) > limit:
        raise ValueError(f"the lexicon has more than {limit} words; use count_by_join")
    return out


def lookup(lexicon: dict[str, list[str]]) -> Callable[[Column], Column]:
    """The categories of an upper-case word, none for other words."""
    n = 1 << max(1, len(lexicon)).bit_length()
    buckets: list[dict] = [{} for _ in range(n)]
    for w, cs in lexicon.items():
        buckets[zlib.crc32(w.encode()) & (n - 1)][w] = cs
    table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,array<string>>>")  # folded once, when the plan is made
    none = F.array().cast("array<string>")
    return lambda word: F.coalesce(F.try_element_at(F.element_at(table, (F.crc32(word).bitwiseAND(F.lit(n - 1)) + 1).cast("int")), word), none)


def metrics(counts: dict[str, Column], total: Column) -> list[Column]:
    """The 18 metrics from the counts by category and the number of tokens."""
    share = lambda c: F.coalesce(F.try_divide(c.cast("double"), total.cast("double")), F.lit(0.0))
    net = counts["positive"] - counts["negative"]
    out = [counts[k].cast("long").alias(f"{k}_count") for k in CATEGORIES] + [share(counts[k]).alias(f"{k}_pct") for k in CATEGORIES]
    out += [share(net).alias("net_sentiment"), (net / (counts["positive"] + counts["negative"] + 1)).alias("net_sentiment_normalized")]
    return [*out, sum(counts[k] for k in CATEGORIES).cast("long").alias("total_lm_words"), total.cast("long").alias("total_words")]


def _is(category: str) -> Callable[[Column], Column]:
    return lambda c: c == category


def _counted(hits: Column, total: Column) -> Column:
    return F.struct(*metrics({k: F.size(F.filter(hits, _is(k))) for k in CATEGORIES}, total))


def score(tokens: Column | str, lexicon: dict[str, list[str]]) -> Column:
    """L1, L2: struct of counts and shares of the seven categories and the composites; all 0 for no tokens.

    A word in k categories counts k times in total_lm_words."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    find = lookup(lexicon)

    def scored(x: Column) -> Column:
        hits = F.flatten(F.transform(x, lambda w: find(F.upper(w))))
        return text.let(F.struct(hits.alias("h"), F.size(x).alias("n")), lambda y: _counted(y["h"], y["n"]))

    return text.let(t, scored)


def score_columns(df: DataFrame, lexicon: DataFrame, text_col: str, prefix: str, tokenizer: Callable[[Column], Column] = text.tokenize, keys: tuple[str, ...] = ()) -> DataFrame:
    """L3: adds the 18 metrics of a text column under a prefix; tokens and look-ups are made once for each row.

    keys name a row, for a lexicon of more than MAX_LITERAL_WORDS words: its tokens are joined then."""
    tokens = tokenizer(text.text_of(text_col))
    names = metric_names()
    if keys and lexicon.select("word").distinct().limit(MAX_LITERAL_WORDS + 1).count() > MAX_LITERAL_WORDS:
        got = count_by_join(df.select(F.struct(*keys).alias("_key"), tokens.alias("_t")), "_key", "_t", lexicon)
        return df.withColumn("_key", F.struct(*keys)).join(got.withColumnsRenamed({n: prefix + n for n in names}), "_key", "left").drop("_key")
    df = df.withColumn("_m", score(tokens, categories_of(lexicon)))
    return df.withColumns({prefix + n: F.col(f"_m.{n}") for n in names}).drop("_m")


def metric_names() -> list[str]:
    return [f"{k}_count" for k in CATEGORIES] + [f"{k}_pct" for k in CATEGORIES] + ["net_sentiment", "net_sentiment_normalized", "total_lm_words", "total_words"]


def count_by_join(df: DataFrame, key: str, tokens: str, lexicon: DataFrame) -> DataFrame:
    """J11 for a lexicon of any size: (key, 18 metrics). The tokens of a row lie in one task, so what is shuffled after a
    broadcast (Spark sees the lexicon's size and picks it or not) is one row of counts for each key."""
    lex = lexicon.where("word is not null and category is not null").select(F.upper("word").alias("word"), category_name("category").alias("category")).distinct()
    own = df.select(key, F.explode(tokens).alias("t")).select(key, F.upper("t").alias("word"))
    hit = own.join(lex, "word").groupBy(key).agg(*[F.sum(F.when(F.col("category") == k, 1).otherwise(0)).alias(k) for k in CATEGORIES])
    size = df.groupBy(key).agg(F.sum(F.size(tokens)).alias("_total"))
    rows = size.join(hit, key, "left")
    return rows.select(key, *metrics({k: F.coalesce(k, F.lit(0)) for k in CATEGORIES}, F.col("_total")))


def union_lexicons(parts: Iterable[DataFrame]) -> DataFrame:
    """U4: the distinct (word, category) rows of several lexicons."""
    parts = list(parts)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
