"""Text functions as expressions: word and sentence counts, readability, tokens, cleaning, sentence pieces.

All take a Column and stay in the JVM. NULL counts as '' throughout. White space is ASCII white space."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerlark.config import DEFAULT, STOP_WORDS

SPACE = "[ \\t\\n\\r\\f\\x0B]+"


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}|{SPACE}$", "")


def words(c: Column | str) -> Column:
    """The pieces between white space."""
    return F.filter(F.split(text_of(c), SPACE), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c)).cast("long")


def sentence_pieces(c: Column | str) -> Column:
    """Pieces between runs of . ! ? that hold more than white space."""
    return F.filter(F.split(text_of(c), "[.!?]+"), lambda s: strip(s) != "")


def syllables(word: Column) -> Column:
    """Groups of vowels, one at least."""
    return F.greatest(F.lit(1), F.regexp_count(F.lower(word), F.lit("[aeiou]+")))


def _fog(w: Column, s: Column) -> Column:
    n = F.size(w)
    hard = F.size(F.filter(w, lambda x: syllables(x) >= 3))
    fog = F.round(0.4 * (n / F.greatest(F.lit(1), F.size(s)) + 100.0 * hard / F.greatest(F.lit(1), n)), 4)
    return F.when((n < 10) | (F.size(s) == 0), F.lit(0.0)).otherwise(fog)


def readability(c: Column | str) -> Column:
    """Gunning Fog from white-space words; 0 under ten words or without a sentence."""
    return let(F.struct(words(c).alias("w"), sentence_pieces(c).alias("s")), lambda x: _fog(x["w"], x["s"]))


def text_stats(c: Column | str) -> Column:
    """Struct of word_count, sentence_count, avg_sentence_length, fog_index, vocabulary_richness, char_count."""

    def figures(x: Column) -> Column:
        t, w, s = x["t"], x["w"], x["s"]
        n_sent = F.when(t == "", 0).otherwise(F.greatest(F.lit(1), F.size(s))).cast("long")
        alpha = F.transform(F.filter(w, lambda y: y.rlike("^\\p{L}+$")), lambda y: F.lower(y))
        richness = let(alpha, lambda a: F.round(F.size(F.array_distinct(a)) / F.greatest(F.lit(1), F.size(a)), 4))
        return F.struct(
            F.size(w).cast("long").alias("word_count"),
            n_sent.alias("sentence_count"),
            F.when(t == "", F.lit(0.0)).otherwise(F.round(F.size(w) / F.greatest(F.lit(1), F.size(s)), 2)).alias("avg_sentence_length"),
            _fog(w, s).alias("fog_index"),
            richness.alias("vocabulary_richness"),
            F.length(t).cast("long").alias("char_count"),
        )

    return let(F.struct(text_of(c).alias("t"), words(c).alias("w"), sentence_pieces(c).alias("s")), figures)


def tokenize(c: Column | str, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Runs of letters in lower case, without stop words and single letters."""
    found = F.regexp_extract_all(F.lower(text_of(c)), F.lit("[\\p{L}\\p{M}]+"), F.lit(0))
    keep = lambda t: F.length(t) >= 2
    if not stop_words:
        return F.filter(found, keep)
    # one automaton over the token's first letters instead of a search in a list
    stop = "^(?:" + "|".join(sorted(re.escape(w) for w in stop_words)) + ")$"
    return F.filter(found, lambda t: keep(t) & ~t.rlike(stop))


#: Latin-1 and Latin Extended-A letters and the ASCII letter they decompose to, by rule.
_PAIRS = [(c, d[0]) for c in map(chr, range(0xC0, 0x180)) if (d := unicodedata.normalize("NFKD", c)) != c and d[0].isascii()]


def clean_text(c: Column | str) -> Column:
    """N13 as an expression: tags to blanks, Latin accents off, other non-ASCII off, lower case, letters . , only.

    Accents beyond Latin Extended-A go with their letter; ``clean_text_exact`` decomposes all of Unicode."""
    t = F.regexp_replace(text_of(c), "<[^>]+>", " ")
    t = F.translate(t, "".join(a for a, _ in _PAIRS), "".join(b for _, b in _PAIRS))
    return _letters(F.regexp_replace(t, "[^\\x00-\\x7F]", ""))


def _letters(t: Column) -> Column:
    t = F.regexp_replace(F.lower(t), "[^a-z \\t\\n\\r\\f\\x0B.,]", " ")
    return strip(F.regexp_replace(t, SPACE, " "))


@F.pandas_udf(StringType())
def _ascii(t: pd.Series) -> pd.Series:
    return t.map(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode() if isinstance(x, str) else x)


def clean_text_exact(c: Column | str) -> Column:
    """N13 with full compatibility decomposition, in an Arrow UDF."""
    return _letters(_ascii(F.regexp_replace(text_of(c), "<[^>]+>", " ")))


def get_sentences(c: Column | str, max_words: int = DEFAULT.sentence_max_words, cap: int | None = DEFAULT.sentence_cap_chars) -> Column:
    """Sentences by terminator and blank; one over max_words is cut at every comma and semicolon.

    cap is the reference's limit on the characters read; None reads the whole text."""
    t = F.substring(text_of(c), 1, cap) if cap else text_of(c)
    s = F.filter(F.transform(F.split(t, "(?<=[.!?])[ \\t\\n\\r\\f\\x0B]+"), strip), lambda x: x != "")
    long = lambda x: F.size(F.split(x, SPACE)) > max_words
    clauses = lambda x: F.filter(F.transform(F.split(x, "[;,]"), strip), lambda y: y != "")
    return F.flatten(F.transform(s, lambda x: F.when(long(x), clauses(x)).otherwise(F.array(x))))


def pack_clauses(sentence: Column | str, max_words: int = DEFAULT.sentence_max_words) -> Column:
    """M2: a sentence over max_words as clauses packed greedily up to max_words; a longer clause stays whole."""
    s = F.col(sentence) if isinstance(sentence, str) else sentence
    n = lambda x: F.size(F.filter(F.split(x, SPACE), lambda w: w != ""))
    parts = F.filter(F.transform(F.split(s, "[;,][ \\t\\n\\r\\f\\x0B]*"), strip), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def add(acc: Column, p: Column) -> Column:
        fits = (acc["cur"] == "") | (n(acc["cur"]) + n(p) <= max_words)
        return F.when(fits, F.struct(acc["done"].alias("done"), F.when(acc["cur"] == "", p).otherwise(F.concat(acc["cur"], F.lit(" "), p)).alias("cur"))).otherwise(
            F.struct(F.array_append(acc["done"], acc["cur"]).alias("done"), p.alias("cur"))
        )

    packed = F.aggregate(parts, start, add, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["cur"])))
    return F.when(n(s) <= max_words, F.array(s)).when(F.size(packed) == 0, F.array(F.substring(s, 1, 512))).otherwise(packed)


def prepare_sentences(sentences: Column | str, max_words: int = DEFAULT.sentence_max_words, min_words: int = DEFAULT.sentence_min_words) -> Column:
    """M3: stripped sentences of min_words at least, packed."""
    s = F.col(sentences) if isinstance(sentences, str) else sentences
    kept = F.filter(F.transform(s, strip), lambda x: F.size(F.filter(F.split(x, SPACE), lambda w: w != "")) >= min_words)
    return F.flatten(F.transform(kept, lambda x: pack_clauses(x, max_words)))


def shorten(c: Column | str, n: int = 3000, marker: str = "...") -> Column:
    """The first n characters with a marker, line breaks as <br>."""
    t = text_of(c)
    return F.replace(F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(marker))).otherwise(t), F.lit("\n"), F.lit("<br>"))


def label(day: Column | str, kind: Column | str) -> Column:
    """N21: 'date | type', ? where missing."""
    d = F.col(day) if isinstance(day, str) else day
    k = F.col(kind) if isinstance(kind, str) else kind
    return F.concat_ws(" | ", F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit("?")), F.coalesce(k, F.lit("?")))


def percent(c: Column | str) -> Column:
    """Two decimals and a per cent sign, a dash where missing."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.isNull(), F.lit("—")).otherwise(F.format_string("%.2f%%", x * 100))
