"""Problem 1: text that looks the same, in one consistent form.

The vocabulary of the corpus (words whose letters are of one alphabet) is kept in tries. Each distinct token with
full-width forms, ligatures, ignorables, separate accents or foreign letters runs through its trie as a weighted edit
automaton: look-alikes and ignorables cost nothing, other edits cost 1, and the budget is 0 here because every other
edit is a difference. The cheapest word of the vocabulary is the canonical spelling; a token that meets none gets its
form by table. Tries are sharded by the first characters of the form, so a task holds one shard's vocabulary only.

Texts are read once: that pass gives each section's form, or its text and the tokens to look up, and the vocabulary.

Results: NULL, empty and blank texts have no form and belong to no class. Of a filing delivered several times the
latest delivery counts. Blanks at both ends don't count. Rows without filing_id are left out."""

from __future__ import annotations

import re
import unicodedata as ud
from collections import Counter
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import common, forms

#: Characters of the form that name a shard of the vocabulary.
SHARD_CHARS = 5


@lru_cache(1)
def token_pattern() -> re.Pattern:
    import sys

    special = forms.tables()[0]
    loose = [i for i in range(0x80, sys.maxunicode + 1) if ud.category(chr(i))[0] == "M"] + [i for i, v in special.items() if v == ""]
    return re.compile(r"(?:[^\W_]|" + forms.char_class(set(loose)).pattern + ")+")


@lru_cache(1)
def twins() -> dict[str, str]:
    """For each character the characters that look like it."""
    by: dict[str, set[str]] = {}
    for own, latin in forms.LOOKALIKE.items():
        by.setdefault(latin, {latin}).add(own)
    return {c: "".join(sorted(group)) for group in by.values() for c in group}


def digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


@lru_cache(200_000)
def token_form(token: str) -> str:
    return forms.folded(forms.shape(token))


FOREIGN = re.compile("[\u0370-\u058f]")


@lru_cache(200_000)
def odd(token: str) -> bool:
    """True if a token may have another spelling: it isn't its own form, or its form mixes alphabets."""
    if token.isascii():
        return False
    return token_form(token) != token or bool(FOREIGN.search(token)) and any(c in LATIN for c in token)


LATIN = frozenset(forms.LOOKALIKE.values())


def pure(token: str) -> bool:
    """A word in composed form whose letters are of one alphabet: fit for the vocabulary."""
    if forms.shape(token) != token or not token.isalpha():
        return False
    return len({ud.name(c, "?").split(" ")[0] for c in ud.normalize("NFD", token) if ud.category(c)[0] == "L"}) == 1


def native(token: str) -> bool:
    """True if the word has a letter that no Latin letter looks like: else its Latin spelling is the canonical one."""
    return any(c in forms.LOOKALIKE for c in token) and any(c not in forms.LOOKALIKE for c in token)


class Trie:
    """Words as nested dicts over their decomposed characters; '' holds (count, word)."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for c in ud.normalize("NFD", word):
            node = node.setdefault(c, {})
        node[""] = (count, word)

    def match(self, token: str, budget: int = 0) -> str | None:
        """The word of least cost within the budget, then the Latin one, the most frequent one, the first."""
        special = forms.tables()[0]
        states: dict[int, tuple[int, dict]] = {id(self.root): (0, self.root)}

        def close(states: dict) -> dict:  # characters of the word that the token lacks
            todo = [s for s in states.values() if s[0] < budget]
            while todo:
                cost, node = todo.pop()
                for c, to in node.items():
                    if c and cost + 1 <= budget and states.get(id(to), (budget + 1,))[0] > cost + 1:
                        states[id(to)] = (cost + 1, to)
                        todo.append((cost + 1, to))
            return states

        states = close(states)
        for x in token:
            x = special.get(ord(x), x)
            for c in ud.normalize("NFD", x):
                step: dict[int, tuple[int, dict]] = {}

                def reach(cost: int, node: dict, step=step) -> None:
                    if cost <= budget and step.get(id(node), (budget + 1,))[0] > cost:
                        step[id(node)] = (cost, node)

                for cost, node in states.values():
                    for t in twins().get(c, c):
                        if t in node:
                            reach(cost, node[t])
                    if cost < budget:
                        reach(cost + 1, node)
                        for t, to in node.items():
                            if t:
                                reach(cost + 1, to)
                states = close(step)
                if not states:
                    return None
        ends = [(cost, node[""]) for cost, node in states.values() if "" in node]
        ends = [(cost, not w.isascii(), -n, w) for cost, (n, w) in ends if w == token_form(w) or native(w)]
        return min(ends)[3] if ends else None


ASCII_WORDS = re.compile("[A-Za-z0-9]+")


def tokens(text: str) -> tuple[set[str], set[str]]:
    """The different tokens of a text: those in ASCII, and the others. Pieces between blanks are read apart, for speed."""
    if text.isascii():
        return set(ASCII_WORDS.findall(text)), set()
    pieces = text.split()
    other = [x for x in pieces if not x.isascii()]
    found = set(token_pattern().findall(" ".join(other)))
    plain = set(ASCII_WORDS.findall(" ".join(x for x in pieces if x.isascii())))
    plain.update(x for x in found if x.isascii())
    return plain, {x for x in found if not x.isascii()}


def form_by_table(text: str) -> str:
    special, found, _, _ = forms.tables()
    return forms.blanks(found.sub(lambda m: special[ord(m[0])], text))


SECTION = "filing_id long, loaded_at timestamp, section string, raw binary, form_id binary, form string, body string, odd array<string>"
SCANNED = SECTION + ", shard string, is_word boolean, token string, n long"


def _scan(keep: bool):
    """Rows of sections: the form's digest (with keep the form), or the text and its tokens that need a lookup; then rows of
    the batch's vocabulary: words fit for it, and tokens to look up, with the number of texts that hold them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, ids, kept, bodies, odds, words, todo = [], [], [], [], [], Counter(), Counter()
        for t in batch.column("text").to_pylist():
            raw.append(digest(t))
            plain, other = tokens(t)
            words.update(plain)
            mine = sorted(x for x in other if odd(x))
            todo.update(mine)
            words.update(other.difference(mine))
            form = None if mine else forms.blanks(t) if t.isascii() else form_by_table(t)
            ids.append(None if mine else digest(form))
            kept.append(form if keep else None)
            bodies.append(t if mine else None)
            odds.append(mine or None)
        vocabulary = [(x[:SHARD_CHARS] if x.isascii() else token_form(x)[:SHARD_CHARS], True, x, c) for x, c in words.items() if x.isalpha() and (x.isascii() or pure(x))]
        for x, c in todo.items():
            shard = token_form(x)[:SHARD_CHARS]
            vocabulary.append((shard, False, x, c))
            if pure(x):
                vocabulary.append((shard, True, x, c))
        n, v = batch.num_rows, len(vocabulary)
        columns = list(zip(*vocabulary)) if v else [[]] * 4
        own = [batch.column(c) for c in ("filing_id", "loaded_at", "section")] + [pa.array(raw, pa.binary()), pa.array(ids, pa.binary()), pa.array(kept, pa.string()), pa.array(bodies, pa.string()), pa.array(odds, pa.list_(pa.string()))]
        kinds = (pa.string(), pa.bool_(), pa.string(), pa.int64())
        cols = [pa.concat_arrays([x, pa.nulls(v, x.type)]) for x in own] + [pa.concat_arrays([pa.nulls(n, k), pa.array(list(c), k)]) for c, k in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in SCANNED.split(", ")])

    return run


def scanned(secs: DataFrame, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """Section rows and vocabulary rows, by one pass over the texts."""
    rows = common.written(common.arrow_batches(secs, _scan(keep), SCANNED), "p1-scanned")
    own = [f.split()[0] for f in SECTION.split(", ")]
    return rows.where("raw is not null").select(*own), rows.where("token is not null").select("shard", "is_word", "token", "n")


def _lookup(it):
    """Rows sorted by shard, words before tokens: one trie at a time."""
    trie, shard = Trie(), None
    for pdf in it:
        out = []
        for s, is_word, token, n in zip(pdf["shard"], pdf["is_word"], pdf["token"], pdf["n"]):
            if s != shard:
                trie, shard = Trie(), s
            if is_word:
                trie.add(token, int(n))
            else:
                word = trie.match(token)
                out.append((token, word if word is not None else token_form(token), word is not None))
        yield pd.DataFrame(out, columns=["token", "spelling", "known"])


def spellings(vocabulary: DataFrame) -> DataFrame:
    """(token, spelling, known) for each distinct token that isn't in plain form.

    Only shards with a token to look up are brought together."""
    asked = vocabulary.where("not is_word").select("shard").distinct()
    seen = vocabulary.join(asked, "shard", "left_semi").groupBy("shard", "is_word", "token").agg(F.sum("n").alias("n"))
    sorted_ = seen.repartition("shard").sortWithinPartitions(F.col("shard"), F.col("is_word").desc(), F.col("token"))
    return sorted_.mapInPandas(_lookup, "token string, spelling string, known boolean")


def _apply(keep: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pat, out = token_pattern(), []
        for body, pairs in zip(pdf["body"], pdf["pairs"]):
            by = {p["token"]: p["spelling"] for p in pairs} if pairs is not None else {}
            t = " ".join(x if x.isascii() else pat.sub(lambda m: by.get(m[0]) if m[0] in by else token_form(m[0]), x) for x in body.split())
            out.append(forms.blanks(ud.normalize("NFC", form_by_table(t))))
        return pdf[["filing_id", "loaded_at", "section", "raw"]].assign(form_id=[digest(x) for x in out], form=out if keep else None)

    return run


FORMS = "filing_id long, loaded_at timestamp, section string, raw binary, form_id binary, form string"


def forms_of(secs: DataFrame, keep: bool = False) -> DataFrame:
    """(filing_id, loaded_at, section, raw digest, form_id, form) for each section (filing_id, loaded_at, section, text); form with keep."""
    rows, vocabulary = scanned(secs, keep)
    names = [f.split()[0] for f in FORMS.split(", ")]
    key = ["filing_id", "section", "raw"]
    odd = rows.where("odd is not null")
    asked = common.spread(odd.select(*key, "odd"), "filing_id").select(*key, F.explode("odd").alias("token")).distinct()
    pairs = common.join_salted(asked, spellings(vocabulary), "token", "filing_id")
    pairs = pairs.groupBy(*key).agg(F.collect_list(F.struct("token", "spelling")).alias("pairs"))
    done = odd.select("loaded_at", "body", *key).join(pairs, key, "left")
    return rows.where("odd is null").select(*names).unionByName(common.batches(done, _apply(keep), FORMS))


def classes(filings: DataFrame) -> DataFrame:
    """(filing_id, section, raw, form_id): texts of a section with the same form_id read the same."""
    rows = forms_of(common.sections(filings)).select("filing_id", "loaded_at", "section", "raw", "form_id")
    return common.latest(rows, ["filing_id", "section"], ["raw", "form_id"])


def found_pairs(filings: DataFrame) -> DataFrame:
    """Pairs of filings whose texts read the same but are stored as different strings."""
    rows = common.written(classes(filings), "p1-classes")
    several = rows.groupBy("section", "form_id").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where("a <> b")
    rows = rows.join(several.select("section", "form_id"), ["section", "form_id"], "left_semi")
    rows = common.written(rows.select("filing_id", "section", "raw", F.struct("section", "form_id").alias("class")), "p1-several")
    a = rows.select(F.col("filing_id").alias("filing_id_a"), "section", F.col("raw").alias("raw_a"), "class")
    b = rows.select(F.col("filing_id").alias("filing_id_b"), F.col("raw").alias("raw_b"), "class")
    pairs = common.join_salted(a, b, "class", "filing_id_a").where("filing_id_a < filing_id_b and raw_a <> raw_b")
    return pairs.select("filing_id_a", "filing_id_b", "section")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_pairs(common.table(spark, sf_dir, "filings_df"))


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form of each section, and how many filings and spellings its class has."""
    filings = common.table(spark, sf_dir, "filings_df")
    rows = common.latest(forms_of(common.sections(filings), keep=True), ["filing_id", "section"], ["raw", "form"])
    rows = rows.withColumn("form_id", F.md5("form"))
    size = rows.groupBy("section", "form_id").agg(F.count("*").alias("filings"), F.count_distinct("raw").alias("spellings"))
    return rows.drop("raw").join(size, ["section", "form_id"]).select("filing_id", "section", "form_id", "filings", "spellings", "form")


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each section: its class, named by the least filing that reads so, and the filings and spellings of it."""
    rows = classes(common.table(spark, sf_dir, "filings_df")).withColumn("class", F.struct("section", "form_id"))
    size = rows.groupBy("class").agg(F.min("filing_id").alias("class_id"), F.count("*").alias("filings"), F.count_distinct("raw").alias("spellings"))
    return common.join_salted(rows.select("filing_id", "section", "class"), size, "class", "filing_id").select("filing_id", "section", "class_id", "filings", "spellings")


def p1_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling of each distinct token that isn't in plain form."""
    return spellings(scanned(common.sections(common.table(spark, sf_dir, "filings_df")))[1])


QUERIES = {"p1_found": p1_found, "p1_forms": p1_forms, "p1_classes": p1_classes, "p1_spellings": p1_spellings}


def sql_forms() -> str:
    """CTEs f and t (filing_id, section, raw, form): the form by table in SQL, apart from the operator: one character for
    one, blanks and ignorables, Latin ligatures."""
    special, _, look, _ = forms.tables()
    one, gone, several = {}, "", {}
    for i in [*range(0xA0, 0xD800), *range(0xE000, 0x20000), *[x for x in special if x >= 0x20000]]:
        c = chr(i)
        f = forms.folded(forms.shape(c))
        if special.get(i) == "":
            gone += c
        elif len(f) == 1 and f != c:
            one[c] = f
        elif 0xFB00 <= i <= 0xFB06:
            several[c] = f
    q = lambda t: "'" + t.replace("'", "''") + "'"
    t = "nfc_normalize({c})"
    for c, f in several.items():
        t = f"replace({t}, '{c}', '{f}')"
    t = f"translate({t}, {q(''.join(one) + gone)}, {q(''.join(one.values()))})"
    t = f"trim(regexp_replace(nfc_normalize({t}), '[ \\t\\n\\r\\f\\v\\x1c-\\x1f\\x85]+', ' ', 'g'))"
    rows = " UNION ALL ".join(f"SELECT filing_id, '{s}' AS section, {c} AS raw FROM f" for s, c in common.SECTIONS)
    return f"""WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filing_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM filings_df WHERE filing_id IS NOT NULL) WHERE rn = 1),
t AS (SELECT filing_id, section, raw, {t.replace('{c}', 'raw')} AS form FROM ({rows}) WHERE raw IS NOT NULL)"""


SQL = {
    "p1_found": sql_forms() + """
SELECT a.filing_id AS filing_id_a, b.filing_id AS filing_id_b, a.section FROM t a JOIN t b ON a.section = b.section AND a.form = b.form AND a.filing_id < b.filing_id AND a.raw <> b.raw WHERE a.form <> ''""",
    "p1_classes": sql_forms() + """, c AS (SELECT section, form, min(filing_id) AS class_id, count(*) AS filings, count(DISTINCT raw) AS spellings FROM t WHERE form <> '' GROUP BY section, form)
SELECT filing_id, section, class_id, filings, spellings FROM t JOIN c USING (section, form)""",
}
