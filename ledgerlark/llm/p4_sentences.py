"""Problem 4: sentences of texts in any language, by document-centred disambiguation.

Whether a word with a full stop is an abbreviation, and whether a capitalised word after it is a common word (so a
sentence begins) or a name, is decided from occurrences that leave no doubt: first those elsewhere in the document,
then those of the whole corpus. The corpus counts are a table by word; each section is joined with the words at its own
doubtful places only. Scripts have their own terminators: ideographic and Indic full stops need no blank, Thai ends a
sentence at a blank.

Positions count characters of the stored text. Ignorable characters, full-width forms and look-alike letters don't
disturb the rules. An empty line ends a unit; a single line break is a blank.

Results: NULL and blank sections have no sentences. Rows without filing_id are left out. Of a filing delivered several
times the latest delivery counts."""

from __future__ import annotations

import re
import unicodedata as ud
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import common, forms

# Abbreviations before a number and before a name. They count only where neither the document nor the corpus
# holds any evidence on the word (a single document with one such place, say).
PRIOR_NUMBER = "approx ca eq no nos nr núm fig figs sec art arts abs ziff vol ch pp pág para п ст гл рис стр т"
PRIOR_NAME = "mr mrs ms dr prof st messrs hon rev gen col lt capt hr fr m mm mme mlle mgr sr sra srta dra dña им д-р г-н г-жа vs cf bzw mio mrd tsd z d u v"
PRIOR_NUMBER, PRIOR_NAME = ({forms.folded(w).lower() for w in line.split()} for line in (PRIOR_NUMBER, PRIOR_NAME))
# German names of months, which follow an ordinal number.
MONTHS = {"januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"}
GERMAN = {"der", "die", "das", "und", "im", "den", "des", "ein", "von", "zum", "für", "auf", "ist"}
CLOSING = "”’»\"')]}」』】）›“"
OPENING = "“‘«\"'([{「『【（‹„¿¡"
FULL = "。．｡।॥։።።"
ANY = "?!؟…⁈⁉‼"
PAIRS = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "‹": "›"}
OPEN = re.compile("[" + "".join(PAIRS) + "]")
#: Occurrences in the corpus that are evidence of a title or of a word before numbers, and of other things.
LEAST_TITLE = 3
LEAST_CORPUS = 2
#: How many times more often than otherwise a title stands with a full stop before a name.
MOSTLY = 10


CHANGED = re.compile("[\r\v\f\x85\u2028\u2029\u0300-\u036f]")


@lru_cache(1)
def marked() -> re.Pattern:
    """Characters outside ASCII that the table changes."""
    return forms.char_class(i for i in forms.tables()[0] if i > 127)


def normal(text: str) -> tuple[str, Sequence[int]]:
    """The text without ignorables and accents of their own, in one width, and the place of each character."""
    if not CHANGED.search(text) and (text.isascii() or not marked().search(text)):
        return text, range(len(text))
    special = forms.tables()[0]
    out, at = [], []
    for i, c in enumerate(text):
        o = ord(c)
        if o < 128:
            c = "\n" if c in "\r\v\f" else c
        elif 0x300 <= o < 0x370:
            continue
        elif c in "\x85 ":
            c = "\n"
        elif c == " ":
            c = "\n\n"
        elif c == "…":
            pass
        else:
            c = special.get(o, c)
        for x in c:
            out.append(x)
            at.append(i)
    return "".join(out), at


def units(s: str) -> list[tuple[int, int]]:
    """Stretches between empty lines."""
    out, begin = [], 0
    for m in re.finditer(r"\n[^\S\n]*\n\s*", s):
        out.append((begin, m.start()))
        begin = m.end()
    return [*out, (begin, len(s))]


STOP = re.compile(r"(?P<dots>\.(?:[ ]?\.){2,}|\.)|(?P<any>[" + re.escape(ANY) + "]+)|(?P<full>[" + re.escape(FULL) + "]+)")
#: Characters of words besides letters and digits: signs of Arabic and Indic scripts.
SIGNS = re.compile("[\u064b-\u065f\u0900-\u0963\u0966-\u0dff]")
JOINERS = ".’'-"
BLANK = re.compile(r"\s*")
OPENED = re.compile(r"[\s" + re.escape(OPENING) + "]*")
WORD_AFTER = re.compile(r"[^\W_]+")
CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
THAI = re.compile(r"[฀-๿຀-໿ក-៿က-႟]")
CASELESS = re.compile(r"[֐-ࣿऀ-෿]")
PARTICLES = "とってはがをにのもでなやかへよりま、，,"


@lru_cache(100_000)
def fold(word: str) -> str:
    return forms.folded(word).lower()


WORDS = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")
DOTTED = re.compile(r"(?<![^\W_])(?<![^\W_]\.)(?>([^\W_]+(?:\.[^\W_]+)*))\.(?=(\s*)(\S?)[“\"'(«„]*([^\W_]*))")
CAPITAL, SMALL = (forms.char_class(i for i in range(0x41, 0x590) if ud.category(chr(i)) == c).pattern for c in ("Lu", "Ll"))
#: Capitalised words inside a sentence, and where one begins without doubt.
INSIDE = re.compile(rf"[ \n](?<={SMALL}.)({CAPITAL}[^\W_]*)", re.S)
BEGINS = re.compile(rf"(?:\A|\n[^\S\n]*\n|[?!…])\s*({CAPITAL}[^\W_]*)")


class Doc:
    """What a document itself says about its words, from places that leave no doubt."""

    def __init__(self, s: str) -> None:
        s = forms.folded(s)
        words = Counter(WORDS.findall(s))
        self.dotted: set[str] = set()  # with a full stop before a small letter or a comma
        self.numbered: Counter = Counter()  # with a full stop before a number
        stops: dict[str, int] = {}
        for w, gap, first, _ in DOTTED.findall(s):
            stops[w] = stops.get(w, 0) + 1
            if first and not w.isdigit():
                if first in ",;:)" or gap and first.islower():
                    self.dotted.add(w.lower())
                elif gap and first.isdigit():
                    self.numbered[w.lower()] += 1
        stopped = stops.get
        self.lower = {w.lower() for w in words if w[0].islower()}  # common words: with a small letter
        self.plain = {w.lower() for w, n in words.items() if n > stopped(w, 0)}  # without full stop
        self.names = {w.lower() for w in INSIDE.findall(s)}  # with a capital inside a sentence
        self.german = len(self.lower & GERMAN) >= 3

    def common(self, word: str, corpus: Corpus) -> bool:
        """True if a capitalised word is a common one: by the document, else by the corpus."""
        return len(word) > 1 and (word in self.lower or word not in self.names and corpus.usual(word))


def word_before(s: str, end: int) -> str:
    """The word that ends at a place, with the points, hyphens and apostrophes inside it."""
    i = end
    while i > 0:
        c = s[i - 1]
        if c.isalnum() or SIGNS.match(c) or i < end and c in JOINERS and i > 1 and (s[i - 2].isalnum() or SIGNS.match(s[i - 2])):
            i -= 1
        else:
            break
    return s[i:end]


class Site:
    """A place where a sentence may end: end of the terminator, end with closing marks, kind; what stands before and after."""

    __slots__ = ("e", "close", "kind", "before", "after", "first", "lead", "blank")

    def __init__(self, s: str, stop: int, m: re.Match, e: int) -> None:
        self.e, self.close, self.kind = m.end(), e, m.lastgroup
        at = BLANK.match(s, e, stop).end()
        self.blank, self.first = at > e, s[at] if at < stop else ""
        at = OPENED.match(s, at, stop).end()
        self.lead = s[at] if at < stop else ""
        # words matter where a full stop stands before a blank only, so no word is read twice
        doubt = self.kind == "dots" and self.blank
        self.before = word_before(s, m.start()) if doubt else ""
        after = WORD_AFTER.match(s, at, stop) if doubt else None
        self.after = after[0] if after else ""


def sites(s: str, begin: int, stop: int) -> Iterator[Site]:
    marks = [(m.start(), m[0]) for m in re.finditer("[«»]", s[begin:stop])] if "»" in s or "›" in s else []
    k = 0
    for m in STOP.finditer(s, begin, stop):
        e = m.end()
        while e < stop and s[e] in CLOSING:
            if s[e] in "\"'“’" and not (e + 1 == stop or s[e + 1].isspace() or s[e + 1] in CLOSING + ".,;:" or CJK.match(s[e + 1])):
                break
            e += 1
        if marks and e + 1 < stop and s[e] == " " and s[e + 1] in "»›":
            while k < len(marks) and marks[k][0] + begin < e:
                k += 1
            if k and marks[k - 1][1] == "«":
                e += 2
        yield Site(s, stop, m, e)


class Corpus:
    """Counts of the words of one section's doubtful places over all documents; empty: nothing known."""

    def __init__(self, rows: dict[str, tuple[int, ...]] | None = None) -> None:
        self.rows = rows or {}

    def get(self, word: str) -> tuple[int, ...]:
        """Occurrences with a small letter; without full stop; with one before a small letter, before a number, before names,
        before common words; with a capital where a sentence begins without doubt, and inside one."""
        return self.rows.get(word, (0,) * len(FACTS))

    def usual(self, word: str) -> bool:
        """True if the word is a common one, by its small letter or since its capital stands at beginnings only."""
        x = self.get(word)
        return x[0] >= LEAST_CORPUS or x[6] >= LEAST_CORPUS and x[6] >= MOSTLY * x[7]


def ends(s: str, x: Site, doc: Doc, corpus: Corpus) -> bool:
    """True if a sentence ends at this place."""
    e, close, kind, first, lead = x.e, x.close, x.kind, x.first, x.lead
    if not first:
        return True
    prior = s[e - 2 : e - 1]
    dense = bool(CJK.match(prior)) or kind == "full" and not CASELESS.match(prior)
    if kind == "full" or dense and kind == "any":
        if close > e and s[close - 1] in "」』" and first in PARTICLES:
            return False
        return not (first in "、，,；;：:")
    if not x.blank:
        return False
    caseless = bool(CASELESS.search(s, max(0, e - 12), e)) or bool(lead and CASELESS.match(lead))
    if kind == "any" or kind == "dots" and e >= 3 and s[e - 3 : e].replace(" ", "").count(".") > 1:
        return first not in ",;:" and (caseless or not lead.islower())
    if first in ",;:" or lead.islower():
        return False
    word = re.split("[’']", fold(x.before))[-1]
    _, plain, small, digit, name, common, _, _ = corpus.get(word)
    known = small + digit + name + common
    if caseless:
        letters = len(re.sub(r"[^\w]", "", word))
        always = letters <= 2 and known >= LEAST_TITLE and plain == 0 and word not in doc.plain
        return not (letters == 1 and not word.isdigit() or always)
    if close > e and s[close - 1] in ")]" or not word:
        return True
    if word.isdigit() or re.fullmatch(r"[\d.,]+", word):
        return not (doc.german and fold(x.after) in MONTHS)
    common_next = doc.common(fold(x.after), corpus)
    evidence = known >= LEAST_TITLE or plain >= LEAST_CORPUS or word in doc.plain or word in doc.dotted
    if len(word) == 1 and x.before[-1:].isupper():  # an initial
        return common_next
    abbreviation = word in doc.dotted and word not in doc.plain or small >= LEAST_CORPUS and small > plain and MOSTLY * small > name + common
    if lead.isdigit():
        if digit >= LEAST_TITLE and digit > name + common or doc.numbered[word] > 1 and word not in doc.plain or not evidence and word in PRIOR_NUMBER | PRIOR_NAME:
            return False
    if not lead.isalpha():  # a number or a sign
        return not abbreviation and word not in doc.dotted and "." not in word
    short = "." in word
    title = name >= LEAST_TITLE and name >= MOSTLY * common and name >= MOSTLY * plain and word not in doc.plain
    if not evidence and word in PRIOR_NAME:
        return common_next
    if not abbreviation and not title and not short:
        return True
    return common_next or MOSTLY * common > name or short


def quoted(s: str, begin: int, stop: int) -> list[tuple[int, int]]:
    """Spans of quotations, first to last character inside the marks."""
    out, done, open_ended = [], begin, set()
    for m in OPEN.finditer(s, begin, stop):
        i = m.start()
        mark = PAIRS[s[i]]
        if i < done or mark in open_ended:
            continue
        if (j := s.find(mark, i + 1, stop)) > 0:
            out.append((i + 1, j))
            done = j + 1
        else:
            open_ended.add(mark)
    return out


def split(text: str, corpus: Corpus | None = None) -> list[int]:
    """For each sentence the number of characters of the text up to and including its last one. Linear in the text."""
    s, at = normal(text)
    corpus, doc, out = corpus or Corpus(), Doc(s), []

    def put(end: int) -> None:
        while end and s[end - 1].isspace():
            end -= 1
        last = at[end - 1] + 1
        while last < len(text) and 0x300 <= ord(text[last]) < 0x370:
            last += 1
        if not out or last > out[-1]:
            out.append(last)

    for begin, stop in units(s):
        if BLANK.match(s, begin, stop).end() == stop:
            continue
        if THAI.search(s, begin, stop) and len(THAI.findall(s, begin, stop)) * 2 > len(re.sub(r"[\s\d\W]", "", s[begin:stop])):
            for m in SOLID.finditer(s, begin, stop):
                put(m.end())
            continue
        inside, k = quoted(s, begin, stop), 0
        for x in sites(s, begin, stop):
            while k < len(inside) and inside[k][1] <= x.e:
                k += 1
            if k < len(inside) and inside[k][0] <= x.e:
                continue
            if ends(s, x, doc, corpus):
                put(x.close)
        put(stop)
    return out


SOLID = re.compile(r"\S+")


def doubtful(text: str) -> set[str]:
    """The words before and after the places of a text where a full stop leaves a doubt."""
    s, _ = normal(text)
    out = set()
    for begin, stop in units(s):
        for x in sites(s, begin, stop):
            if x.before and x.lead and not x.lead.islower():
                out.add(re.split("[’']", fold(x.before))[-1])
                if x.after:
                    out.add(fold(x.after))
    return out


FACTS = ["lower", "plain", "small", "digit", "name", "common", "begins", "inside"]
COUNTED = "word string, next string, " + ", ".join(f"{f} long" for f in FACTS)


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """The facts of each word over a batch. What follows a full stop is common if its document has it with a small letter;
    where the document doesn't tell, the row names the next word, for the corpus to tell."""
    seen, begins, inside, facts = Counter(), Counter(), Counter(), defaultdict(lambda: [0] * len(FACTS))
    for t in pdf["text"]:
        s = forms.folded(normal(t)[0])
        own = WORDS.findall(s)
        seen.update(own)
        begins.update(BEGINS.findall(s))
        inside.update(INSIDE.findall(s))
        own = set(own)
        for word, gap, first, x in DOTTED.findall(s):
            if word.isdigit():
                continue
            word = word.lower()
            facts[word, None][1] -= 1
            if not first or not gap:
                continue
            if first.islower() or first in ",;":
                facts[word, None][2] += 1
                continue
            x = x if not first.isalnum() else first + x
            if not x or not x[0].isalnum():
                continue
            if x[0].isdigit():
                facts[word, None][3] += 1
            elif x[0].islower():
                facts[word, None][2] += 1
            elif len(x) == 1:
                facts[word, None][4] += 1
            elif x.lower() in own:
                facts[word, None][5] += 1
            else:
                facts[word, x.lower()][4] += 1
    for w, n in seen.items():
        if not w.isdigit():
            f = facts[w.lower(), None]
            f[1] += n
            if w[0].islower():
                f[0] += n
    for at, counts in ((6, begins), (7, inside)):
        for w, n in counts.items():
            facts[w.lower(), None][at] += n
    return pd.DataFrame([(*k, *f) for k, f in facts.items()], columns=["word", "next", *FACTS])


def corpus_counts(secs: DataFrame) -> DataFrame:
    """(word, lower, plain, small, digit, name, common) over all sections."""
    rows = common.batches(secs.select("text"), _count, COUNTED).groupBy("word", "next").agg(*[F.sum(f).alias(f) for f in FACTS])
    rows = common.written(rows, "p4-counts")
    known, open_ = rows.where("next is null").drop("next"), rows.where("next is not null").select("word", "next", "name")
    usual = known.where(f"lower >= {LEAST_CORPUS} or begins >= {LEAST_CORPUS} and begins >= {MOSTLY} * inside").select(F.col("word").alias("next"), F.lit(True).alias("usual"))
    told = open_.join(usual, "next", "left").withColumns({"common": F.when(F.col("usual"), F.col("name")).otherwise(0), "name": F.when(F.col("usual").isNull(), F.col("name")).otherwise(0)})
    told = told.select("word", *[F.col(f) if f in ("name", "common") else F.lit(0).cast("long").alias(f) for f in FACTS])
    return known.unionByName(told).groupBy("word").agg(*[F.sum(f).alias(f) for f in FACTS])


def _doubts(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf[["filing_id", "section"]].assign(words=[sorted(doubtful(t)) for t in pdf["text"]])


def _split(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for i, s, t, known in zip(pdf["filing_id"], pdf["section"], pdf["text"], pdf["known"]):
        rows = {r["word"]: tuple(r[f] for f in FACTS) for r in known} if known is not None else {}
        begin = 0
        for n, e in enumerate(split(t, Corpus(rows))):
            out.append((i, s, n, e, t[begin:e].strip()))
            begin = e
    return pd.DataFrame(out, columns=["filing_id", "section", "sentence_no", "end_pos", "sentence"])


SENTENCES = "filing_id long, section string, sentence_no int, end_pos long, sentence string"


def sentences(filings: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(filing_id, section, sentence_no, end_pos, sentence); wanted: (filing_id, section) to split, with counts of all."""
    secs = common.sections(filings)
    mine = secs.join(wanted.select("filing_id", "section").distinct(), ["filing_id", "section"], "left_semi") if wanted is not None else secs
    mine = common.written(common.latest(mine, ["filing_id", "section"], ["text"]), "p4-texts")
    doubts = common.batches(mine, _doubts, "filing_id long, section string, words array<string>").select("filing_id", "section", F.explode("words").alias("word"))
    doubts = common.written(doubts, "p4-doubts")
    facts = corpus_counts(secs).join(doubts.select("word").distinct(), "word")  # of the words asked for, so that few are repeated
    known = common.join_salted(doubts, facts, "word", "filing_id")
    known = known.groupBy("filing_id", "section").agg(F.collect_list(F.struct("word", *FACTS)).alias("known"))
    return common.batches(mine.join(known, ["filing_id", "section"], "left"), _split, SENTENCES)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentences(common.table(spark, sf_dir, "filings_df"), common.table(spark, sf_dir, "sentence_sample"))
    return rows.select("filing_id", "section", "end_pos")


def p4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every section."""
    return sentences(common.table(spark, sf_dir, "filings_df"))


QUERIES = {"p4_found": p4_found, "p4_sentences": p4_sentences}
SQL: dict[str, str] = {}
