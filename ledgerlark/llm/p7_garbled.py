"""Problem 7: text decoded with the wrong character encoding, found and restored.

Every distinct clean token of the corpus (a run of characters outside ASCII, or a word that holds one) is encoded and
decoded again under all chains of encodings, and the garbled forms are hash-joined with the tokens of the corpus. Which
of both is garbled is told by how natural they read (``cost``), summed over a section's tokens of the same chain, and
only where that leaves it open by the number of different texts that hold them: copies of a text move neither. The
characters of the clean tokens are the smallest units: their garbled forms (a table bounded by the number of
characters in Unicode) tile the parts that no whole token matches. A lossy form (with U+FFFD) may have several
originals; then it is found but not restored.

Results: a section with any such part is a case. Where tiles or tokens give no single original, the stored characters
stay and ``complete`` is false. NULL and blank sections, and rows without filing_id, give nothing. Of a filing
delivered several times the latest delivery counts."""

from __future__ import annotations

import math
import re
import unicodedata as ud
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import common

LOST = "�"
# Encodings that text is wrongly read with, by what it was written in.
READ_UTF8_AS = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp866", "koi8-r", "cp1250", "cp1254", "iso8859-15", "mac_cyrillic", "cp1253"]
TWICE = [("latin-1", "latin-1"), ("cp1252", "cp1252"), ("latin-1", "cp1252"), ("cp1252", "latin-1"), ("mac_roman", "mac_roman"), ("cp437", "cp437"), ("cp850", "cp850"), ("cp1251", "cp1251")]
WIDE = ["gbk", "shift_jis", "euc_jp", "big5", "euc_kr"]
READ_WIDE_AS = ["latin-1", "cp1252", "mac_roman", "cp437", "cp1251"]
NARROW = {
    "cp1251": ["latin-1", "cp1252", "koi8-r", "cp866", "mac_cyrillic", "mac_roman", "cp437", "iso8859-5"],
    "koi8-r": ["latin-1", "cp1252", "cp1251", "cp866", "mac_cyrillic"],
    "cp866": ["latin-1", "cp1252", "cp1251", "koi8-r", "cp437"],
    "iso8859-5": ["latin-1", "cp1252", "cp1251", "koi8-r"],
    "cp1256": ["latin-1", "cp1252", "cp1251"],
    "iso8859-6": ["latin-1", "cp1252"],
    "cp874": ["latin-1", "cp1252", "cp1251"],
    "cp1252": ["mac_roman", "cp437", "cp850", "cp1251", "cp1250"],
    "mac_roman": ["latin-1", "cp1252", "cp437"],
    "cp437": ["latin-1", "cp1252", "mac_roman"],
    "cp850": ["latin-1", "cp1252"],
}
LOSSY = ["cp1252", "latin-1", "mac_roman"]
RUN = re.compile(r"[^\x00-\x7f]+")
WORD = re.compile(r"[A-Za-z\x80-\U0010ffff]+")
#: Tiles in a row that make a case: forms in a script of their own can't stand alone by chance.
LEAST_TILES = {"utf-8": 1, "wide": 3}


@lru_cache(None)
def charset(name: str) -> str:
    """What each byte reads as; bytes without a character read as the control character of that number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def read(data: bytes, name: str) -> str:
    return data.decode("latin-1").translate(_translation(name))


@lru_cache(None)
def _translation(name: str) -> dict[int, str]:
    return {b: c for b, c in enumerate(charset(name)) if ord(c) != b}


class Chain:
    """An encoding that a text was written in, what it was read as, and what it becomes."""

    def __init__(self, kind: str, right: str, name: str = "", again: str = "") -> None:
        self.kind, self.right, self.wrong, self.again = kind, right, name, again
        self.label = f"utf-8>{name}>utf-8>{again}" if again else f"{right}>{name or 'utf-8'}"

    def form(self, text: str) -> str | None:
        """The garbled form; None where the encoding lacks a character."""
        try:
            data = text.encode(self.right, "surrogatepass" if self.right == "utf-8" else "strict")
        except UnicodeEncodeError:
            return None
        if self.kind == "lossy":
            return data.decode("utf-8", "replace")
        out = read(data, self.wrong)
        return read(out.encode("utf-8"), self.again) if self.again else out

    def counts(self, text: str, form: str) -> bool:
        """False where the chain changes the number of characters, or loses some, and this form shows neither."""
        return len(form) > len(text) if self.kind == "wide" else LOST in form if self.kind == "lossy" else True


#: In the order of preference among chains that give the same form.
WIDE_CHAINS = [Chain("utf-8", "utf-8", n) for n in READ_UTF8_AS] + [Chain("utf-8", "utf-8", a, b) for a, b in TWICE] + [Chain("wide", w, n) for w in WIDE for n in READ_WIDE_AS]
NARROW_CHAINS = [Chain("narrow", right, n) for right, names in NARROW.items() for n in names] + [Chain("lossy", right) for right in LOSSY]
CHAINS = WIDE_CHAINS + NARROW_CHAINS


def wide_forms(text: str) -> list[tuple[str, str]]:
    """(garbled form, chain) of a text under the chains that turn a character into several."""
    forms = [(c.form(text), c) for c in WIDE_CHAINS]
    return [(f, c.label) for f, c in forms if f is not None and c.counts(text, f)]


def forms_of(token: str) -> dict[str, str]:
    """The garbled forms of a token and the first chain that gives each."""
    out: dict[str, str] = {}
    for c in CHAINS:
        f = c.form(token)
        if f is not None and f != token and f not in out and c.counts(token, f):
            out[f] = c.label
    return out


#: Bits of the filter of the corpus's tokens: 8 MB whatever the corpus; a full filter only lets more forms through.
FILTER_BITS = 1 << 26


def probes(token: str) -> tuple[int, int]:
    h = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
    return h & (FILTER_BITS - 1), (h >> 32) & (FILTER_BITS - 1)


def _filter_words(pdf: pd.DataFrame) -> pd.DataFrame:
    bits = np.unique(np.array([p for t in pdf["token"] for p in probes(t)], dtype=np.int64))
    masks = np.uint64(1) << (bits & 63).astype(np.uint64)
    return pd.DataFrame({"word": bits >> 6, "mask": masks.view(np.int64)}).groupby("word", as_index=False).agg({"mask": lambda m: np.bitwise_or.reduce(m.to_numpy())})


def token_filter(vocab: DataFrame) -> bytes:
    """A Bloom filter of the tokens of the corpus, of FILTER_BITS."""
    words = np.zeros(FILTER_BITS // 64, np.int64)
    rows = common.batches(vocab.select("token"), _filter_words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words[rows.column("word").to_numpy()] = rows.column("mask").to_numpy()
    return words.astype("<i8").tobytes()


def plain(token: str) -> bool:
    """True if the token may be clean: no control characters or losses, natural case, and not UTF-8 read wrongly."""
    if any(ud.category(c) in ("Cc", "Co", "Cn") or c == LOST for c in token):
        return False
    letters = [c for c in token if c.isalpha()]
    if letters and not (token.islower() or token.isupper() or token.istitle() or not any(c.isupper() for c in token[1:])) and not any("a" <= c <= "z" for c in token):
        return False
    run = "".join(c for c in token if ord(c) > 127)
    if len(run) < 2:
        return True
    for name in ("latin-1", "cp1252", "mac_roman", "cp437", "cp850", "cp1251"):
        try:
            data = bytes(_byte_of(name)[c] for c in run)
            data.decode("utf-8")
            return False
        except (KeyError, UnicodeDecodeError):
            pass
    return True


@lru_cache(None)
def _byte_of(name: str) -> dict[str, int]:
    return {c: b for b, c in enumerate(charset(name))}


def tokens(text: str) -> set[str]:
    """Runs outside ASCII, and words that hold such a run and ASCII letters."""
    if text.isascii():
        return set()
    out = set(RUN.findall(text))
    out.update(w for w in WORD.findall(text) if not w.isascii())
    return out


def _units(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = [(x, raw) for raw, t in dict(zip(pdf["raw"], pdf["text"])).items() for x in tokens(t)]
    return pd.DataFrame(rows, columns=["token", "raw"])


@lru_cache(None)
def kind(ch: str) -> str:
    """The script of a letter or mark; "bad" for what no clean text holds, "sign" for other signs, "" for punctuation and blanks."""
    c = ud.category(ch)
    if c in ("Cc", "Co", "Cn", "Cs") or ch == LOST:
        return "bad"
    if c[0] in "LM":
        return ud.name(ch, "?").split()[0] if ch not in "ªº" else "sign"
    return "" if c[0] in "PZ" or c == "Cf" else "sign"


#: Shares of the letters in Russian text, per mille; a letter of another Cyrillic alphabet counts as OTHER.
CYRILLIC = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (110, 85, 80, 74, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 16, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 0.4, 0.4)))
OTHER = 1.0
#: Nats of surprise: a letter of any alphabet, one outside ASCII in Latin text, and what clean words hardly have.
LETTER, ACCENT, SIGN, BAD, BREAK = 3.0, 5.0, 6.0, 12.0, 5.0
#: Nats that decide for a section's tokens together, and for one token alone.
DECIDED, ALONE = 2.0, 6.0


@lru_cache(None)
def _letter(ch: str) -> float:
    k = kind(ch)
    if k == "CYRILLIC":
        return -math.log(CYRILLIC.get(ch.lower(), OTHER) / 1000)
    return {"": LETTER, "sign": SIGN, "bad": BAD}.get(k, ACCENT if k == "LATIN" and ord(ch) > 127 else LETTER)


def cost(token: str) -> float:
    """How little a token reads as words of one script, in nats: the less, the more natural."""
    total, last = 0.0, ""
    for ch in token:
        total += _letter(ch)
        if last:
            a, b = kind(last), kind(ch)
            if a.isupper() and b.isupper():  # both letters
                if a != b and not {a, b} <= SAME:
                    total += BREAK
                elif last.islower() and ch.isupper():
                    total += BREAK
                elif a == b == "LATIN" and ord(last) > 127 and ord(ch) > 127:
                    total += LETTER
                elif last.isupper() and ch.isupper():
                    total += 0.3
            elif a.isupper() and b in ("sign", "bad") or b.isupper() and a in ("sign", "bad"):
                total += LETTER
        last = ch
    return total


#: Scripts that stand side by side in one word, and marks.
SAME = {"CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "HALFWIDTH", "FULLWIDTH", "HANGUL", "IDEOGRAPHIC"}


def western(ch: str) -> bool:
    """A Latin letter or a sign: one alone may be garbled; other scripts come in runs."""
    return ud.name(ch, "").startswith("LATIN") or not ch.isalpha() and (ord(ch) < 0x300 or 0x2000 <= ord(ch) < 0x2C00)


def strong(form: str, token: str, chain: str) -> bool:
    """True if a form can't be a clean word by chance; the others count only beside a strong one of their chain."""
    if LOST in form:
        return True
    odd = [c for c in token if ord(c) > 127]
    if chain.startswith("utf-8"):
        return len(odd) > 1 or western(odd[0])
    if len(form) > len(token):
        return len(odd) > 1
    return not any(c.isspace() for c in form) and (sum(ord(c) > 127 and c.isalpha() for c in form) >= 3 or len(form) >= 5 and form.isalpha())


def _forms(held):
    """The forms of the clean tokens of a batch that the filter doesn't tell to be absent from the corpus."""

    def there(form: str, bits: bytes) -> bool:
        a, b = probes(form)
        return bool(bits[a >> 3] >> (a & 7) & 1 and bits[b >> 3] >> (b & 7) & 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = held.value
        rows = [(f, t, chain, n, strong(f, t, chain)) for t, n in zip(pdf["token"], pdf["n"]) if plain(t) for f, chain in forms_of(t).items() if there(f, bits)]
        return pd.DataFrame(rows, columns=["token", "original", "chain", "original_n", "strong"])

    return run


def _chars(pdf: pd.DataFrame) -> pd.DataFrame:
    n = Counter()
    for token, c in zip(pdf["token"], pdf["n"]):
        if plain(token):
            for ch in set(token):
                if ord(ch) > 127:
                    n[ch] += int(c)
    return pd.DataFrame({"ch": list(n), "n": list(n.values())})


class Tiles:
    """Garbled forms of single characters; finds the stretches of a text that they tile."""

    def __init__(self, chars: list[tuple[str, int]]) -> None:
        self.forms: dict[str, dict[str, tuple[str, int]]] = {}  # form -> chain -> character, its count
        self.rank: dict[str, int] = {}  # of chains that explain as much, the first listed is taken
        for ch, n in chars:
            for form, chain in wide_forms(ch):
                self.rank.setdefault(chain, len(self.rank))
                if len(form) > 1 and form != ch:
                    known = self.forms.setdefault(form, {})
                    if chain not in known or known[chain][1] < n:
                        known[chain] = (ch, n)
        self.lengths: dict[str, list[int]] = {}
        for form in self.forms:
            own = self.lengths.setdefault(form[0], [])
            if len(form) not in own:
                own.append(len(form))
        for own in self.lengths.values():
            own.sort(reverse=True)

    def stretch(self, text: str, at: int) -> tuple[int, str, str, int] | None:
        """(end, decoded, chain, tiles) of the stretch from `at`: the chain that explains most."""
        best = None
        chains = {c for k in self.lengths[text[at]] for c in self.forms.get(text[at : at + k], ())}
        for chain in sorted(chains, key=self.rank.__getitem__):
            i, out = at, []
            while i < len(text):
                for k in self.lengths.get(text[i], ()):
                    hit = self.forms.get(text[i : i + k], {}).get(chain)
                    if hit:
                        out.append(hit[0])
                        i += k
                        break
                else:
                    break
            if out and (best is None or (i, -len(out)) > (best[0], -best[3])):
                best = (i, "".join(out), chain, len(out))
        return best

    def accepted(self, text: str, at: int, found: tuple[int, str, str, int]) -> bool:
        end, decoded, chain, n = found
        if not chain.startswith("utf-8"):
            return n >= LEAST_TILES["wide"]
        if n > 1 and not all(ord(c) > 0x2E7F or 0x370 <= ord(c) < 0x2000 for c in decoded):
            return True
        beside = text[max(0, at - 1) : at] + text[end : end + 1]
        cyrillic = any("CYRILLIC" in ud.name(c, "") for c in beside)
        if n == 1:
            return western(decoded[0]) and not (cyrillic and ("1251" in chain or "866" in chain or "koi8" in chain or "cyrillic" in chain))
        return n >= (3 if cyrillic else 2)

    def find(self, text: str) -> list[tuple[int, int, str, str]]:
        """(begin, end, decoded, chain) of the garbled stretches."""
        out, i = [], 0
        if text.isascii():
            return out
        for m in RUN.finditer(text):
            i = max(i, m.start())
            while i < m.end():
                if text[i] in self.lengths:
                    found = self.stretch(text, i)
                    if found and self.accepted(text, i, found):
                        out.append((i, found[0], found[1], found[2]))
                        i = found[0]
                        continue
                i += 1
        return out


def vocabulary(secs: DataFrame) -> DataFrame:
    """(token, n different texts) of all tokens outside ASCII."""
    rows = common.batches(secs.select("text", F.xxhash64("text").alias("raw")), _units, "token string, raw long")
    return rows.distinct().groupBy("token").agg(F.count("*").alias("n"))


def _leads(pdf: pd.DataFrame) -> pd.DataFrame:
    lead = [BAD if LOST in t else cost(t) - cost(o) for t, o in zip(pdf["token"], pdf["original"])]
    return pdf.assign(lead=lead)


def originals(vocab: DataFrame) -> DataFrame:
    """(token, original, chain, strong, lead, more): tokens of the corpus that are a form of another one, by chain.

    lead: by how much the original reads better; more: it is in more texts. The original is NULL where there are several."""
    held = vocab.sparkSession.sparkContext.broadcast(token_filter(vocab))
    forms = common.batches(common.spread(vocab, "token"), _forms(held), "token string, original string, chain string, original_n long, strong boolean")
    # many times the size that Spark sees, so a broadcast would be chosen wrongly
    hit = common.batches(forms.hint("merge").join(vocab, "token"), _leads, "token string, original string, chain string, original_n long, strong boolean, n long, lead double")
    best = F.max(F.struct("original_n", "original", "lead", (F.col("original_n") > F.col("n")).alias("more")))
    rows = hit.groupBy("token", "chain").agg(best.alias("b"), F.min("original").alias("x"), F.max("original").alias("y"), F.max("strong").alias("strong"))
    one = (F.col("x") == F.col("y")) | ~F.col("token").contains(LOST)
    return rows.select("token", F.when(one, F.col("b.original")).alias("original"), "chain", "strong", "b.lead", "b.more")


def _scan(held):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tiles = held.value
        found = [len(tiles.find(t)) for t in pdf["text"]]
        toks = [sorted(x for x in tokens(t) if len(x) > 1 or LOST in x) for t in pdf["text"]]
        return pdf[["filing_id", "loaded_at", "section", "raw"]].assign(tiles=found, tokens=toks)

    return run


KEY = ["filing_id", "section", "raw"]


def judged(matched: DataFrame, *more) -> DataFrame:
    """(KEY, chain, *more) of the chains that garbled a section: its tokens together, or one of them alone, read better before."""
    sure = F.when(F.col("strong"), F.col("lead"))
    rows = matched.groupBy(*KEY, "chain").agg(F.sum("lead").alias("all"), F.max(sure).alias("top"), F.max(F.col("strong") & F.col("more")).alias("most"), *more)
    open_ = (F.col("all") > -DECIDED) & F.col("most")
    rows = rows.where(F.col("top").isNotNull() & ((F.col("top") >= ALONE) | (F.col("all") >= DECIDED) | open_))
    return rows.drop("all", "top", "most")


def _prepared(secs: DataFrame):
    """The tiles; (KEY, loaded_at, tiles, tokens) of the sections that hold any; their tokens that are garbled forms."""
    secs = secs.where(F.col("text").rlike(r"[^\x00-\x7F]"))  # ASCII holds no garbled text and no token of its own
    vocab = common.written(vocabulary(secs), "p7-vocabulary")
    chars = common.batches(vocab, _chars, "ch string, n long").groupBy("ch").agg(F.sum("n").alias("n"))
    # at most one row for each character of Unicode
    held = secs.sparkSession.sparkContext.broadcast(Tiles([(r["ch"], r["n"]) for r in chars.collect()]))
    rows = common.batches(secs.withColumn("raw", F.xxhash64("text")), _scan(held), "filing_id long, loaded_at timestamp, section string, raw long, tiles int, tokens array<string>")
    rows = common.written(rows.where("tiles > 0 or size(tokens) > 0"), "p7-scanned")
    own = common.spread(rows.select(*KEY, "tokens"), "filing_id").select(*KEY, F.explode("tokens").alias("token")).distinct()
    return held, rows, common.join_salted(own, originals(vocab), "token", "filing_id")


def found(secs: DataFrame) -> DataFrame:
    """(filing_id, section) of the sections that hold garbled text, in their latest delivery: whole tokens by the join,
    stretches inside a token (a blank or a letter lost beside them) by the tiles of garbled characters."""
    _, rows, matched = _prepared(secs)
    hit = judged(matched).select(*KEY).distinct().unionByName(rows.where("tiles > 0").select(*KEY)).distinct()
    # deliveries without any token outside ASCII are clean, but have to be seen as the latest ones
    every = secs.select("filing_id", "section", F.xxhash64("text").alias("raw"), "loaded_at")
    return common.latest(every, ["filing_id", "section"], ["raw"]).join(hit, KEY, "left_semi").select("filing_id", "section")


def restored(secs: DataFrame) -> DataFrame:
    """(filing_id, section, chains, complete, text) of each garbled section, with originals in place."""
    held, rows, matched = _prepared(secs)
    pair = F.when(F.col("lead") > -DECIDED, F.struct("token", "original", "chain", "strong"))  # words that read well stay
    pairs = judged(matched, F.collect_list(pair).alias("pairs")).groupBy(*KEY).agg(F.flatten(F.collect_list("pairs")).alias("pairs"))
    cases = rows.select(*KEY, "tiles").distinct().join(pairs, KEY, "left").where("tiles > 0 or pairs is not null").select(*KEY, "pairs")
    texts = secs.withColumn("raw", F.xxhash64("text")).join(cases, KEY).select(*KEY, "loaded_at", "text", "pairs")

    def repair(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t, ps in zip(pdf["text"], pdf["pairs"]):
            chains: set[str] = set()
            parts, at = [], 0
            for b, e, decoded, chain in held.value.find(t):
                parts += [t[at:b], decoded]
                at = e
                chains.add(chain)
            t = "".join([*parts, t[at:]])
            sure = Counter(p["chain"] for p in ps if p["strong"]) if ps is not None else {}
            by = {p["token"]: p for p in sorted(ps, key=lambda p: (sure[p["chain"]], p["strong"], p["chain"])) if p["chain"] in sure} if ps is not None else {}

            def swap(m: re.Match, by=by, chains=chains) -> str:
                p = by.get(m[0])
                if p is None or p["original"] is None:
                    return m[0]
                chains.add(p["chain"])
                return p["original"]

            t = RUN.sub(swap, WORD.sub(swap, t))
            out.append((sorted(chains), LOST not in t and not any(0x80 <= ord(c) < 0xA0 for c in t), t))
        extra = pd.DataFrame(out, columns=["chains", "complete", "text"], index=pdf.index)
        return pd.concat([pdf[["filing_id", "loaded_at", "section"]], extra], axis=1)

    done = common.batches(texts, repair, "filing_id long, loaded_at timestamp, section string, chains array<string>, complete boolean, text string")
    return common.latest(done, ["filing_id", "section"], ["chains", "complete", "text"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(common.sections(common.table(spark, sf_dir, "filings_df")))


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restored(common.sections(common.table(spark, sf_dir, "filings_df")))


QUERIES = {"p7_found": p7_found, "p7_restored": p7_restored}
SQL: dict[str, str] = {}
