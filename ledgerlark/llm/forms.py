"""The one form of texts that read the same: fixed tables and string functions (no Spark)."""

from __future__ import annotations

import re
import sys
import unicodedata as ud
from functools import lru_cache

# Letters of other alphabets and the Latin letter they look like.
LOOKALIKE_PAIRS = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝҮӀ", "ABESIJKMHOPCTYXaesijopcyxhdqwYl"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαιν", "ABEZHIKMNOPTYXoaiv"),
    "Armenian": ("օսհոՕՍ", "ouhnOU"),
}
# Format characters that are visible, so not ignorable.
VISIBLE_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
# Ignorable characters outside the category Cf.
OTHER_INVISIBLE = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85"
FOLDED = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>")

# Greek alpha, iota and nu are apart from the Latin letters in most typefaces, so they are not taken as equal.
LOOKALIKE = {g: l for _, (own, latin) in LOOKALIKE_PAIRS.items() for g, l in zip(own, latin) if g not in "αιν"}


@lru_cache(1)
def tables() -> tuple[dict[int, str], re.Pattern, dict[int, str], re.Pattern]:
    """What each special character becomes; the pattern of special characters; look-alikes and their pattern."""
    special: dict[int, str] = {}
    for i in range(0xA0, sys.maxunicode + 1):
        ch = chr(i)
        cat = ud.category(ch)
        if cat in ("Cn", "Co", "Cs"):
            continue
        if cat == "Cf" and i not in VISIBLE_FORMAT or i in OTHER_INVISIBLE:
            special[i] = ""
        elif cat in ("Zs", "Zl", "Zp"):
            special[i] = " "
        else:
            d = ud.decomposition(ch)
            if d.startswith(FOLDED) or d.startswith("<compat>") and "LIGATURE" in ud.name(ch, ""):
                special[i] = ud.normalize("NFKC", ch)
    special.update({ord(c): " " for c in BLANKS})
    special[0xAD] = ""
    look = {ord(a): b for a, b in LOOKALIKE.items()}
    return special, char_class(special), look, char_class(look)


def char_class(codes) -> re.Pattern:
    """A pattern of one character out of many, as ranges."""
    out, codes = [], sorted(codes)
    start = prev = None
    for c in [*codes, None]:
        if prev is not None and c == prev + 1:
            prev = c
            continue
        if start is not None:
            out.append(re.escape(chr(start)) + ("-" + re.escape(chr(prev)) if prev > start else ""))
        start = prev = c
    return re.compile("[" + "".join(out) + "]")


def shape(text: str) -> str:
    """Width, ligatures, ignorables, blanks and accents in one form; letters of other alphabets stay."""
    special, found, _, _ = tables()
    if not text.isascii():
        if found.search(text):
            text = found.sub(lambda m: special[ord(m[0])], text)
        if not ud.is_normalized("NFC", text):
            text = ud.normalize("NFC", text)
    return text


def folded(text: str) -> str:
    """Letters of other alphabets as the Latin letter they look like."""
    _, _, look, found = tables()
    if text.isascii():
        return text
    if not found.search(text):
        d = ud.normalize("NFD", text)
        if not found.search(d):
            return text
        return ud.normalize("NFC", d.translate(look))
    return ud.normalize("NFC", ud.normalize("NFD", text).translate(look))


def blanks(text: str) -> str:
    return " ".join(text.split())


def skeleton(text: str) -> str:
    """The form by table: two texts have the same skeleton if and only if they read the same."""
    return blanks(folded(shape(text)))


WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Longest runs of letters or digits, in lower case."""
    return WORD.findall(text.lower())
