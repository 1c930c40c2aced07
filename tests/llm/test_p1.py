import random
import unicodedata as ud

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlark.llm import common, forms, p1_lookalike as p1

CLEAN = "The office of Köldale filed 12 reports. Показатель рынок вырос, first effort."
WIDE = str.maketrans({chr(c): chr(c + 0xFEE0) for c in range(0x21, 0x7F)})


def dirty(t, seed):
    r, out = random.Random(seed), []
    twins = {v: k for k, v in forms.LOOKALIKE.items()}
    for w in t.split(" "):
        k = r.randrange(5)
        w = w.translate(WIDE) if k == 0 else ud.normalize("NFD", w) if k == 1 else "".join(twins.get(c, c) for c in w) if k == 2 else w.replace("ffi", "ﬃ").replace("fi", "ﬁ") if k == 3 else "\u200b".join(w)
        out.append(w)
    return r.choice([" ", "\u00a0", "\u2003", " \n "]).join(out)


def test_dirt_doesnt_count_and_differences_do():
    for i in range(60):
        assert forms.skeleton(dirty(CLEAN, i)) == forms.skeleton(CLEAN)
    for other in (CLEAN.lower(), CLEAN.replace("ö", "o"), CLEAN.replace("12", "13"), CLEAN.replace("first", "fist"), CLEAN.replace(".", ",")):
        assert forms.skeleton(other) != forms.skeleton(CLEAN)


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_form_is_stable(t):
    once = forms.skeleton(t)
    assert forms.skeleton(once) == once


def test_trie_takes_the_native_spelling():
    t = p1.Trie()
    for w, n in (("рост", 5), ("page", 9), ("pase", 1), ("köln", 1)):
        t.add(w, n)
    assert t.match("poст") == "рост" and t.match("pаgе") == "page" and t.match("ｐａｇｅ") == "page" and t.match("ko\u0308ln") == "köln" and t.match("p\u200bage") == "page"
    assert t.match("pags") is None and t.match("pags", budget=1) == "page" and t.match("koln") is None and t.match("pge", budget=1) == "page" and t.match("paage", budget=1) == "page"


def test_pairs_against_brute_force(spark, filings):
    texts = [CLEAN, dirty(CLEAN, 1), dirty(CLEAN, 2), CLEAN, CLEAN + " more", dirty(CLEAN + " more", 3), "alone", None, "", "   ", CLEAN.lower()]
    rows = [(i, t, t) for i, t in enumerate(texts)] + [(1, texts[1], texts[1], 5), (None, CLEAN, CLEAN)]
    got = {tuple(r) for r in p1.found_pairs(filings(rows)).collect()}
    want = {(i, j, s) for i in range(len(texts)) for j in range(i + 1, len(texts)) for s in ("item_1a", "mda") if texts[i] and texts[j] and texts[i].strip() and texts[i] != texts[j] and forms.skeleton(texts[i]) == forms.skeleton(texts[j])}
    assert got == want and len(got) > 5


def test_latest_delivery_counts(filings):
    got = p1.found_pairs(filings([(1, "same text", None, 1), (1, "same\u00a0text", None, 9), (2, "same\u00a0text", None, 1)])).collect()
    assert got == []


def test_native_words_in_latin_letters_only(filings):
    rows = [(1, "Руководство рынок"), (2, "Руководство рынок".translate({ord(k): v for k, v in forms.LOOKALIKE.items()})), (3, "Рукoводство рынок")]
    got = {(r[0], r[1]) for r in p1.found_pairs(filings(rows)).collect()}
    assert got == {(1, 2), (1, 3), (2, 3)}


def test_forms_are_readable(spark, filings):
    rows = p1.forms_of(common.sections(filings([(1, "рост вырос"), (2, "poст выpoс")])), keep=True).collect()
    assert {r["form"] for r in rows} == {"рост вырос"}


def test_nothing(filings):
    assert p1.found_pairs(filings([])).collect() == []


def test_a_hot_token_and_a_hot_class(filings):
    """A third of the rows share a token to look up, and one class has many members and spellings."""
    rows = [(i, "ｐａｇｅ " + ("x" if i % 2 else "ｘ")) for i in range(40)] + [(100 + i, f"page {i}") for i in range(80)]
    got = {(r[0], r[1]) for r in p1.found_pairs(filings(rows)).collect()}
    assert got == {(i, j) for i in range(40) for j in range(i + 1, 40) if i % 2 != j % 2}


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_tokens_by_pieces_are_those_of_the_whole_text(t):
    plain, other = p1.tokens(t)
    whole = set(p1.token_pattern().findall(t))
    assert other == {x for x in whole if not x.isascii()} and plain == {x for x in whole if x.isascii()}
