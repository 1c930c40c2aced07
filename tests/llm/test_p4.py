import pytest

from ledgerlark.llm import p4_sentences as p4


def parts(t, corpus=None):
    out, b = [], 0
    for e in p4.split(t, corpus):
        out.append(t[b:e].strip())
        b = e
    return out


CASES = [
    ["Dr. E. Venwick joined Prursor Inc. as head.", "See Note No. 5 and Sec. 13 of it."],
    ["Our clerks stop work at 6 p.m.", "Our demand rose."],
    ["“Will costs hold?” asked the auditor.", "The chair said, “We are ready.”", "Sales rose 3.5 percent."],
    ["The case ... which began in 2019 ... is open!", "Why?", "It is."],
    ["They won’t pay more…", "They left."],
    ["Für X wären z. B. höhere Löhne ein Risiko.", "Der Wert stieg im Mai und fiel bis zum 35. März 2019, d. h. im Jahr.", "Wird der Zins steigen?"],
    ["O Sr. Kavdris disse que sim.", "A gestão disse que não."],
    ["« Le bail a reculé », précise Prurlan.", "M. Telmünd a présenté le résultat.", "Où sera-t-il placé après 2015 ?"],
    ["По данным п. 21 отчёта, рынок вырос, т. е. на 5 млн руб.", "Риск вырос в 2015 г. и снизился."],
    ["ذكر د. Vuñstad أن الطلب ارتفع!", "هل يبقى العقد؟", "انخفض الإنفاق."],
    ["डॉ. Grundéx के अनुसार कम है।", "क्या बढ़ा रहेगा?"],
]


@pytest.mark.parametrize("want", CASES)
def test_spaced_scripts(want):
    assert parts(" ".join(want)) == want
    assert parts("\n".join(want)) == want


def test_scripts_without_blanks():
    assert parts("担当者は「需要は上昇した。」と述べました。利益は減少する。続くのか？") == ["担当者は「需要は上昇した。」と述べました。", "利益は減少する。", "続くのか？"]
    assert parts("管理层表示：“费用将会下降。”Trim公司能否恢复？同比上升34.3％，达到5万元。") == ["管理层表示：“费用将会下降。”", "Trim公司能否恢复？", "同比上升34.3％，达到5万元。"]
    assert parts("เราไม่ทราบว่าเพิ่มขึ้น บริษัทมี20.34ชิ้น\nกำไร") == ["เราไม่ทราบว่าเพิ่มขึ้น", "บริษัทมี20.34ชิ้น", "กำไร"]


def test_units_and_positions():
    t = "  Heading here\n\nOne two.\nThree four. \n \n\n“Five.”  "
    assert parts(t) == ["Heading here", "One two.", "Three four.", "“Five.”"]
    assert p4.split(t)[-1] == len(t.rstrip())
    dirty = "Ｓａｌｅｓ ｒｏｓｅ．\u00a0We\u200b lo\u0301st.\u2003It fell."
    assert parts(dirty) == ["Ｓａｌｅｓ ｒｏｓｅ．", "We\u200b lo\u0301st.", "It fell."]
    assert p4.split("") == [] and p4.split("   ") == [] and p4.split("x") == [1] and p4.split("cafe\u0301") == [5]


def test_corpus_decides_where_the_document_cant():
    t = "We met Xyz. Bolt in town."
    assert parts(t) == ["We met Xyz.", "Bolt in town."]
    title = p4.Corpus({"xyz": (0, 0, 0, 0, 9, 0, 0, 0), "bolt": (0, 5, 0, 0, 0, 0, 0, 0)})  # always dotted, before names only
    assert parts(t, title) == [t]
    common = p4.Corpus({"xyz": (0, 0, 5, 0, 6, 3, 0, 0), "bolt": (7, 5, 0, 0, 0, 0, 0, 0)})  # an abbreviation, then a common word
    assert parts(t, common) == ["We met Xyz.", "Bolt in town."]
    starter = p4.Corpus({"xyz": (0, 0, 0, 0, 9, 0, 0, 0), "bolt": (0, 5, 0, 0, 0, 0, 9, 0)})  # its capital stands at beginnings only
    assert parts(t, starter) == ["We met Xyz.", "Bolt in town."]
    assert parts(t + " A bolt fell.", title)[0] == "We met Xyz."  # the document comes first
    assert parts("See Abc. 5 of it.", p4.Corpus({"abc": (900, 900, 0, 5, 0, 1, 0, 0)})) == ["See Abc. 5 of it."]


@pytest.mark.parametrize("t", ["The board said no. The company agreed.", "It went up in the last sec. The rate rose.", "It was filed on the art. We sold.", "It is a fig. Prices fell."])
def test_words_of_the_list_end_sentences_too(t):
    assert len(parts(t)) == 2


def test_the_list_only_counts_without_evidence(monkeypatch):
    """With evidence of the corpus the list changes nothing; without both, abbreviations end sentences."""
    titles = {w: (0, 0, 0, 0, 20, 1, 0, 0) for w in ("dr", "mr", "sr", "z")} | {w: (0, 3, 0, 20, 0, 0, 0, 0) for w in ("no", "sec", "art")}
    text = "See Note No. 5 and Sec. 13 of it. Mr. Venwick met Dr. Bolt. O Sr. Kavdris disse. Selon l’art. 5 la vente baisse. Für X wären z. B. Löhne ein Risiko."
    want = ["See Note No. 5 and Sec. 13 of it.", "Mr. Venwick met Dr. Bolt.", "O Sr. Kavdris disse.", "Selon l’art. 5 la vente baisse.", "Für X wären z. B. Löhne ein Risiko."]
    assert parts(text) == parts(text, p4.Corpus(titles)) == want
    monkeypatch.setattr(p4, "PRIOR_NUMBER", set())
    monkeypatch.setattr(p4, "PRIOR_NAME", set())
    assert parts(text, p4.Corpus(titles)) == want
    assert len(parts(text)) > len(want)


def test_time_is_linear():
    """Long texts with a stop after each word, long words, long blanks, marks that never close."""
    import time

    for unit in ("It rose. We sold. ", "a.", "x" * 50, ". " + " " * 50, "« a »", "„ a. ", "No. 5 ", "1.5 "):
        took = []
        for n in (20_000, 80_000):
            t = unit * (n // len(unit))
            began = time.process_time()
            p4.split(t)
            took.append(time.process_time() - began)
        assert took[1] < 12 * took[0] + 0.2, unit


def test_corpus_counts(spark, filings):
    f = filings([(1, "Xyz. Bolt sold. A sec. 5 it is. Xyz. B. rose, as Bolt did. Inc. and the rest. The Ltd. They", "Xyz. Over it. They ran over. Over? Over")])
    got = {r["word"]: tuple(r[c] for c in p4.FACTS) for r in p4.corpus_counts(p4.common.sections(f)).collect()}
    assert got["xyz"][4:6] == (2, 1)
    assert got["sec"][:4] == (1, 0, 0, 1) and got["inc"][2] == 1 and got["bolt"][7] == 1 and got["over"][0] == 1


def test_table(spark, filings):
    f = filings([(1, "One two. Three.", None, 1), (1, "One two. Three four.", None, 5), (2, None, "A b."), (3, "", "  "), (None, "X. Y.", None)])
    got = [(r["filing_id"], r["section"], r["end_pos"]) for r in p4.sentences(f).collect()]
    assert sorted(got) == [(1, "item_1a", 8), (1, "item_1a", 20), (2, "mda", 4)]
    wanted = spark.createDataFrame([(2, "mda"), (2, "mda"), (9, "mda")], "filing_id long, section string")
    assert [r["sentence"] for r in p4.sentences(f, wanted).collect()] == ["A b."]
    assert p4.sentences(filings([])).collect() == []
