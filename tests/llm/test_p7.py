import pytest

from ledgerlark.llm import common, p7_garbled as p7

CLEAN = ["The board’s view of Köldale — it changed. Café déjà vu.", "Показатель рынок вырос на складе и составил рублей.", "ÂGE MOYEN ET CHÂTEAU D’EAU. GESTÃO E AVALIAÇÃO. AÑO FISCAL", "当社は海外で部品を保有しています。利益は減少する見込みです。", "公司的利润能否在海外恢复？管理层表示：“贷款将会上升。”", "เราไม่ทราบว่าเงินกู้จำนวนรายการในคลัง", "“Quick” «test» £5 €7 §3"]


def garble(t, right, wrong, errors="strict"):
    return p7.read(t.encode(right), wrong) if wrong != "utf-8" else t.encode(right).decode("utf-8", errors)


GARBLED = [
    (garble(CLEAN[0], "utf-8", "cp1252"), CLEAN[0]), (garble(CLEAN[0], "utf-8", "latin-1"), CLEAN[0]), (garble(CLEAN[0], "utf-8", "mac_roman"), CLEAN[0]), (garble(CLEAN[0], "utf-8", "cp437"), CLEAN[0]), (garble(CLEAN[0], "utf-8", "cp1251"), CLEAN[0]),
    (garble(garble(CLEAN[0], "utf-8", "cp1252"), "utf-8", "cp1252"), CLEAN[0]), (garble(CLEAN[1], "utf-8", "cp1252"), CLEAN[1]), (garble(CLEAN[1], "cp1251", "latin-1"), CLEAN[1]), (garble(CLEAN[1], "koi8-r", "cp1251"), CLEAN[1]),
    (garble(CLEAN[3], "shift_jis", "cp1252"), CLEAN[3]), (garble(CLEAN[4], "gbk", "latin-1"), CLEAN[4]), (garble(CLEAN[5], "utf-8", "latin-1"), CLEAN[5]),
]


@pytest.fixture(scope="module")
def table(filings):
    rows = [(10 * n + i, t) for i, t in enumerate(CLEAN) for n in range(1, 4)]
    rows += [(1000 + i, g) for i, (g, _) in enumerate(GARBLED)] + [(2000, garble("Sales at Köldale rose.", "cp1252", "utf-8", "replace")), (2001, "Lost � for ever")]
    return filings([*rows, (3000, None, ""), (3001, "plain ascii"), (None, GARBLED[0][0]), (3002, "Clean CHÂTEAU", None, 9), (3002, GARBLED[0][0], None, 2)])


def test_found(table):
    got = {(r["filing_id"], r["section"]) for r in p7.found(common.sections(table)).collect()}
    assert got == {(1000 + i, "item_1a") for i in range(len(GARBLED))} | {(2000, "item_1a"), (2001, "item_1a")}


def test_restored(table):
    got = {r["filing_id"]: r for r in p7.restored(common.sections(table)).collect()}
    for i, (_, want) in enumerate(GARBLED):
        if i not in (7, 8, 9):  # words of one letter, and Japanese runs with ASCII trail bytes, may stay
            assert got[1000 + i]["text"] == want, i
    assert "рынок вырос на складе" in got[1007]["text"] and "рынок вырос на складе" in got[1008]["text"]
    assert got[2000]["text"] == "Sales at Köldale rose." and not got[2001]["complete"] and got[2001]["text"] == "Lost � for ever"


def test_nothing(filings):
    assert p7.found(common.sections(filings([]))).collect() == []
    assert p7.found(common.sections(filings([(1, "é", "ß"), (2, "Ã", "Â")]))).collect() == []


@pytest.mark.parametrize("right, wrong", [("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "mac_roman")])
def test_copies_do_not_turn_the_direction(filings, right, wrong):
    """Garbled copies outnumber the clean text, as one text and with a number of their own; the words are in one clean text."""
    bad = garble(CLEAN[1], right, wrong)
    hot = [(100 + i, bad if i % 2 else f"{bad} {i}") for i in range(30)]
    got = p7.restored(common.sections(filings([(1, CLEAN[1]), (2, "Clean CHÂTEAU"), *hot]))).collect()
    assert {r["filing_id"] for r in got} == {i for i, _ in hot}
    assert all("рынок вырос" in r["text"] and r["chains"] == [f"{right}>{wrong}"] for r in got)


def test_tie_and_hot_accents(filings):
    bad, good = garble("Le café déjà fermé", "cp1252", "cp1251"), "Le café déjà fermé"
    got = {r["filing_id"] for r in p7.found(common.sections(filings([(1, good), (2, bad)]))).collect()}
    assert got == {2}
    rows = [(i, good) for i in range(20)] + [(100, CLEAN[1])] + [(200 + i, f"{garble(CLEAN[1], 'cp1251', 'latin-1')} {i}") for i in range(20)]
    assert {r["filing_id"] for r in p7.found(common.sections(filings(rows))).collect()} == {200 + i for i in range(20)}
