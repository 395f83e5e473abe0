import pytest

from emberquill.llm import lookalikes as L

ZWJ, NBSP, SHY = chr(0x200D), chr(0xA0), chr(0xAD)
FAMILY = "👩" + ZWJ + "🌾"
CASES = [
    ("Ｌｕ１", "Lu1", ["width"]), ("e" + chr(0x301), "é", ["accent"]), ("é", "é", []), ("火" + ZWJ + "水", "火水", ["invisible"]), (FAMILY, FAMILY, []), ("a" + SHY + "b", "ab", ["invisible"]),
    ("a" + NBSP + "b", "a b", ["space"]), ("a　b", "a　b", []), (chr(0x2F54), "水", ["ideograph"]), (chr(0xF907), "龜", ["ideograph"]), ("N" + chr(0x43E) + "ë", "Noë", ["script"]), ("Нева", "Нева", []), ("α", "α", []),
    ("超能カ", "超能力", ["katakana"]), ("ー般", "一般", ["katakana"]), ("カメラ", "カメラ", []), ("，。！（）", "，。！（）", []), ("", "", []), ("q" + chr(0x303), "q" + chr(0x303), ["accent"]), (chr(0x2E9D), "月", ["ideograph"]),
]


@pytest.mark.parametrize("text,form,kinds", CASES)
def test_forms(spark, text, form, kinds):
    assert L.Rewriter(L.rewrites(L.classes(spark), {}))(text) == (form, kinds)


def test_classes_are_closed_and_disjoint(spark):
    classes = L.classes(spark)
    members = [m for c in classes for m in c]
    assert len(members) == len(set(members))
    assert any({"a", "ａ", chr(0x430), chr(0x3B1)} <= set(c) for c in classes)


def test_representatives_follow_frequency(spark):
    g, enclosure = chr(0x261), chr(0x56D7)  # a script g, and the ideograph that looks like a mouth
    rows = lambda *texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, text string")
    wide, radical = chr(0xFF47), chr(0x2F1D)
    form = lambda *texts: {r["k"]: r["form"] for r in L.consistent(rows(*texts), ["k"]).collect()}
    assert form(wide, "g g", g)[0] == "g"
    assert form(radical, "口", enclosure, enclosure)[0] == enclosure and form(radical, "口口", enclosure)[0] == "口"
    several = [odd for odd, plain, kind in L.rewrites(L.classes(spark), {}) if sum(L._fits(odd, kind, m) and L.kind_of(m) is None for c in L.classes(spark) if odd in c for m in c) > 1]
    assert len(several) > 20


def test_letters_and_marks_without_a_plain_form_are_found(spark):
    again = L.Rewriter(L.rewrites(L.classes(spark), {}))
    zhe = chr(0x436)
    assert again("na" + zhe) == ("na" + zhe, ["script"]) and again(zhe) == (zhe, [])
    assert again(chr(0xFF45) + chr(0x301)) == (chr(0xE9), ["accent", "width"])


def test_forms_are_stable(spark):
    rows = spark.createDataFrame([(i, t, "x") for i, (t, _, _) in enumerate(CASES)] + [(900, None, "x"), (901, "字" * 100_000, "x"), (0, CASES[0][0], "x")], "k long, text string, form string")
    got = L.consistent(rows, ["k"]).collect()
    assert len(got) == len(CASES) + 3
    assert {r["k"]: (r["form"], r["kinds"]) for r in got}[900] == (None, [])
    again = L.Rewriter(L.rewrites(L.classes(spark), {}))
    assert all(again(r["form"])[0] == r["form"] for r in got if r["form"])
    assert L.consistent(rows.limit(0), ["k"]).count() == 0
