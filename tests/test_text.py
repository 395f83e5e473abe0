import uuid
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from emberquill.functions import text as T
from emberquill.functions import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("  ＲＥＬＩＡＢＬＥ\n", "reliable"), (" A\t b ", "a b"), ("Straße", "strasse"), ("", ""), (None, None), ("，", ",")])
def test_canonical(spark, text, want):
    assert one(spark, T.canonical(F.lit(text).cast("string"))) == want


def test_identifiers(spark):
    assert one(spark, T.stable_id(F.lit("chunk"), F.lit("é"), F.lit("3"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "chunk:é:3"))
    assert one(spark, T.content_hash(F.lit("　a \n"))) == sha256(b"a").hexdigest()
    assert abs(one(spark, T.unit_hash(F.lit("a"), F.lit("b"))) - int.from_bytes(sha256(b"a|b").digest()[:8], "big") / (2**64 - 1)) < 1e-15


def test_sentences_and_windows(spark):
    assert one(spark, T.sentences(F.lit("一。二！ 三\n\n1.5 x"))) == ["一。", "二！", "三", "1.", "5 x"]
    assert T.window_bounds([90, 90], 100, 20) == [(0, 90), (70, 170), (150, 181)]
    assert T.window_bounds([1200], 500, 80) == [(0, 500), (420, 920), (840, 1200)]
    assert T.window_bounds([], 500, 80) == [] and T.window_bounds([60, 60], 100, 0) == [(0, 60), (61, 121)]
    assert one(spark, T.packed_windows(F.array(F.lit("a" * 60), F.lit("b" * 60)), 100, 20)) == ["a" * 60, "a" * 20 + " " + "b" * 60]
    assert one(spark, T.fixed_windows(F.lit("x" * 130))) == ["x" * 64, "x" * 64, "xx"]
    assert one(spark, T.fixed_windows(F.lit(""))) == []


@pytest.mark.parametrize(
    "text,term,want",
    [("i am not calm", "calm", False), ("not calm but calm", "calm", True), ("我不喜歡冷靜", "冷靜", False), ("不只冷靜", "冷靜", True), ("不斷冷靜", "冷靜", True), ("antisocial", "social", False), ("socialize", "social", False), ("not only calm", "calm", True), ("never very calm", "calm", False), ("避免合作", "合作", False), ("合作", "合作", True), ("", "a", False), ("never but冷靜", "冷靜", True), ("沒有說過的話再多也還是一樣冷靜", "冷靜", True), ("not one two three four calm", "calm", False), ("not one two three four five calm", "calm", True)],
)
def test_negation(text, term, want):
    assert T.affirms(text, term) is want


def test_paragraphs():
    assert [len(p) for p in T.display_paragraphs("甲" * 401)] == [160, 160, 81]
    assert T.display_paragraphs("甲" * 100 + "，" + "乙" * 100)[0].endswith("，")
    assert T.display_paragraphs("高1.5米。好！ 真的？", most=1) == ["高1.5米。", "好！", "真的？"]
    assert T.display_paragraphs("a\r\nb\n\n c ") == ["a", "b", "c"]


def test_fields(spark):
    row = spark.createDataFrame([("3.0", " GEN-iv", "Unknown", "a|B_c, A", "infj-a", "NaN", "TRUE")], "a string, g string, u string, l string, m string, f string, t string")
    got = row.select(T.whole_number("a").alias("a"), T.generation_number("g").alias("g"), T.optional("u").alias("u"), T.split_codes(F.col("l")).alias("l"), T.four_letter_code("m").alias("m"), T.finite_number("f").alias("f"), T.truth("t").alias("t")).first()
    assert tuple(got) == (3, 4, None, ["a", "B_c"], "INFJ", None, True)
    assert one(spark, T.web_address(F.lit("https://a.b/c?d"))) is False and one(spark, T.web_address(F.lit("https://a.b/c"))) is True
    assert one(spark, T.secure_address(F.lit("https://a.b:99999/c"))) is False and one(spark, T.secure_address(F.lit("https://a.b:8443/c"))) is True
    assert one(spark, T.artwork_address(F.lit("https://x/"), F.lit(7))) == "https://x/0007.png"
    assert one(spark, T.term_problem(F.lit("a​b"), 10)) == "control" and one(spark, T.term_problem(F.lit("ok"), 10)) is None


def test_profile_text(spark):
    row = spark.createDataFrame([("a", None, " ")], "x string, y string, z string")
    assert row.select(T.profile_text({"X：": "x", "Y：": "y", "Z：": "z"}).alias("t")).first()["t"] == "X：a\nY：None"
    assert row.select(T.profile_text({"English name: ": "z", "Z：": "x"}).alias("t")).first()["t"] == "English name:  \nZ：a"


def test_vectors(spark):
    rows = spark.createDataFrame([("a", [3.0, 0.0], 1), ("a", [0.0, 3.0], 1), ("b", [0.0, 0.0], 1), ("c", None, 1)], "k string, v array<double>, w int")
    got = {r["k"]: r["v"] for r in V.mean_vectors(rows, ["k"], "v").collect()}
    assert got == {"a": [0.70710678, 0.70710678], "b": [0.0, 0.0]}
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(spark, V.sigmoid(F.lit(-1e9))) == pytest.approx(8.756510762696521e-27)
