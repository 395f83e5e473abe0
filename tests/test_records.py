import pytest

from emberquill.operators import records as R

GOOD = {c: "x" for c in R.HEADER} | {"type_1": "Fire", "generation": "gen-iv", "base_stat_total": "+021.0"} | {c: str(i) for i, c in enumerate(R.STATS, 1)}


def line(quote=(), **changes):
    row = GOOD | changes
    return ",".join('"' + row[c].replace('"', '""') + '"' if c in quote else row[c] for c in R.HEADER)


CASES = [
    (line(), None),
    (line() + "\r", None),
    (line(quote=R.HEADER), None),
    (line(quote=("name_en",), name_en='a "b", c\nd'), None),
    (line(type_1=" Fire ", generation="GEN-IX"), None),
    (line(name_en='a"b'), "quoting"),
    (line(name_en='"a"b'), "quoting"),
    (line(name_en='"a'), "quoting"),
    (line() + ",", "column_count"),
    ("", "column_count"),
    (None, "column_count"),
    (line().replace(",", ";"), "column_count"),
    (line(type_1="fire"), "type_1"),
    (line(type_1=""), "type_1"),
    (line(generation="gen-x"), "generation"),
    (line(base_stat_total="22"), "base_stat_total"),
    (line(base_stat_total="21.5"), "base_stat_total"),
    (line(base_stat_total="-21"), "base_stat_total"),
    (line(base_stat_total=""), "base_stat_total"),
    (line(hp="one"), "base_stat_total"),
    (line(base_stat_total="9" * 60), "base_stat_total"),
    (line(analysis_text="長" * 200_000), None),
]


def frames(spark, lines):
    raw = spark.createDataFrame([(i, "f", i + 2, t) for i, t in enumerate(lines)], "raw_id long, reason string, line_no int, raw_line string")
    return raw, spark.createDataFrame([("Fire", 1), (None, 2)], "name_en string, raw_id int")


def test_reasons(spark):
    raw, types = frames(spark, [t for t, _ in CASES])
    got = {r["raw_id"]: r["reason"] for r in R.parse_records(raw, types).collect()}
    assert got == {i: reason for i, (_, reason) in enumerate(CASES)}


def test_fields_survive(spark):
    raw, types = frames(spark, [line(quote=("name_en",), name_en='a "b", c\nd')] * 3 + [line()])
    rows = R.valid(R.parse_records(raw, types)).orderBy("raw_id").collect()
    assert [r["name_en"] for r in rows] == ['a "b", c\nd'] * 3 + ["x"] and rows[0]["hp"] == "1"


def test_bisection_agrees_with_the_scanner(spark):
    lines = [t for t, _ in CASES if t] * 40
    raw, types = frames(spark, lines)
    got = {r["raw_id"]: r["reason"] for r in R.parse_records(raw, types, with_fields=False).collect()}
    assert got == {i: R.diagnose(t.rstrip("\r"), {"Fire"})[0] for i, t in enumerate(lines)}


def test_headers_and_empty(spark):
    raw, types = frames(spark, [line()])
    assert R.parse_records(raw.limit(0), types).count() == 0
    from pyspark.sql import functions as F

    assert R.parse_records(raw.withColumn("line_no", F.lit(1)), types).count() == 0
    assert R.parse_records(raw.withColumn("line_no", F.lit(None).cast("int")), types).count() == 1
    assert R.rejected(R.parse_records(raw, types.limit(0))).first()["reason"] == "type_1"


@pytest.mark.parametrize("text,fields", [("a,b", ["a", "b"]), ("", [""]), (",", ["", ""]), ('"a,b"', ["a,b"]), ('"a""b"', ['a"b']), ('"a"b', None), ('a"', None), ('"', None), ('""', [""]), ('"a",', ["a", ""])])
def test_scanner(text, fields):
    assert R.scan_fields(text) == fields


@pytest.mark.parametrize("bad", [c for c in CASES if c[1] and c[1] != "column_count"] + [(line() + ",", "column_count")])
def test_every_reason_fails_its_block(bad):
    import pyarrow as pa

    fine = lambda lines: (f := R.block_fields(lines)) is not None and R.plausible(f, pa.array(["Fire"]))
    assert fine([line()] * 9) and not fine([line()] * 4 + [bad[0]] + [line()] * 4)


def test_separator_of_blocks_inside_a_record(spark):
    raw, types = frames(spark, [line(), line(name_en="a\x1eb"), line(name_en='"a\x1eb"'), line(base_stat_total="0" * 40 + "21")])
    assert R.parse_records(raw, types).where("reason is null").count() == 4
