import json
import struct

import pytest

from emberquill.sources import files as S


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿a,b\n1,"x\ny"\n2,z\n', encoding="utf-8")
    numbered = S.read_csv(spark, str(p), ["a", "b"], number="source_row").collect()
    assert [(r["source_row"], r["a"]) for r in numbered] == [(2, "1"), (3, "2")]
    rows = S.read_csv(spark, str(p), ["a", "b"], key=["a"])
    assert sorted((r["a"], r["b"]) for r in rows.collect()) == [("1", "x\ny"), ("2", "z")]
    with pytest.raises(S.HeaderError, match="missing: c"):
        S.read_csv(spark, str(p), ["a", "b", "c"])
    p.write_text("a,b\n1,x\n1,y\n")
    with pytest.raises(ValueError, match="repeated"):
        S.read_csv(spark, str(p), ["a", "b"], key=["a"])
    p.write_text("a,b\n")
    with pytest.raises(ValueError, match="no rows"):
        S.read_csv(spark, str(p), ["a", "b"])


def test_jsonl(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"id":"a","n":1}\n\n{bad\n{"id":"a","n":2}\n{"id":"b","n":3}', encoding="utf-8")
    rows, errors = S.read_jsonl(spark, str(p), "id string, n int", key="id")
    assert [tuple(r) for r in rows.orderBy("line_no").collect()] == [(1, "a", 1), (5, "b", 3)]
    assert sorted((r["line_no"], r["error"]) for r in errors.collect()) == [(3, "malformed"), (4, "duplicate")]
    out = tmp_path / "o.jsonl"
    assert S.write_jsonl(rows.select("id", "n"), str(out), ["id"]) == 2
    assert out.read_text() == '{"id":"a","n":1}\n{"id":"b","n":3}\n' and [f.name for f in tmp_path.glob("*.part")] == []


def test_catalogues(spark, tmp_path):
    p = tmp_path / "t.json"
    p.write_text(json.dumps({"ability": {"Quick_Feet ": "飛毛腿"}}))
    assert [tuple(r) for r in S.read_translations(spark, str(p)).collect()] == [("ability", "quick-feet", "飛毛腿")]
    p.write_text(json.dumps({"ability": {"a_b": "x", "A-B": "y"}}))
    with pytest.raises(ValueError, match="repeated"):
        S.read_translations(spark, str(p))
    p.write_text('{"b": 1, "a": [1, 2]}')
    first = S.read_catalogue(spark, str(p))[1]
    p.write_text('{"a":[1,2],"b":1}')
    assert S.read_catalogue(spark, str(p))[1] == first


def test_images_and_integrity(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 475, 320) + b"rest")
    (tmp_path / "b.bin").write_bytes(b"no image")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in S.read_images(spark, str(tmp_path / "*")).collect()}
    assert (rows["a.png"]["width"], rows["a.png"]["height"]) == (475, 320) and rows["b.bin"]["width"] is None
    t = lambda r, s: spark.createDataFrame(r, s)
    got = S.integrity(t([(1,), (2,)], "k int"), t([(1, 5, "h"), (3, 5, "h")], "k int, size int, sha256 string"), t([(1, 6, "h")], "k int, size int, sha256 string"), "k")
    assert sorted((r["k"], r["problem"]) for r in got.collect()) == [(1, "size"), (2, "no_file"), (2, "no_manifest"), (3, "no_file"), (3, "not_in_catalogue")]


def test_audit_log(spark, tmp_path):
    rows = spark.createDataFrame([("a", "b")], "actor string, action string")
    for _ in range(2):
        S.append_audit(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_audit_enumerations(spark, tmp_path):
    rows = lambda role, outcome: spark.createDataFrame([("a", role, outcome)], "actor string, actor_role string, outcome string")
    S.append_audit(rows("editor", "noop"), str(tmp_path / "log"))
    for role, outcome in (("owner", "noop"), ("editor", "failed"), (None, "noop")):
        with pytest.raises(Exception, match="isn't one of"):
            S.append_audit(rows(role, outcome), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1


def test_lines_are_numbered_over_splits(spark, tmp_path):
    p = tmp_path / "l.txt"
    p.write_text("\n".join(f"line {i} " + "x" * (i % 50) for i in range(1, 3001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = S.numbered_lines(spark, str(p))
        assert rows.where("line_no <> cast(split(line, ' ')[1] as bigint)").count() == 0 and rows.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_judged_cases(spark):
    schema = "id string, query string, relevance array<struct<pokedex_number:int,grade:int>>, relevant_pokedex_numbers array<int>"
    rows = [("a", "q", [(1, 3), (2, 1)], None), ("b", "q", None, [4, 5]), ("c", " ", [(1, 1)], None), ("d", "q", [(1, 1)], [1]), ("e", "q", None, []), ("f", "q", [(1, 4)], None), ("g", "q", None, [7, 7])]
    good, errors = S.judged_cases(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, good.collect())) == [("a", 1, 3), ("a", 2, 1), ("b", 4, 1), ("b", 5, 1)]
    assert {r["id"]: r["error"] for r in errors.collect()} == {"c": "no_query", "d": "both_forms", "e": "no_relevance", "f": "grade", "g": "repeated"}


def test_manifests(spark, tmp_path):
    rows = spark.createDataFrame([("b.png", 3, "h", None, None), ("a.png", 5, "g", 1, 2)], "path string, size long, sha256 string, width int, height int")
    p = str(tmp_path / "m.csv")
    assert S.write_manifest(rows, p) == 2 and open(p).read() == "path,size,sha256,width,height\na.png,5,g,1,2\nb.png,3,h,,\n"
    assert sorted(map(tuple, S.read_manifest(spark, p).collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "m.csv").write_text("path,size,sha256,width,height\na,x,h,,\n")
    with pytest.raises(Exception):
        S.read_manifest(spark, p).collect()


def test_catalogue_problems():
    profile = lambda code, **ch: {"code": code, "text": "t", "weighted_terms": [{"term": f"t{i}", "weight": 1.0} for i in range(12)]} | ch
    good = {"version": "v1", "revision": 1, "profiles": [profile(c) for c in S.CODES]}
    assert S.catalogue_problems(good) == []
    assert S.catalogue_problems(good | {"revision": True, "version": " "}) == ["version", "revision"]
    bad = [profile(S.CODES[0], text=" "), profile(S.CODES[1], weighted_terms=[]), profile(S.CODES[2], weighted_terms=[{"term": "ＡＢ", "weight": 1}, {"term": "ab", "weight": float("nan")}] + good["profiles"][0]["weighted_terms"])]
    assert S.catalogue_problems(good | {"profiles": bad + good["profiles"][3:]}) == ["ENFJ: blank text", "ENFP: too few terms", "ENTJ: blank or repeated terms", "ENTJ: weight"]
    assert S.catalogue_problems(good | {"profiles": good["profiles"][::-1]}) == ["codes"] and S.catalogue_problems([]) == ["root"]
