import numpy as np
import pytest
from pyspark.sql import functions as F

from emberquill.operators import aggregate as A
from emberquill.operators import embedding as N
from emberquill.operators.records import HEADER, STATS
from emberquill.sources import versions as V


def test_a_failing_batch_leaves_the_others(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else ("bad" if i == 9 else f"text {i}"), "h") for i in range(20)], "chunk_id long, content string, content_hash string").coalesce(1)

    def encoder(texts):
        if "bad" in texts:
            raise RuntimeError("model")
        return N.hashing_encoder(texts)

    done = N.embed(rows, encoder=encoder, batch=4)
    failed = {r["chunk_id"]: r["error"] for r in done.where("status = 'failed'").collect()}
    assert set(failed) == {3, 9, 10, 11, 12} and failed[3] == "no content" and "model" in failed[9]
    assert tuple(N.outcome(done).first())[:2] == (20 - len(failed), len(failed))


def test_prototypes(spark):
    rows = spark.createDataFrame([("a", "x" * 64 + "y" * 10), ("b", "")], "type string, text string")
    got = {r["type"]: r["prototype"] for r in N.prototypes(rows).collect()}
    both = N.hashing_encoder(["x" * 64, "y" * 10])
    mean = (both[0] * 64 + both[1] * 10) / 74
    assert set(got) == {"a"} and np.allclose(got["a"], mean / np.linalg.norm(mean), atol=1e-7)


def test_versions(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    one, two = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    assert V.current(spark, root) == 0 and V.initialise(one, root) == 1
    held = V.read(spark, root, 1)
    assert V.publish(two, root, 1) == 2 and V.read(spark, root).first()["x"] == 2 and held.first()["x"] == 1
    with pytest.raises(V.Conflict):
        V.publish(one, root, 1)
    with pytest.raises(V.Conflict):
        V.initialise(one, root)
    with pytest.raises(FileNotFoundError):
        V.read(spark, root, 9)
    (tmp_path / "t" / "p3").touch()  # a writer between its claim and its name
    assert V.current(spark, root) == 2
    with pytest.raises(V.Conflict):
        V.publish(one, root, 2)
    monkeypatch.setattr(V, "DEAD", -1)  # long dead
    assert V.publish(one, root, 2) == 3 and V.versions(spark, root) == [1, 2, 3]
    assert len([f for f in (tmp_path / "t").iterdir() if f.name.startswith("v")]) == 3


def test_cached_values_outlive_errors():
    state, loads, broken = [1, "a"], [], []

    def load():
        if broken:
            raise OSError
        loads.append(tuple(state))
        return len(loads)

    c = V.Cached(lambda: state, load)
    assert (c.get(), c.get(), c.stale) == (1, 1, False)
    state[1] = "b"
    assert c.get() == 2
    state[0] = 2
    broken.append(1)
    assert c.get() == 2 and c.stale
    broken.clear()
    assert c.get() == 3 and not c.stale
    with pytest.raises(OSError):
        V.Cached(lambda: (1, "x"), lambda: (_ for _ in ()).throw(OSError())).get()


def test_nested_rows_name_their_errors(spark):
    good = {c: "1" for c in HEADER} | {"type_1": "Fire", "type_2": "unknown", "type_zh": "火", "generation": "gen-i", "base_stat_total": "6", "is_legendary": "False", "is_mythical": "true", "is_baby": "False", "image_url": "https://a.b/c", "sprite_url": "https://a.b/c"}
    changes = [{}, {"is_legendary": "yes", "generation": "generation-one", "height_m": "NaN", "base_stat_total": "999"}, {"type_1": "Normal", "type_zh": ""}, {"type_zh": ""}, {"image_url": "https://a.b/c?x"}, {c: None for c in STATS}]
    rows = spark.createDataFrame([(i, *[(good | ch)[c] for c in HEADER]) for i, ch in enumerate(changes)], ", ".join(["source_row int", *(f"{c} string" for c in HEADER)]))
    types = spark.createDataFrame([("fire", "Fire", "火"), ("normal", "Normal", "一般")], "code string, name_en string, name_zh string")
    got = {r["source_row"]: sorted({e["field"] for e in r["errors"]}) for r in A.nested(rows, types).collect()}
    assert got[0] == got[2] == [] and got[1] == ["base_stat_total", "generation", "height_m", "is_legendary"] and got[3] == ["type_zh"] and got[4] == ["image_url"]
    assert set(STATS) <= set(got[5])
    assert A.payload_problems(A.nested(rows, types), "source_row").count() == 0
    twice = A.nested(rows.limit(1), types).withColumn("type_codes", F.array(F.lit("fire"), F.lit("fire")))
    assert [r["problem"] for r in A.payload_problems(twice, "source_row").collect()] == ["types"]
