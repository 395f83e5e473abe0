import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from emberquill.streaming import limiter as L
from emberquill.streaming import metrics as M


def test_limiter_denials_consume_nothing():
    s = L.Slots(2, 60)
    assert [s.ask(t) for t in (0, 0, 0)] == [(True, 1, 0), (True, 0, 0), (False, 0, 60)]
    assert s.ask(61)[0]


def test_flagged_requests_need_both_limits():
    first, second = L.Slots(3, 60), L.Slots(1, 600)
    asked = [L.ask_all([first, second], ["requests", "flagged"], t, f) for t, f in ((0, True), (1, True), (2, False), (3, False), (4, False))]
    assert asked == [(True, 0, 0, "flagged"), (False, 0, 599, "flagged"), (True, 1, 0, "requests"), (True, 0, 0, "requests"), (False, 0, 56, "requests")]


def test_batch_decisions_equal_a_plain_fold(spark):
    rng = random.Random(5)
    start = dt.datetime(2025, 1, 1)
    rows = [(i, rng.choice("aab"), start + dt.timedelta(seconds=rng.randrange(600))) for i in range(400)] + [(900, None, start), (901, "a", None)]
    df = spark.createDataFrame(rows, "i int, c string, t timestamp")
    got = {r["ident"]: r["allowed"] for r in L.decisions(df, client="c", time="t", ident="i", limit=3, seconds=60).collect()}
    want, slots = {}, {}
    for i, c, t in sorted((r for r in rows if r[1] and r[2]), key=lambda r: (r[2], r[0])):
        want[i] = slots.setdefault(c, L.Slots(3, 60)).ask((t - start).total_seconds())[0]
    assert got == want


def test_sessions_and_all_limits_equal_a_plain_fold(spark):
    rng = random.Random(8)
    start = dt.datetime(2025, 1, 1)
    rows = [(i, rng.choice("aaab"), start + dt.timedelta(seconds=rng.choice([0, 5_000, 9_000]) + rng.randrange(300)), rng.random() < 0.5) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, c string, t timestamp, f boolean")
    settings = {"limit": 6, "seconds": 60, "flag": "f", "flag_limit": 2, "flag_seconds": 100}
    for total in (None, 3):
        got = {r["ident"]: (r["allowed"], r["remaining"], r["retry_after"], r["scope"]) for r in L.decisions(df, client="c", time="t", ident="i", **settings, total_limit=total, total_seconds=120).collect()}
        want, slots, every = {}, {}, L.Slots(total or 0, 120)
        for i, c, t, f in sorted(rows, key=lambda r: (r[2], r[0])):
            own = slots.setdefault(c, [L.Slots(6, 60), L.Slots(2, 100)])
            want[i] = L.ask_all([*own, every] if total else own, ["requests", "flagged", "total"], (t - start).total_seconds(), f)
        assert got == want and (total is None) == ("total" not in {w[3] for w in want.values()})


def test_alerts_hold(spark):
    start = dt.datetime(2025, 1, 1)
    rows = [(start + dt.timedelta(minutes=m, seconds=k), m >= 20 and k < 2, 4.0 if m >= 20 else 0.1) for m in range(60) for k in range(10)]
    df = spark.createDataFrame(rows, "t timestamp, bad boolean, s double")
    found = M.alerts(df, "t", {"error": F.col("bad"), "limited": F.col("bad"), "failures": F.lit(False), "attempts": F.lit(True)}, F.col("s"))
    first = {r["alert"]: r["w"] for r in found.groupBy("alert").agg(F.min("window_start").alias("w")).collect()}
    assert set(first) == {"error_ratio", "p95_seconds", "limited", "attempts"}
    assert first["attempts"] < start + dt.timedelta(minutes=2) and first["p95_seconds"] > first["error_ratio"] > start + dt.timedelta(minutes=18)


def test_histogram_and_quantile(spark):
    rows = spark.createDataFrame([("r", 0.02), ("r", 0.7), ("r", None)], "route string, s double")
    h = M.histogram(rows, ["route"], F.col("s"))
    assert {r["le"]: r["bucket_count"] for r in h.collect()} == {"0.01": 0, "0.025": 1, "0.05": 1, "0.1": 1, "0.25": 1, "0.5": 1, "1": 2, "2.5": 2, "5": 2, "+Inf": 2}
    assert M.quantile(h, ["route"], 0.5).first()["quantile"] == 0.025
    assert M.quantile(M.histogram(rows.limit(0), ["route"], F.col("s")), ["route"], 0.5).count() == 0


def test_offered_load_equals_brute_force(spark):
    rng = random.Random(1)
    start = dt.datetime(2025, 1, 1)
    rows = [(i, rng.randrange(3), start + dt.timedelta(seconds=rng.randrange(500))) for i in range(200)]
    got = {r["i"]: r["load"] for r in M.offered_load(spark.createDataFrame(rows, "i int, c int, t timestamp"), "c", "t", "i", 60).collect()}
    assert got == {i: sum(1 for _, d, u in rows if d == c and dt.timedelta(0) <= t - u < dt.timedelta(seconds=60)) for i, c, t in rows}


@pytest.fixture
def stream(spark, tmp_path):
    start = dt.datetime(2025, 1, 1)
    rows = [("a" if i % 3 else "b", start + dt.timedelta(minutes=i)) for i in range(30)]
    spark.createDataFrame(rows, "client string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema("client string, ts timestamp").parquet(str(tmp_path / "in"))


def run(df, name, mode, folder):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    return df.sparkSession.table(name).collect()


def test_streams(stream, tmp_path):
    counts = run(M.tumbling(stream, ["client"], "ts", "10 minutes"), "tumbling", "update", tmp_path / "c1")
    assert sum(r["n"] for r in counts) == 30
    held = run(M.sessions(stream, "client", "ts", "5 minutes"), "sessions", "append", tmp_path / "c2")
    assert all(r["n"] > 0 for r in held)
    allowed = run(L.stream_decisions(stream, client="client", time="ts", limit=2, seconds=600), "limited", "append", tmp_path / "c3")
    assert len(allowed) == 30 and 0 < sum(r["allowed"] for r in allowed) < 30
    flagged = stream.withColumn("f", F.minute("ts") % 2 == 0)
    both = run(L.stream_decisions(flagged, client="client", time="ts", limit=30, seconds=3600, flag="f", flag_limit=2, flag_seconds=3600), "both", "append", tmp_path / "c4")
    assert {r["scope"] for r in both} == {"requests", "flagged"} and sum(r["allowed"] for r in both) == 15 + 4
