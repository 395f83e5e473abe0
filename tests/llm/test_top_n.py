import math
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from emberquill.llm import top_n as N

SCHEMA = "g string, h int, item string, score double, tie long, run string, pos int"


def brute(rows, n):
    best = {}
    for g, h, item, score, tie, *_ in rows:
        if None in (g, h, item, score) or math.isnan(score):
            continue
        key = (-score, tie if tie is not None else 2**63 - 1, item)
        best[(g, h, item)] = min(best.get((g, h, item), key), key)
    groups = {}
    for (g, h, item), key in best.items():
        groups.setdefault((g, h), []).append(key)
    return {(g, h, p, k[2]) for (g, h), keys in groups.items() for p, k in enumerate(sorted(keys)[:n], 1)}


def popped(tree):
    while (top := tree.head()) is not None:
        yield tree.runs[top[0]][top[1]]
        tree.pop()


@given(st.lists(st.lists(st.integers(0, 50)), max_size=9))
def test_loser_tree(runs):
    runs = [sorted((x,) for x in r) for r in runs]
    assert list(popped(N.LoserTree(runs))) == sorted(x for r in runs for x in r)


@given(st.lists(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9))), max_size=9))
def test_seek_leaves_the_rest_of_a_group(runs):
    tree, got, current = N.LoserTree([sorted(r) for r in runs]), [], None
    while (top := tree.head()) is not None:
        key = tree.runs[top[0]][top[1]]
        if key[0] == current:
            tree.seek(current)
        else:
            current = key[0]
            got.append(key)
            tree.pop()
    flat = sorted(x for r in runs for x in r)
    assert got == [min(x for x in flat if x[0] == g) for g in sorted({g for g, _ in flat})]


def test_runs_end_where_their_order_does():
    import pyarrow as pa

    rows = [("a", "x", 1.0, 1), ("a", "y", 3.0, 1), ("b", "z", 1.0, 1), ("a", "w", 2.0, 1), ("a", "x", 9.0, 1)]
    table = pa.table({"g": [r[0] for r in rows], "item": [r[1] for r in rows], "score": [r[2] for r in rows], "tie": [r[3] for r in rows], "run": [4] * 5})
    place, position = N.merged(table, ["g"], 2)
    assert place.tolist() == [4, 1, 2] and position.tolist() == [1, 2, 1]


@pytest.mark.parametrize("n", [1, 3])
def test_equal_to_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([1, 1, 1, 2, None]), rng.choice([None, *(f"i{k}" for k in range(60))]), rng.choice([None, float("nan"), 0.0, -0.0, *map(float, range(6))]), rng.choice([None, 1, 2]), "r", 7) for _ in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {(r["g"], r["h"], r["pos"], r["item"]) for r in N.best_per_group(df, ["g", "h"], n).collect()}
    assert got == brute([(g, h, i, s + 0.0 if s is not None else s, t) for g, h, i, s, t, *_ in rows], n)


def test_folding_and_many_batches(spark, monkeypatch):
    monkeypatch.setattr(N, "FOLD", 50)
    rows = [("hot", 1, f"i{k % 700}", float(k % 97), k % 5, "r", 0) for k in range(4000)] + [(f"g{k}", 1, "i", 1.0, None, "r", 0) for k in range(900)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {(r["g"], r["h"], r["pos"], r["item"]) for r in N.best_per_group(spark.createDataFrame(rows, SCHEMA), ["g", "h"], 3).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute(rows, 3)


def test_empty(spark):
    assert N.best_per_group(spark.createDataFrame([], SCHEMA), ["g"], 3).count() == 0
