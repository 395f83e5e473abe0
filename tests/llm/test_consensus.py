import datetime as dt
import math
import random
import warnings

import pytest

from emberquill.llm import consensus as C

SCHEMA = "annotation_id long, case_id string, pokemon_id long, annotator string, grade int, created_at timestamp, weight string, w string"
NOW = dt.datetime(2025, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_unreliable_annotators_do_not_count(spark):
    rng = random.Random(2)
    rows, truth = [], {}
    for k in range(300):
        truth[k] = rng.randrange(4)
        for name in rng.sample([f"good{i}" for i in range(5)], 3):
            rows.append((len(rows), "c", k, rng.choice([name, name.upper(), f" {name} "]), truth[k] if rng.random() < 0.93 else rng.randrange(4), NOW))
        for name in rng.sample([f"bad{i}" for i in range(3)], 2):
            rows.append((len(rows), "c", k, name, rng.randrange(4), NOW))
        rows.append((len(rows), "c", k, "foe", (truth[k] + 1) % 4, NOW))
    items, people = C.consensus(frame(spark, rows))
    got = {r["pokemon_id"]: r["grade"] for r in items.collect()}
    assert sum(got[k] == truth[k] for k in truth) >= 0.97 * len(truth)
    assert {r["annotator"] for r in people.where("reliable").collect()} == {f"good{i}" for i in range(5)}


def test_defined_cases(spark):
    later = NOW + dt.timedelta(1)
    rows = [
        (1, "c", 1, "a", 3, NOW), (2, "c", 1, "A ", 1, later), (3, "c", 1, "b", 1, NOW), (4, "c", 1, "d", 1, None), (5, "c", 1, "d", 2, None), (6, "c", 1, "e", 9, NOW), (7, "c", 1, None, 1, NOW), (8, None, 1, "a", 1, NOW), (9, "c", None, "a", 1, NOW),
        (10, "c", 2, "a", 1, NOW), (11, "c", 2, "b", 1, NOW), (12, "c", 1, "  ", 1, NOW), (13, "c", 1, "f", None, NOW),
    ]
    items, people = C.consensus(frame(spark, rows))
    assert [(r["pokemon_id"], r["grade"], r["annotators"]) for r in items.collect()] == [(1, 1, 3)]
    assert {r["annotator"] for r in people.collect()} == {"a", "b", "d"}
    empty = C.consensus(frame(spark, rows).limit(0))
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_agreement(spark):
    same = [(i, "c", i // 2, "ab"[i % 2], (i // 2) % 4, NOW) for i in range(16)]
    assert C.agreement(frame(spark, same)).first()["alpha"] == 1.0
    assert C.agreement(frame(spark, same[:1])).first()["alpha"] is None
    units = [[1, 1, None], [2, 2, 3], [3, 3, 3], [0, 1, None], [2, None, None]]
    rows = [(k, "c", u, str(a), g, NOW) for k, (u, a, g) in enumerate((u, a, g) for u, gs in enumerate(units) for a, g in enumerate(gs) if g is not None)]
    kept = [[g for g in gs if g is not None] for gs in units if sum(g is not None for g in gs) > 1]
    n = sum(map(len, kept))
    observed = sum(sum(a != b for i, a in enumerate(u) for j, b in enumerate(u) if i != j) / (len(u) - 1) for u in kept) / n
    flat = [g for u in kept for g in u]
    expected = sum(a != b for i, a in enumerate(flat) for j, b in enumerate(flat) if i != j) / (n * (n - 1))
    assert abs(C.agreement(frame(spark, rows)).first()["alpha"] - (1 - observed / expected)) < 1e-6


def test_many_annotators_take_the_joined_path(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(k, "c", k // 4, f"a{rng.randrange(6)}", rng.choice([1, 1, 1, 2]), NOW) for k in range(200)]
    here = sorted(map(tuple, C.consensus(frame(spark, rows))[0].collect()))
    monkeypatch.setattr(C, "FEW", 0)
    assert sorted(map(tuple, C.consensus(frame(spark, rows))[0].collect())) == here


def test_annotators_of_small_items_are_scored(spark, monkeypatch):
    rows = [(k, "c", k // 3, "abd"[k % 3], (k // 3) % 4, NOW) for k in range(30)]
    rows += [(100 + k, "c", 50 + k // 2, "ae"[k % 2], k // 2 % 4, NOW) for k in range(8)] + [(200, "c", 90, "f", 2, NOW)]
    for most in (C.FEW, 0):
        monkeypatch.setattr(C, "FEW", most)
        items, people = C.consensus(frame(spark, rows))
        assert {r["pokemon_id"] for r in items.collect()} == set(range(10))
        got = {r["annotator"]: (r["items"], r["accuracy"], r["reliable"]) for r in people.collect()}
        assert got == {"a": (14, 1.0, True), "b": (10, 1.0, True), "d": (10, 1.0, True), "e": (4, 1.0, True), "f": (0, None, None)}


def test_swinging_votes_settle(spark, data, monkeypatch):
    rows = spark.read.parquet(f"{data}/annotation_quality_row.parquet")
    accuracies = lambda n: {r["annotator"]: r["leave_one_out"] for r in C.consensus(rows, rounds=n)[1].collect()}
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        a, b = accuracies(6), accuracies(7)
    assert max(abs(a[k] - b[k]) for k in a) <= 0.002
    assert C.consensus(rows)[1].where("converged").count() == len(a)
    monkeypatch.setattr(C, "DAMPED", 0, raising=False)
    with pytest.warns(RuntimeWarning, match="did not settle in 6 rounds"):
        assert not C.consensus(rows, rounds=6)[1].first()["converged"]


def plainly(ratings, rounds=60, tolerance=0.002):
    """The same votes over a dict of item to {annotator: grade}, one at a time: accuracies against the others, and each item's grade."""
    people = sorted({a for gs in ratings.values() for a in gs})
    weights, before = dict.fromkeys(people, 1.0), None
    vote = lambda gs, w: min(range(4), key=lambda g: (-round(sum(w[a] for a, x in gs.items() if x == g), 9), g))
    for r in range(rounds):
        met, items, accuracy = dict.fromkeys(people, 0), dict.fromkeys(people, 0), dict.fromkeys(people, 0)
        for gs in ratings.values():
            for a, g in gs.items():
                if len(gs) > 1:
                    items[a] += 1
                    met[a] += vote({b: x for b, x in gs.items() if b != a}, weights) == g
                    accuracy[a] += vote(gs, weights) == g
        common = sum(met.values()) / sum(items.values())
        loo = {a: (met[a] + C.PRIOR * common) / (items[a] + C.PRIOR) for a in people}
        step = 1.0 if r < 4 else 1 / (r - 2)
        new = {a: max(math.log(p * 3 / (1 - p)), C.LEAST) for a, p in ((a, min(max(loo[a], C.CAP), 1 - C.CAP)) for a in people)}
        weights = {a: step * new[a] + (1 - step) * weights[a] for a in people}
        if before and max(abs(loo[a] - before[a]) for a in people) <= tolerance:
            break
        before = loo
    good = {a for a in people if items[a] and accuracy[a] / items[a] >= C.RELIABLE}
    heads = lambda gs, g: sum(x == g for a, x in gs.items() if a in good) + 1e-7 * round(sum(weights[a] for a, x in gs.items() if x == g), 6)
    return loo, {i: min(range(4), key=lambda g: (-round(heads(gs, g), 9), g)) for i, gs in ratings.items() if len(gs) > 2}


def test_equals_a_plain_computation(spark, data):
    rows = spark.read.parquet(f"{data}/annotation_quality_row.parquet")
    ratings = {}
    for r in C.latest_valid(rows).collect():
        ratings.setdefault((r["case_id"], r["pokemon_id"]), {})[r["annotator"]] = r["grade"]
    items, people = C.consensus(rows)
    loo, grades = plainly(ratings)
    assert {(r["case_id"], r["pokemon_id"]): r["grade"] for r in items.collect()} == grades
    assert {r["annotator"]: round(r["leave_one_out"], 9) for r in people.collect()} == {a: round(v, 9) for a, v in loo.items()}
