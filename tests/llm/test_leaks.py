import random

import pytest

from emberquill.llm import leaks as L


def brute(docs, items, runs):
    out = set()
    for i, q, lang in items:
        q, need = L.letters(q), runs.get(lang, 50)
        grams = {q[k : k + need] for k in range(len(q) - need + 1)}
        out |= {(d, i) for d, t in docs if t and any(L.letters(t)[k : k + need] in grams for k in range(len(L.letters(t)) - need + 1))}
    return out


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, run int")
    return d, spark.createDataFrame([(i, q, lang, 0) for i, q, lang in items], "item_id long, query string, language_code string, doc_id int")


def test_equal_to_brute_force(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "one", "two", "three", "stone", "river"]
    items = [(i, " ".join(rng.choices(words, k=14)), "en") for i in range(30)] + [(100 + i, "".join(rng.choices("火水電草冰龍鋼岩石飛行", k=40)), "zh-Hant") for i in range(30)]
    docs = []
    for k in range(200):
        _, q, _ = rng.choice(items)
        a = rng.randrange(len(q))
        part = q[a : a + rng.randrange(5, 70)]
        docs.append((k, " ".join(rng.choices(words, k=9)) + "! " + part.upper().replace(" ", " -\n") + "; " + " ".join(rng.choices(words, k=9))))
    got = {(r["doc_id"], r["item_id"]): r["run"] for r in L.leaks(*frames(spark, docs, items)).collect()}
    want = brute(docs, items, L.RUNS)
    assert set(got) == want and len(want) > 20


def test_blocks_of_items_agree(spark, monkeypatch):
    text = "a passage of the held out test that must never be in the training text"
    items = [(i, text + str(i) * 3, "en") for i in range(9)]
    d, c = frames(spark, [(1, "x " + text + "111 y"), (2, "nothing")], items)
    whole = {(r["doc_id"], r["item_id"]) for r in L.leaks(d, c).collect()}
    monkeypatch.setattr(L, "BLOCK", 2)
    assert {(r["doc_id"], r["item_id"]) for r in L.leaks(d, c).collect()} == whole == {(1, i) for i in range(9)}


def test_defined_cases(spark):
    long = "abcde fghij " * 30_000
    docs = [(1, None), (2, ""), (3, " "), (4, long), (4, long), (None, long)]
    items = [(1, "abcde fghij" * 8, "en"), (2, None, "en"), (3, "", "en"), (4, "short", None), (None, long[:100], "en"), (5, "abcdefghij" * 4, "zh-Hant"), (6, "abcde fghij" * 8, "fr")]
    d, c = frames(spark, docs, items)
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in L.leaks(d, c).collect())
    assert got == sorted([(k, i) for k in (0, 4, 4) for i in (1, 5, 6)])
    assert L.leaks(d.limit(0), c).count() == 0 and L.leaks(d, c.limit(0)).count() == 0
    with pytest.raises(ValueError):
        L.leaks(d, c, runs={"en": 5})
