import random
import re

from emberquill.llm import near_dup as N


def rows(spark, items, part=0):
    return spark.createDataFrame([(part, i, t, "x", "y") for i, t in items], "part int, id long, text string, uid string, band string")


def norm(t):
    return re.sub(r"\s+", " ", t.lower()).strip()


def brute(items, size, threshold, words=False):
    def shingles(t):
        u = norm(t).split() if words else norm(t)
        return {tuple(u[i : i + size]) for i in range(len(u) - size + 1)}

    kept = [(i, t, shingles(t)) for i, t in items if t is not None]
    out = set()
    for k, (i, t, a) in enumerate(kept):
        for j, u, b in kept[k + 1 :]:
            if norm(t) == norm(u) or (a and b and len(a & b) >= threshold * len(a | b)):
                out.add((min(i, j), max(i, j)))
    return out


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        words[k : k + 1] = [words[k] + "x"] if rng.random() < 0.5 else []
    return words


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(400)]
    base = [rng.choices(vocab, k=80) for _ in range(60)]
    items = [" ".join(b) for b in base] + [" ".join(edited(rng, rng.choice(base), rng.randrange(0, 9))) for _ in range(140)]
    return list(enumerate(items))


def test_pairs_equal_brute_force(spark):
    items = corpus(3)
    got = {(r["row_a"], r["row_b"]) for r in N.alike_pairs(*N.near_duplicates(rows(spark, items), threshold=0.7, size=4, unit="char")).collect()}
    want = brute(items, 4, 0.7)
    assert not got - want and len(want - got) <= 0.01 * len(want) and len(want) > 100


def test_large_bands_and_small_blocks_give_the_same(spark, monkeypatch):
    items = corpus(5) + [(500 + k, "one family of texts that all look the same but for a number at the end " * 3 + str(k)) for k in range(40)]
    found = lambda: {(r["ua"], r["ub"], r["similarity"]) for r in N.near_duplicates(rows(spark, items), threshold=0.7, size=4, unit="char")[1].collect()}
    whole = found()
    for name, value in (("FAMILY", 3), ("PER_TASK", 500), ("PER_BLOCK", 5), ("MOST_TASKS", 7)):
        monkeypatch.setattr(N, name, value)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found() == whole and len(whole) > 800
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_meetings():
    import numpy as np

    band, uid = np.array([1, 2, 2, 2, 3, 3, 4, 4, 4, 4]), np.array([9, 1, 2, 3, 5, 7, 1, 2, 3, 4])
    ua, ub, large = N.meetings(band, uid, 3)
    assert sorted(zip(ua.tolist(), ub.tolist())) == [(1, 2), (1, 3), (2, 3), (5, 7)] and large.tolist() == [False] * 6 + [True] * 4


def test_words(spark):
    items = corpus(4)
    got = {(r["row_a"], r["row_b"]) for r in N.alike_pairs(*N.near_duplicates(rows(spark, items))).collect()}
    want = brute(items, 5, 0.8, words=True)
    assert not got - want and len(want - got) <= 0.01 * len(want) and want


def test_defined_cases(spark):
    long = "word " * 40_000
    items = [(1, None), (2, ""), (3, "  \n"), (4, "ab"), (5, "AB "), (6, "abc"), (7, long), (8, long + "x"), (9, "x" * 50), (10, "y" * 50)]
    members, links = N.near_duplicates(rows(spark, items), threshold=0.7, size=4, unit="char")
    pairs = {(r["row_a"], r["row_b"]) for r in N.alike_pairs(members, links).collect()}
    assert pairs == {(2, 3), (4, 5), (7, 8)}
    got = {r["id"]: (r["class_id"], r["class_size"], r["links"]) for r in N.groups(members, links).collect()}
    assert 1 not in got and got[2] == got[3] == (2, 2, 0) and got[6] == (6, 1, 0) and got[7] == (7, 2, 1)


def test_parts_are_apart_and_empty_tables(spark):
    both = rows(spark, [(1, "same text here")]).unionByName(rows(spark, [(1, "same text here")], part=1))
    assert N.alike_pairs(*N.near_duplicates(both, threshold=0.7, size=4, unit="char")).count() == 0
    assert N.groups(*N.near_duplicates(both.limit(0))).count() == 0


def test_a_hot_copy_is_one_representative(spark):
    items = [(i, "the same hot text over and over again") for i in range(300)] + [(900, "quite another text stands here alone")]
    members, links = N.near_duplicates(rows(spark, items), threshold=0.7, size=4, unit="char")
    assert links.count() == 0 and N.alike_pairs(members, links).count() == 300 * 299 // 2


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (10, 11), (8, 11)], "ua long, ub long")
    assert {r["uid"]: r["component"] for r in N.components(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 10: 8, 11: 8, 8: 8}


def test_sketches_estimate_high_similarities():
    import numpy as np

    rng = random.Random(1)
    base = [f"w{i}" for i in range(300)]
    for changed in (5, 20, 60):
        other = [w + "x" if i in set(rng.sample(range(300), changed)) else w for i, w in enumerate(base)]
        _, bits, _ = N.signatures([" ".join(base), " ".join(other)], 1, "word", N.BANDS, N.ROWS)
        apart = np.unpackbits((bits[0] ^ bits[1]).view(np.uint8)).sum()
        k, n = N.BANDS * N.ROWS, N.SKETCH_BITS
        estimate = 1 + n / (4 * k) * np.log(1 - 2 * min(apart, n / 2 - 1) / n)
        assert abs(estimate - (300 - changed) / (300 + changed)) < 0.12
