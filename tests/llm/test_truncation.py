import random

import pytest
from pyspark.sql import functions as F

from emberquill.llm import truncation as T

WORDS = "quiet stone folds every amber river near the hollow gate and counts a silver drum beside its nest".split()


@pytest.mark.parametrize(
    "text,rest",
    [
        ("It ends. ", "It ends."), ("It ends. 🐾🐾", "It ends."), ("It en…", "It en"), ("It en... ", "It en"), ("It e" + chr(0xFFFD), "It e"), ("完。～", "完。"), ("It e 「", "It e"), ("It e (", "It e"), ("It weighed 12.", "It weighed 12."), ("It ends.…", "It ends"), ("", ""), ("🐾", ""), ("...", ""),
        ("It said (more)", "It said (more)"), ("x" + " 🐾" * 50_000, "x"),
    ],
)
def test_bare(text, rest):
    assert T.bare(text) == rest


def test_starts_of_tails():
    assert T.starts("it en (more)") == [(11, "it en (more"), (7, "it en"), (6, "it en"), (3, "it")]
    assert T.starts("") == [] and T.starts("（完）") == [(2, "（完")]


def corpus(seed, n=900):
    rng = random.Random(seed)
    docs, cut = [], set()
    for i in range(n):
        text = " ".join(" ".join(rng.choices(WORDS, k=rng.randrange(5, 9))).capitalize() + "." for _ in range(6))
        if i % 11 == 0:
            text = text[: rng.randrange(len(text) // 2, len(text) - 3)].rstrip(". ")
            cut.add(i)
        docs.append((i, text + rng.choice(["", " ", "\n— Post 3", " 🐾"]), rng.choice(["en", "EN", "eng"]), "ab"[i % 2]))
    return docs, cut


def frame(spark, docs):
    return spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, lang string, source string, suffix string, language string")


def test_cuts_are_found(spark):
    docs, cut = corpus(1)
    judged = T.truncated(frame(spark, docs), group=["source"])
    got = {r["doc_id"] for r in judged.where("cut").collect()}
    assert len(got & cut) >= 0.97 * len(cut) and len(got - cut) <= 0.03 * len(cut)
    rate = {r["source"]: r["cut_texts"] for r in T.rates(judged).collect()}
    assert sum(rate.values()) == len(got)


def test_copies_are_judged_alike_and_do_not_vote(spark):
    docs, _ = corpus(2)
    hot = "The quiet stone folds every amber river near the hol"
    docs += [(10_000 + i, hot, "en", "a") for i in range(400)]
    got = {r["doc_id"] for r in T.truncated(frame(spark, docs), group=["source"]).where("cut").collect()}
    assert {10_000 + i for i in range(400)} <= got


def test_defined_cases(spark):
    docs, _ = corpus(3, 300)
    odd = [(901, None, None, None), (902, "", "zh", "a"), (903, " \n", "en", "a"), (904, "🐾", "en", None), (905, "x" * 100_000, None, "a"), (None, "It ends.", "en", "a")]
    judged = T.truncated(frame(spark, docs + odd), group=["source"]).collect()
    assert len(judged) == 306 and not any(r["cut"] for r in judged if r["doc_id"] in (901, 902, 903, 904))
    assert T.truncated(frame(spark, docs).limit(0), group=["source"]).count() == 0
    assert not any(r["cut"] for r in T.truncated(frame(spark, [(1, "It ends.", "en", "a")])).collect())
    with pytest.raises(ValueError):
        T.truncated(frame(spark, docs), group=["language"])


TAILS = ["", " ", "\n— Post 3", "\n- {0} {1}\n- {2} {0}", "\nTags: {1}, {2}", "\nHeight | 3.{3} m\nWeight | {3} kg", " (to be continued)", "（待續……）", "...", "…", " 🐾", "\n\n— " + "Keeper of the long hall " * 20]


def test_what_stands_after_the_prose_does_not_matter(spark):
    rng = random.Random(7)
    docs, cut, kinds = [], set(), {}
    for i in range(4000):
        text = " ".join(" ".join(rng.choices(WORDS, k=rng.randrange(5, 9))).capitalize() + "." for _ in range(3))
        text += "\n" + " ".join(" ".join(rng.choices(WORDS, k=rng.randrange(5, 9))).capitalize() + "." for _ in range(3))
        kinds[i] = rng.choice(TAILS if (short := i % 8 == 0) else [t for t in TAILS if t not in ("...", "…")])
        if short:
            text = text[: rng.randrange(len(text) - 30, len(text) - 3)].rstrip(". ")
            cut.add(i)
        docs.append((i, text + kinds[i].format(*rng.choices(WORDS, k=3), rng.randrange(10)), "en", "a"))
    got = {r["doc_id"] for r in T.truncated(frame(spark, docs)).where("cut").collect()}
    for tail in TAILS:
        own = {i for i, t in kinds.items() if t == tail}
        assert len(got & cut & own) >= 0.95 * len(cut & own) and len((got - cut) & own) <= 0.02 * len(own), tail


def test_columns_have_their_own_models(spark):
    docs, cut = corpus(4, 400)
    rows = frame(spark, docs).withColumn("other", F.concat(F.lit("note "), F.col("doc_id"), F.lit(" without an end")))
    both = T.truncated(rows, columns=("text", "other"))
    found = lambda judged, c: {(r["doc_id"], r["log_odds"], r["threshold"]) for r in judged.where(F.col("cut") & (F.col("column") == c)).collect()}
    assert both.count() == 800 and found(both, "text") == found(T.truncated(rows), "text") != set()


def test_few_slots_agree(spark, monkeypatch):
    docs, _ = corpus(4, 300)
    rows = frame(spark, docs)
    whole = {r["doc_id"] for r in T.truncated(rows).where("cut").collect()}
    monkeypatch.setattr(T, "SLOTS", 64)
    assert {r["doc_id"] for r in T.truncated(rows).where("cut").collect()} == whole


def test_a_finished_text_in_a_third_of_the_rows_is_no_cut(spark):
    docs, cut = corpus(5)
    alone = {r["doc_id"] for r in T.truncated(frame(spark, docs), group=["source"]).where("cut").collect()}
    hot = "Amber drums keep time along the quay. A lantern swings above the dock and nobody minds the weather, zygote."
    docs += [(10_000 + i, hot + ["", " ", "\n— Post 3"][i % 3], "en", "a") for i in range(450)]
    got = {r["doc_id"] for r in T.truncated(frame(spark, docs), group=["source"]).where("cut").collect()}
    assert not any(i >= 10_000 for i in got) and len(got ^ alone) <= 3


def test_totals_and_thresholds_count_distinct_bodies(spark):
    docs, _ = corpus(6, 300)
    more = docs + [(10_000 + 300 * k + d[0], d[1], d[2], d[3]) for k in range(3) for d in docs[:100]]
    judged = lambda rows: {r["doc_id"]: (r["log_odds"], r["threshold"]) for r in T.truncated(frame(spark, rows)).collect() if r["doc_id"] < 10_000}
    assert judged(more) == judged(docs)
