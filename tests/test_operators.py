"""Goldens of retrieval, scoring, evaluation, feedback, merging, explanations and the catalogue."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberquill.functions import text as T
from emberquill.operators import calendar as K
from emberquill.operators import catalog as C
from emberquill.operators import evaluation as E
from emberquill.operators import explain as X
from emberquill.operators import feedback as B
from emberquill.operators import merge as M
from emberquill.operators import retrieval as R
from emberquill.operators import scoring as S


def fused(spark, dense, lexical):
    d = spark.createDataFrame([(1, c, r, 0.9) for r, c in dense], "query_id long, chunk_id long, dense_rank int, dense_score double")
    x = spark.createDataFrame([(1, c, r, 0.8) for r, c in lexical], "query_id long, chunk_id long, lexical_rank int, lexical_score double")
    return R.fuse(d, x)


def test_fusion(spark):
    r = fused(spark, [(1, 1)], [(1, 1)]).first()
    assert r["rrf_score"] == pytest.approx(2 / 61) and (r["dense_rank"], r["lexical_rank"]) == (1, 1)
    r = fused(spark, [(1, 1), (7, 1)], [(5, 1), (2, 1)]).first()
    assert r["rrf_score"] == pytest.approx(1 / 61 + 1 / 62) and r["lexical_rank"] == 2


def test_entities_by_their_three_best(spark):
    chunks = spark.createDataFrame([(i, 20) for i in range(1, 5)], "chunk_id long, entity_id long")
    r = R.aggregate_entities(fused(spark, [(i, i) for i in range(1, 5)], []), chunks).first()
    assert r["evidence"] == [1, 2, 3] and r["retrieval_score"] == pytest.approx(0.75 / 61 + 0.25 * np.mean([1 / 61, 1 / 62, 1 / 63]), abs=1e-9)


def test_equal_scores_go_by_best_rank_then_entity(spark):
    chunks = spark.createDataFrame([(1, 1), (2, 2)], "chunk_id long, entity_id long")
    assert [r["entity_id"] for r in R.aggregate_entities(fused(spark, [(1, 2)], [(1, 1)]), chunks).orderBy("position").collect()] == [1, 2]
    assert R.lineage_conflicts(chunks, chunks.withColumn("entity_id", F.lit(9).cast("long"))).count() == 2


def test_dense_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0]), (7, [-1.0, 0.0])], "chunk_id long, vector array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, None)], "query_id long, vector array<double>")
    assert [(r["chunk_id"], r["dense_rank"]) for r in R.dense_topk(v, q, 3).orderBy("dense_rank").collect()] == [(1, 1), (2, 2), (7, 3)]
    assert R.dense_topk(v.limit(0), q).count() == 0 and R.dense_topk(v, q.limit(0)).count() == 0


def test_lexical_edges(spark):
    t = spark.createDataFrame([(1, "Calm calm, 冷靜"), (2, "wild"), (3, None), (4, "")], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "calm CALM !!!"), (2, "!!!"), (3, None)], "query_id long, text string")
    assert [(r["query_id"], r["chunk_id"], r["matches"]) for r in R.lexical_topk(t, q).collect()] == [(1, 1, 2)]


def test_union_keeps_text_evidence_first(spark):
    a = spark.createDataFrame([(1, 5, 0.5, [1, 2])], "query_id long, entity_id long, retrieval_score double, evidence array<long>")
    b = spark.createDataFrame([(1, 5, 0.9, [2, 3, 4]), (1, 6, 0.9, [9])], "query_id long, entity_id long, retrieval_score double, evidence array<long>")
    assert sorted((r["entity_id"], r["retrieval_score"], r["evidence"]) for r in R.unite_candidates(a, b).collect()) == [(5, 0.5, [1, 2, 3]), (6, 0.0, [9])]


def test_index_recall(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 16))
    x = centre[rng.integers(0, 12, 900)] + 0.25 * rng.normal(size=(900, 16))
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "chunk_id long, vector array<double>")
    q = v.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    found = R.coded_topk(R.coded(v, 16), q, 16, 10)
    assert R.recall(R.dense_topk(v, q, 10), found).agg(F.avg("recall")).first()[0] >= 0.9


def test_index_recall_on_the_embeddings(spark, data):
    from emberquill.plans.retrieval_queries import recall_vs_exact

    for folder in (data, data.replace("sf0.001", "sf0.01"), data.replace("sf0.001", "sf0.1")):
        assert recall_vs_exact(spark, folder).agg(F.avg("recall")).first()[0] >= 0.9


def test_the_index_holds_every_usable_row(spark):
    rng = np.random.default_rng(5)
    rows = [(i, row.tolist()) for i, row in enumerate(rng.normal(size=(200, 8)))] + [(900, None), (901, [0.0] * 8), (902, [1.0]), (903, [float("nan")] * 8)]
    v = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    q = v.where("chunk_id < 3 or chunk_id >= 900").withColumnRenamed("chunk_id", "query_id")
    index = R.coded(v, 8)
    assert index.count() == 200
    found = R.coded_topk(index, q, 8, 20, over=10)
    assert found.select("query_id", "chunk_id").distinct().count() == found.count() == 60
    assert R.recall(R.dense_topk(v, q, 20, dimension=8), found).where("recall < 1").count() == 0
    assert R.coded_topk(index.limit(0), q, 8).count() == 0


@pytest.mark.parametrize("cells", [7, 2_000_000])
def test_ties_are_cut_in_the_final_order(spark, monkeypatch, cells):
    monkeypatch.setattr(R, "CELLS", cells)
    texts = spark.createDataFrame([(i, "calm " * (i % 3) + "x", 5) for i in range(400)], "chunk_id long, text string, entity_id long").repartition(3)
    q = spark.createDataFrame([(1, "calm"), (2, "x calm"), (3, "none")], "query_id long, text string")
    found = R.lexical_topk(texts, q, 4)
    assert sorted((r["query_id"], r["lexical_rank"], r["chunk_id"], r["matches"], r["entity_id"]) for r in found.collect()) == [(q, k + 1, 3 * k + 2, m, 5) for q, m in ((1, 2), (2, 3)) for k in range(4)]
    v = texts.select("chunk_id", F.array(F.lit(1.0), (F.col("chunk_id") % 2).cast("double")).alias("vector"))
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [r["chunk_id"] for r in R.dense_topk(v, q, 5).orderBy("dense_rank").collect()] == [0, 2, 4, 6, 8]


def test_branches_name_one_entity(spark):
    d = spark.createDataFrame([(1, 1, 1, 0.9, 10)], "query_id long, chunk_id long, dense_rank int, dense_score double, entity_id long")
    x = lambda e: spark.createDataFrame([(1, 1, 1, 0.8, e)], "query_id long, chunk_id long, lexical_rank int, lexical_score double, entity_id long")
    assert R.fuse(d, x(10)).first()["entity_id"] == 10
    with pytest.raises(Exception, match="two entities for chunk 1"):
        R.fuse(d, x(2)).collect()


def test_queries_without_a_vector_are_recommended_by_text(spark, data, tmp_path):
    from emberquill.plans import retrieval_queries as Q

    spark.read.parquet(f"{data}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data}/embeddings.parquet").where("vec_id < 50").write.parquet(f"{tmp_path}/embeddings.parquet")
    asked = {r[0] for r in Q.hybrid_entities(spark, str(tmp_path)).select("query_id").distinct().collect()}
    got = Q.recommend(spark, str(tmp_path)).collect()
    assert {r["query_id"] for r in got} == asked and max(asked) > 50
    assert all(r["typed"] is None and r["semantic"] > 0 for r in got if r["query_id"] > 50)


def test_visible_chunks_need_every_stage(spark):
    t = lambda rows, s: spark.createDataFrame(rows, s)
    chunks = t([(i, 1, "x", "h", i != 2, "ready") for i in range(1, 4)], "id long, document_id long, content string, content_hash string, is_current boolean, status string")
    docs = t([(1, 7, "s", "k", "en", True, "ready")], "id long, entity_id long, source_key string, document_kind string, language_code string, is_current boolean, status string")
    emb = t([(1, 1, [1.0], "h", "ready"), (2, 1, [1.0], "h", "ready"), (3, 1, [1.0], "old", "ready")], "chunk_id long, model_id long, embedding array<double>, content_hash string, status string")
    models = t([(1, True, True, 1)], "id long, is_active boolean, normalize_embeddings boolean, dimensions int")
    ents = t([(7, True)], "id long, is_active boolean")
    assert [r["chunk_id"] for r in R.visible_chunks(emb, models, chunks, docs, ents, model_id=1, dimension=1).collect()] == [1]


def test_blend(spark):
    rows = spark.createDataFrame([(0.4, 1.0, None), (0.4, 1.0, 1.0), (0.4, None, None), (2.0, None, None), (0.4, 0.0, None)], "s double, p double, t double")
    assert [r[0] for r in rows.select(S.blend(F.col("s"), F.col("p"), F.col("t"))).collect()] == [0.55, 0.6625, 0.4, 1.0, 0.3]


@pytest.mark.parametrize(
    "asked,own,place,want",
    [
        ([1.0, 0.0], [1.0, 0.0], None, (0.4, 1.0, None, 0.55)), ([1.0, 0.0], [1.0, 0.0], 0, (0.4, 1.0, 1.0, 0.6625)), ([0.0, 0.0], [1.0, 0.0], None, (0.4, 0.0, None, 0.4)),
        ([1.0, 0.0], [0.0, 1.0], None, (0.4, 0.0, None, 0.3)), ([1.0, 0.0], [0.0, 1.0], 1, (0.4, 0.0, 1.0, 0.475)), ([1.0, 0.0], [0.0, 0.0], 1, (0.4, 0.0, 0.0, 0.3)),
    ],
)
def test_components(spark, asked, own, place, want):
    rows = spark.createDataFrame([(0.4, asked, own, place)], "s double, a array<double>, o array<double>, p int")
    assert tuple(rows.select(S.components(F.col("s"), F.col("a"), F.col("o"), F.col("p")).alias("c")).first()["c"]) == want


def test_coverage_counts_a_canonical_term_once(spark):
    vocabulary = spark.createDataFrame([(0, "t", "ＲＥＬＩＡＢＬＥ", 1.0), (0, "t", "reliable", 3.0), (0, "t", "合作", 1.0)], "trait_index int, trait string, term string, weight double")
    rows = spark.createDataFrame([(1, "RELIABLE reliable"), (2, "not reliable"), (3, None), (4, "never reliable, but reliable")], "id long, text string")
    assert {r["id"]: r["coverage"] for r in S.affirmed_coverage(rows, vocabulary).collect()} == {1: 0.75, 4: 0.75}
    assert [(r["id"], r["term"]) for r in S.matched_terms(rows, vocabulary).orderBy("id").collect()] == [(1, "reliable"), (4, "reliable")]


def test_rerank(spark):
    rows = spark.createDataFrame([(1, 1, 0.9, -3.0), (1, 2, 0.7, 3.0), (1, 3, 0.6, 0.0), (2, 1, 0.5, 9.0)], "g int, rank int, total double, raw double")
    got = S.rerank(rows, "g", "rank", "total", "raw", weight=0.5, limit=10).orderBy("g", "rank").collect()
    assert [(r["g"], r["pre_rerank_total"]) for r in got] == [(1, 0.7), (1, 0.6), (1, 0.9), (2, 0.5)] and got[3]["reranker"] is None


def test_case_metrics(spark):
    ranked = spark.createDataFrame([("a", i, r) for r, i in enumerate([1, 4, 3, 2], 1)] + [("b", i, r) for r, i in enumerate([8, 7, 6, 5], 1)], "case_id string, item int, rank int")
    judged = spark.createDataFrame([("a", 1, 3), ("a", 2, 1), ("b", 5, 2), ("c", 1, 1), ("a", 4, 0)], "case_id string, item int, grade int")
    got = {r["case_id"]: r for r in E.case_metrics(ranked, judged, k=4).collect()}
    assert got["a"]["recall"] == got["b"]["recall"] == 1 and got["c"]["recall"] == 0
    assert got["b"]["ndcg"] == pytest.approx((3 / math.log2(5)) / 3) and got["a"]["weighted_precision_at_3"] == pytest.approx(3 / 9)
    both = E.report(E.case_metrics(ranked, judged.where("case_id <> 'c'"), k=4)).first()
    assert both["weighted_precision_at_3"] == 0.166667 and both["hit_at_3"] == 0.5


def test_annotation_slices(spark):
    rows = [("A", "empathy", 25, 1, "alice", 3, 3), ("A", "empathy", 25, 1, "bob", 3, 3), ("A", "empathy", 25, 2, "alice", 0, 1), ("A", "empathy", 25, 2, "bob", 2, 1), ("B", "leadership", 95, 3, "alice", 2, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "case_id string, segment string, query_length int, pokemon_id long, annotator string, grade int, final_grade int, annotation_id long").withColumn("created_at", F.lit(None).cast("timestamp"))
    whole = E.slices(df).where("slice = 'overall'").first()
    assert (whole["case_count"], whole["candidate_count"], whole["double_annotation_coverage"], whole["conflict_rate"], whole["adjudication_coverage"]) == (2, 3, 0.666667, 0.5, 0.666667)
    assert E.pair_kappas(df).first()["common_judgment_count"] == 2
    same = spark.createDataFrame([(1, g, n, g) for g in range(4) for n in ("a", "b")], "case_id int, pokemon_id int, annotator string, grade int").withColumn("annotation_id", F.lit(1)).withColumn("created_at", F.lit(None).cast("timestamp"))
    assert E.pair_kappas(same).first()["quadratic_weighted_kappa"] == 1.0


def test_percentiles(spark):
    rows = spark.createDataFrame([(float(x), 1) for x in (4, 1, 3, 2)], "v double, g int")
    r = E.summary(rows, "v", ["g"]).first()
    assert (r["p50"], r["p95"]) == (2.5, 3.85)


def test_feedback(spark):
    items = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "impression_id long, item_id long, rank int")
    given = spark.createDataFrame([(1, 10, 1, "match", "no_reason"), (1, 11, 1, "match", "no_reason"), (2, 10, 1, "not_match", "x")], "impression_id long, item_id long, rank int, verdict string, reason string")
    assert [r["problem"] for r in B.checked(given, items).orderBy("impression_id", "item_id").collect()] == [None, "rank", "unknown_item"]
    shown = spark.createDataFrame([(1, "v1")], "impression_id long, algorithm_version string")
    assert tuple(B.summary(given.limit(0), shown.limit(0)).first()) == (0, 0, 0.0, 0, 0.0)
    with pytest.raises(ValueError):
        B.retained(shown, [], 3, "2025-01-01")


def test_upsert_suppresses_no_ops(spark):
    t = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    s = spark.createDataFrame([(1, "a"), (2, "b"), (4, None)], "k int, v string")
    assert sorted((r["k"], r["v"], r["action"]) for r in M.upsert(t, s, ["k"], ["v"]).collect() if r["v"]) == [(1, "a", "keep"), (2, "b", "update"), (3, "c", "untouched")]


def test_versions(spark):
    stored = spark.createDataFrame([(1, "s", 1, False, "old"), (1, "s", 2, True, "x"), (2, "s", 1, True, "keep")], "e int, k string, version int, is_current boolean, content string").withColumn("content_hash", T.content_hash("content"))
    incoming = spark.createDataFrame([(1, "s", "old"), (2, "s", " keep "), (3, "s", "new")], "e int, k string, content string")
    assert sorted((r["e"], r["version"], r["action"]) for r in M.next_versions(stored, incoming, ["e", "k"]).collect()) == [(1, 3, "replace"), (2, 1, "keep"), (3, 1, "first")]


def test_activation_waits_for_every_chunk(spark):
    docs = spark.createDataFrame([(1, "s", True), (2, "s", False), (3, "t", True), (4, "t", False)], "id int, k string, is_current boolean")
    chunks = spark.createDataFrame([(2, "ready"), (2, "ready"), (4, "ready"), (4, "failed")], "document_id int, status string")
    staged = spark.createDataFrame([(2,), (4,)], "document_id int")
    assert {r["id"]: r["is_current"] for r in M.activated(docs, staged, chunks, ["k"]).collect()} == {1: False, 2: True, 3: True, 4: False}


def test_explanation_rules(spark):
    allowed = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, ["c"])], "e int, evidence_ids array<string>")
    good = "這隻寶可夢性格溫柔而且很可靠值得信任"
    rows = spark.createDataFrame([(1, good, ["a"], None), (2, good + "INTJ", ["b", "b", "x"], "INFP"), (9, "short", [], None)], "e int, text string, citations array<string>, selected string")
    assert sorted((r["e"], r["problem"]) for r in X.problems(rows, allowed, "e").collect()) == [(2, "duplicate_citation"), (2, "foreign_citation"), (2, "foreign_code"), (3, "missing"), (9, "not_chinese"), (9, "unknown_entity")]


def test_calendar(spark):
    rows = spark.createDataFrame([("2026-09-29 14:35:12",), ("2026-09-29 23:30:00",), ("2026-09-30 00:30:00",)], "t string").select(F.to_timestamp("t").alias("t"))
    got = rows.select(K.branch("t"), F.date_format(K.valid_until("t"), "dd HH:mm")).collect()
    assert [tuple(r) for r in got] == [("未", "29 15:00"), ("子", "30 00:00"), ("子", "30 01:00")]
    assert [r[0] for r in spark.createDataFrame([("秋分",), ("大寒",), (None,)], "s string").select(K.season("s")).collect()] == ["秋", "冬", None]
    with pytest.raises(Exception, match="unsupported solar term: x"):
        spark.createDataFrame([("x",)], "s string").select(K.season("s")).collect()


def test_catalogue(spark):
    rows = spark.createDataFrame([(1, "a_b"), (2, "axb"), (3, None)], "entity_id long, n string")
    assert [r["entity_id"] for r in C.search(rows, names=["n"], text="A_B").collect()] == [1]
    listed = spark.createDataFrame([(1, "Overgrow, Chlorophyll", "chlorophyll"), (2, None, "x"), (3, "a", None)], "k long, a string, h string")
    assert sorted((r["k"], r["place"], r["code"], r["is_hidden"]) for r in C.hidden_abilities(listed, ["k"], "a", "h").collect()) == [(1, 0, "overgrow", False), (1, 1, "chlorophyll", True), (2, 0, "x", True), (3, 0, "a", False)]
    assert sorted(r["id"] for r in C.even_sample(spark.range(101), ["id"], 5).collect()) == [0, 25, 50, 75, 100]
    with pytest.raises(ValueError):
        C.page(rows, [F.asc("n")], 0, 5)
