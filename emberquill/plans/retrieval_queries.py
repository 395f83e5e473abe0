"""Retrieval and scoring queries on the driver's tables: documents are chunks, their pokemon_id the entity, embeddings share their numbers.

Queries are the rows whose number is divisible by 100, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from emberquill.functions import text as T
from emberquill.functions import vectors as V
from emberquill.operators import retrieval as R
from emberquill.operators import scoring as S
from emberquill.plans import recommend as P
from emberquill.session import materialise, table

LABELS, DIMENSION = 10, 64


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("pokemon_id").alias("entity_id"))


def _asked(spark: SparkSession, d: str, every: int = 100) -> DataFrame:
    texts = _texts(spark, d).where(F.col("chunk_id") % every == 0).select(F.col("chunk_id").alias("query_id"), "text")
    vectors = _vectors(spark, d).where(F.col("chunk_id") % every == 0).select(F.col("chunk_id").alias("query_id"), "vector")
    return texts.join(vectors, "query_id", "full_outer")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.dense_topk(_vectors(spark, d), _asked(spark, d).select("query_id", "vector")).select("query_id", "chunk_id", F.round("dense_score", 6).alias("dense_score"), "dense_rank")


def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.lexical_topk(_texts(spark, d), _asked(spark, d).select("query_id", "text")).select("query_id", "chunk_id", "matches", F.round("lexical_score", 8).alias("lexical_score"), "lexical_rank")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    asked = _asked(spark, d)
    return R.fuse(R.dense_topk(_vectors(spark, d), asked.select("query_id", "vector")), R.lexical_topk(_texts(spark, d), asked.select("query_id", "text")))


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("query_id", "chunk_id", "dense_rank", "lexical_rank", F.round("rrf_score", 10).alias("rrf_score"))


def hybrid_entities(spark: SparkSession, d: str) -> DataFrame:
    found = R.hybrid(_vectors(spark, d), _texts(spark, d), _texts(spark, d), _asked(spark, d))
    return found.select("query_id", "entity_id", F.round("retrieval_score", 8).alias("retrieval_score"), F.round("best_chunk_score", 8).alias("best_chunk_score"), "best_branch_rank", F.array_join("evidence", ",").alias("evidence"), "position")


def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each query's text and vector branches, united as text and type candidates are."""
    asked = _asked(spark, d)
    named = _vectors(spark, d).join(_texts(spark, d).select("chunk_id", "entity_id"), "chunk_id", "left")
    dense, lexical = R.dense_topk(named, asked.select("query_id", "vector")), R.lexical_topk(_texts(spark, d), asked.select("query_id", "text"))
    nothing = lambda df, ranks: spark.createDataFrame([], T_.StructType([f for f in df.schema if f.name in ranks]))
    lexical, dense = (
        R.aggregate_entities(R.fuse(nothing(dense, ("query_id", "chunk_id", "dense_rank", "dense_score", "entity_id")), lexical)),
        R.aggregate_entities(R.fuse(dense, nothing(lexical, ("query_id", "chunk_id", "lexical_rank", "lexical_score", "entity_id")))),
    )
    return R.unite_candidates(lexical, dense).select("query_id", "entity_id", F.round("retrieval_score", 8).alias("retrieval_score"), F.array_join("evidence", ",").alias("evidence"))


def vector_mean_normalised(spark: SparkSession, d: str) -> DataFrame:
    mean = V.mean_vectors(table(spark, d, "embeddings"), ["label"], "embedding", places=6)
    return mean.select("label", F.posexplode("embedding").alias("place", "value"))


def vector_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    """Means weighted by 1 + vec_id mod 3, as windows are weighted by their length."""
    mean = V.mean_vectors(table(spark, d, "embeddings"), ["label"], "embedding", 1 + F.col("vec_id") % 3, places=6)
    return mean.select("label", F.posexplode("embedding").alias("place", "value"))


def label_affinity(spark: SparkSession, d: str) -> DataFrame:
    """The cosine, clipped to 0..1, of every vector and every label's prototype."""
    vectors = table(spark, d, "embeddings")
    prototypes = V.mean_vectors(vectors, ["label"], "embedding", places=8).withColumnRenamed("embedding", "prototype")
    return S.affinities(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), prototypes, "label").select("id", "label", F.round("affinity", 5).alias("affinity"))


def score_blend(spark: SparkSession, d: str) -> DataFrame:
    """Stored scores blended anew: text match of semantic and personality, with the type's share where there is one."""
    rows = table(spark, d, "recommendation_result").select("request_id", "pokemon_id", "semantic", "personality", "mbti")
    return rows.withColumn("blended", S.blend(F.col("semantic"), F.col("personality"), F.col("mbti"))).groupBy("request_id", "pokemon_id").agg(F.max("blended").alias("blended"), F.count("*").alias("n"))


def _affinity(number: str):
    """Four affinities by a number's remainders: all zero, orthogonal and common ones occur."""
    return F.array(*(F.when(F.col(number) % m == r, (F.col(number) % 7 + 1) / 8).otherwise(0.0) for m, r in ((2, 0), (2, 1), (3, 1), (5, 2))))


def score_components(spark: SparkSession, d: str) -> DataFrame:
    """All components of every stored candidate from two affinity arrays; every third request has chosen a type."""
    rows = table(spark, d, "recommendation_result").select("request_id", "pokemon_id", "semantic").where(F.col("semantic").isNotNull() & ~F.isnan("semantic")).distinct()
    zero = F.array(*[F.lit(0.0)] * 4)
    place = F.when(F.col("request_id") % 3 == 0, (F.col("request_id") % 4).cast("int"))
    scored = S.components(F.col("semantic"), F.when(F.col("request_id") % 11 == 0, zero).otherwise(_affinity("request_id")), F.when(F.col("pokemon_id") % 13 == 0, zero).otherwise(_affinity("pokemon_id")), place)
    return rows.select("request_id", "pokemon_id", scored.alias("c")).select("request_id", "pokemon_id", "c.*")


def final_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Each request's ten best candidates in the final total order."""
    rows = table(spark, d, "recommendation_result").where(F.col("total").isNotNull() & ~F.isnan("total"))
    best = rows.groupBy("request_id", "pokemon_id").agg(F.max(F.struct("total", "semantic", "personality")).alias("s")).select("request_id", "pokemon_id", "s.*")
    return S.final_order(best, "request_id", [F.desc_nulls_last("total"), F.desc_nulls_last("semantic"), F.desc_nulls_last("personality"), F.asc("pokemon_id")], 10).select("request_id", "pokemon_id", "total", "rank")


def rerank_blend(spark: SparkSession, d: str) -> DataFrame:
    """The first ten candidates of each request rescored: three quarters base, one quarter the logistic of a raw score."""
    rows = final_ranking(spark, d)
    raw = rows.withColumn("raw", F.col("pokemon_id") % 7 - 3)
    return S.rerank(raw, "request_id", "rank", "total", "raw", weight=0.25, limit=10).select("request_id", "pokemon_id", "pre_rerank_total", "reranker", "total", "rank")


def unit_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source")
    return rows.select("doc_id", F.round(T.unit_hash(F.lit("v1"), F.col("source"), F.col("doc_id").cast("string")), 9).alias("unit"))


def daily_selection(spark: SparkSession, d: str) -> DataFrame:
    """One candidate a request: its total on the request's range and a daily hash."""
    rows = final_ranking(spark, d)
    return S.daily_choice(rows, "request_id", "pokemon_id", "total", "rank", ("v1", "2025-01-01")).select("request_id", "pokemon_id", F.round("selection_score", 8).alias("selection_score"), "source_rank")


def keyword_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The share of each trait's weighted terms that a document holds as substrings."""
    return S.substring_coverage(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), S.demo_vocabulary(spark))


def trait_vector(spark: SparkSession, d: str) -> DataFrame:
    """Each document's weights by trait over all traits, at length one."""
    return S.trait_vectors(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), S.demo_vocabulary(spark)).select("id", F.posexplode("vector").alias("trait_index", "value"))


def affirmed_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms a request affirms (not negated in their clause), its three weightiest first."""
    return S.matched_terms(table(spark, d, "recommendation_request").select(F.col("request_id").alias("id"), "text"), S.demo_vocabulary(spark), 3)


def recommend(spark: SparkSession, d: str, every: int = 100) -> DataFrame:
    """The three best entities of every query; types are the vectors' labels, chosen by queries of an even hundred; a query without a vector has no type and is answered by its text."""
    e = table(spark, d, "embeddings")
    texts = _texts(spark, d)
    vectors = _vectors(spark, d).join(texts.select("chunk_id", "entity_id"), "chunk_id").where(F.col("entity_id").isNotNull())
    asked = _asked(spark, d, every).join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id", "left").withColumn("type", F.when(F.col("query_id") % 200 == 0, F.col("label"))).drop("label")
    words = F.element_at(F.array(*(F.lit(w) for w in ("quiet gentle", "proud bright", "guard keeps", "curious studies"))), (F.col("type") % 4 + 1).cast("int"))
    prototypes = V.mean_vectors(e, ["label"], "embedding").select(F.col("label").alias("type"), F.col("embedding").alias("prototype")).withColumn("profile_text", words)
    vocabulary = S.demo_vocabulary(spark).withColumn("trait", F.col("trait_index").cast("string"))
    found = P.recommend(asked, vectors, texts, prototypes, vocabulary, k=3)
    return found.select("query_id", "entity_id", "semantic", F.round("personality", 5).alias("personality"), F.round("typed", 5).alias("typed"), F.round("total", 5).alias("total"), "rank")


def recall_vs_exact(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 10 of the coded index against the exact result, by query."""
    vectors, asked = _vectors(spark, d), _asked(spark, d).select("query_id", "vector").where(F.col("vector").isNotNull())
    index = materialise(R.coded(vectors, DIMENSION), "index")
    return R.recall(R.dense_topk(vectors, asked, 10), R.coded_topk(index, asked, DIMENSION, 10))


QUERIES = {
    f.__name__: f
    for f in (
        dense_topk, lexical_topk, rrf_fuse, hybrid_entities, candidate_union, vector_mean_normalised, vector_weighted_mean, label_affinity, score_blend, score_components,
        final_ranking, rerank_blend, unit_hash, daily_selection, keyword_coverage, trait_vector, affirmed_terms, recommend, recall_vs_exact,
    )
}

_DOT = "list_sum(list_transform(range(1, 65), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE))"
_NORM = "sqrt(" + _DOT + ")"
_DENSE = f"""q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0),
ds AS (SELECT query_id, vec_id AS chunk_id, round({_DOT.format('embedding', 'qv')} / ({_NORM.format('embedding', 'embedding')} * {_NORM.format('qv', 'qv')}), 10) AS dense_score FROM embeddings, q),
dn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, chunk_id)::INTEGER AS dense_rank FROM ds QUALIFY dense_rank <= 50)"""
_LEX = r"""qt AS (SELECT doc_id AS query_id, unnest(list_distinct_stable[1:32]) AS token FROM (
  SELECT doc_id, list_transform(list_filter(list_zip(ts, range(1, len(ts) + 1)), lambda p: list_position(ts, p[1]) = p[2]), lambda p: p[1]) AS list_distinct_stable
  FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda t: regexp_matches(t, '[\p{L}\p{N}]')) AS ts FROM documents WHERE doc_id % 100 = 0 AND text IS NOT NULL))),
dt AS (SELECT doc_id AS chunk_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM documents) GROUP BY 1, 2),
ls AS (SELECT query_id, chunk_id, sum(tf)::BIGINT AS matches FROM qt JOIN dt USING (token) GROUP BY 1, 2),
lx AS (SELECT *, round(0.1 * matches / (0.1 * matches + 1), 10) AS lexical_score, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, chunk_id)::INTEGER AS lexical_rank FROM ls QUALIFY lexical_rank <= 50)"""
_FUSED = "fu AS (SELECT query_id, chunk_id, dense_rank, lexical_rank, coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) AS rrf_score FROM dn FULL JOIN lx USING (query_id, chunk_id))"


def _agg(source: str, name: str) -> str:
    return f"""{name}r AS (SELECT s.query_id, s.chunk_id, s.rrf_score, least(coalesce(dense_rank, 999), coalesce(lexical_rank, 999)) AS br, pokemon_id AS entity_id FROM {source} s JOIN documents ON doc_id = s.chunk_id WHERE pokemon_id IS NOT NULL),
{name}t AS (SELECT *, row_number() OVER (PARTITION BY query_id, entity_id ORDER BY round(rrf_score, 12) DESC, br, chunk_id) AS place FROM {name}r QUALIFY place <= 3),
{name}g AS (SELECT query_id, entity_id, round(0.75 * max(rrf_score) + 0.25 * avg(rrf_score), 10) AS retrieval_score, round(max(rrf_score), 10) AS best_chunk_score, min(br)::INTEGER AS best_branch_rank, list(chunk_id ORDER BY place) AS evidence FROM {name}t GROUP BY 1, 2),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY retrieval_score DESC, best_chunk_score DESC, best_branch_rank, entity_id)::INTEGER AS position FROM {name}g QUALIFY position <= 50)"""


_MEAN = """u AS (SELECT label, unnest(range(0, 64))::INTEGER AS place, unnest(embedding)::DOUBLE AS x, {w} AS w FROM embeddings),
m AS (SELECT label, place, sum(x * w) / sum(w) AS v FROM u GROUP BY 1, 2)"""
_MEANQ = "WITH " + _MEAN + " SELECT label, place, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 6) + 0 AS value FROM m"
_FINAL = """b AS (SELECT request_id, pokemon_id, max({'t': total, 's': semantic, 'p': personality}) AS s FROM recommendation_result WHERE total IS NOT NULL AND NOT isnan(total) GROUP BY 1, 2),
f AS (SELECT request_id, pokemon_id, s.t AS total, row_number() OVER (PARTITION BY request_id ORDER BY s.t DESC NULLS LAST, s.s DESC NULLS LAST, s.p DESC NULLS LAST, pokemon_id)::INTEGER AS rank FROM b QUALIFY rank <= 10)"""
_UNIT = "(('0x' || substr(sha256({0}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615.0::DOUBLE)"
_AFFINITY = "[" + ", ".join(f"CASE WHEN {{0}} % {m} = {r} THEN ({{0}} % 7 + 1) / 8.0::DOUBLE ELSE 0.0::DOUBLE END" for m, r in ((2, 0), (2, 1), (3, 1), (5, 2))) + "]"
_VOCABULARY = "v(trait_index, trait, term, weight) AS (VALUES " + ", ".join(f"({i}, '{t}', '{w}', {x}::DOUBLE)" for i, t, w, x in S.DEMO_TERMS) + ")"
SQL = {
    "dense_topk": f"WITH {_DENSE} SELECT query_id, chunk_id, round(dense_score, 6) + 0 AS dense_score, dense_rank FROM dn",
    "lexical_topk": f"WITH {_LEX} SELECT query_id, chunk_id, matches, round(lexical_score, 8) AS lexical_score, lexical_rank FROM lx",
    "rrf_fuse": f"WITH {_DENSE}, {_LEX}, {_FUSED} SELECT query_id, chunk_id, dense_rank, lexical_rank, round(rrf_score, 10) AS rrf_score FROM fu",
    "hybrid_entities": f"WITH {_DENSE}, {_LEX}, {_FUSED}, {_agg('fu', 'h')} SELECT query_id, entity_id, round(retrieval_score, 8) AS retrieval_score, round(best_chunk_score, 8) AS best_chunk_score, best_branch_rank, array_to_string(evidence, ',') AS evidence, position FROM h",
    "candidate_union": f"""WITH {_DENSE}, {_LEX},
lf AS (SELECT query_id, chunk_id, NULL::INTEGER AS dense_rank, lexical_rank, 1.0::DOUBLE / (60 + lexical_rank) AS rrf_score FROM lx), df AS (SELECT query_id, chunk_id, dense_rank, NULL::INTEGER AS lexical_rank, 1.0::DOUBLE / (60 + dense_rank) AS rrf_score FROM dn),
{_agg('lf', 'ca')}, {_agg('df', 'cb')}
SELECT query_id, entity_id, round(coalesce(ca.retrieval_score, 0), 8) AS retrieval_score, array_to_string(list_concat(coalesce(ca.evidence, []), list_filter(coalesce(cb.evidence, []), lambda x: NOT list_contains(coalesce(ca.evidence, []), x)))[1:3], ',') AS evidence FROM ca FULL JOIN cb USING (query_id, entity_id)""",
    "vector_mean_normalised": _MEANQ.format(w="1"),
    "vector_weighted_mean": _MEANQ.format(w="1 + vec_id % 3"),
    "label_affinity": "WITH " + _MEAN.format(w="1") + f""", p AS (SELECT label, list(round(v / n, 8) ORDER BY place) AS prototype FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY label)) AS n FROM m) GROUP BY 1)
SELECT vec_id AS id, p.label, round(greatest(0, least(1, {_DOT.format('embedding', 'prototype')} / ({_NORM.format('embedding', 'embedding')} * {_NORM.format('prototype', 'prototype')}))), 5) AS affinity FROM embeddings, p""",
    "score_blend": """WITH r AS (SELECT request_id, pokemon_id, CASE WHEN mbti IS NULL THEN t ELSE 0.75 * t + 0.25 * mbti END AS x FROM (SELECT *, CASE WHEN personality IS NULL THEN semantic ELSE 0.75 * semantic + 0.25 * personality END AS t FROM recommendation_result))
SELECT request_id, pokemon_id, max(round(greatest(0, least(1, x)), 8)) AS blended, count(*) AS n FROM r GROUP BY 1, 2""",
    "score_components": f"""WITH r AS (SELECT DISTINCT request_id, pokemon_id, semantic FROM recommendation_result WHERE semantic IS NOT NULL AND NOT isnan(semantic)),
v AS (SELECT *, CASE WHEN request_id % 11 = 0 THEN [0.0, 0.0, 0.0, 0.0] ELSE {_AFFINITY.format("request_id")} END AS q, CASE WHEN pokemon_id % 13 = 0 THEN [0.0, 0.0, 0.0, 0.0] ELSE {_AFFINITY.format("pokemon_id")} END AS e FROM r),
n AS (SELECT *, greatest(0, least(1, semantic)) AS s, list_dot_product(q::DOUBLE[], e::DOUBLE[]) AS d, sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])) AS a, sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])) AS b, CASE WHEN request_id % 3 = 0 THEN e[request_id % 4 + 1] END AS t FROM v),
p AS (SELECT *, CASE WHEN a > 0 AND b > 0 THEN greatest(0, least(1, d / (a * b))) ELSE 0 END AS p FROM n),
x AS (SELECT *, CASE WHEN a > 0 AND b > 0 THEN 0.75::DOUBLE * s + 0.25::DOUBLE * p ELSE s END AS m FROM p)
SELECT request_id, pokemon_id, round(s, 8) AS semantic, round(p, 8) AS personality, round(t, 8) AS typed, round(greatest(0, least(1, CASE WHEN t IS NULL THEN m ELSE 0.75::DOUBLE * m + 0.25::DOUBLE * t END)), 8) AS total FROM x""",
    "final_ranking": f"WITH {_FINAL} SELECT * FROM f",
    "rerank_blend": f"""WITH {_FINAL}, r AS (SELECT *, 1 / (1 + exp(-(pokemon_id % 7 - 3)::DOUBLE)) AS sg FROM f), c AS (SELECT request_id, count(*) AS n FROM f GROUP BY 1),
t AS (SELECT request_id, pokemon_id, rank AS base_rank, round(total, 8) AS pre_rerank_total, CASE WHEN n >= 3 THEN round(sg, 8) END AS reranker, CASE WHEN n >= 3 THEN round(0.75 * total + 0.25 * sg, 8) ELSE round(total, 8) END AS total, total AS base FROM r JOIN c USING (request_id))
SELECT request_id, pokemon_id, pre_rerank_total, reranker, total, row_number() OVER (PARTITION BY request_id ORDER BY total DESC, base DESC, base_rank)::INTEGER AS rank FROM t""",
    "unit_hash": "SELECT doc_id, round(" + _UNIT.format("concat_ws('|', 'v1', source, doc_id::VARCHAR)") + ", 9) AS unit FROM documents",
    "daily_selection": f"""WITH {_FINAL}, w AS (SELECT *, min(total) OVER p AS lo, max(total) OVER p AS hi, count(*) OVER p AS n FROM f WINDOW p AS (PARTITION BY request_id)),
s AS (SELECT request_id, pokemon_id, rank, total, round(0.9 * CASE WHEN hi - lo > 1e-12 THEN (total - lo) / (hi - lo) ELSE 1 - (rank - 1)::DOUBLE / greatest(1, n - 1) END + 0.1 * {_UNIT.format("concat_ws('|', 'v1', '2025-01-01', pokemon_id::VARCHAR)")}, 10) AS selection_score FROM w)
SELECT request_id, pokemon_id, round(selection_score, 8) AS selection_score, rank AS source_rank FROM s QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY selection_score DESC, total DESC, pokemon_id) = 1""",
    "keyword_coverage": f"WITH {_VOCABULARY}, t AS (SELECT trait_index, trait, sum(weight) AS w FROM v GROUP BY 1, 2) SELECT doc_id AS id, v.trait, round(sum(v.weight) / any_value(t.w), 8) AS coverage FROM documents, v JOIN t USING (trait) WHERE contains(lower(text), v.term) GROUP BY doc_id, v.trait",
    "trait_vector": f"""WITH {_VOCABULARY}, g AS (SELECT DISTINCT trait_index FROM v), x AS (SELECT doc_id AS id, g.trait_index, coalesce(sum(v.weight) FILTER (contains(lower(text), v.term)), 0) AS s FROM documents, g JOIN v USING (trait_index) WHERE text IS NOT NULL GROUP BY 1, 2),
n AS (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY id)) AS l FROM x) SELECT id, trait_index::INTEGER AS trait_index, round(CASE WHEN l > 0 THEN s / l ELSE 0 END, 8) AS value FROM n""",
}
