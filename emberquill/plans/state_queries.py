"""Catalogue contracts, index states, versions, sources and reports on the driver's tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberquill.functions import text as T
from emberquill.operators import aggregate as A
from emberquill.operators import catalog as C
from emberquill.operators import evaluation as E
from emberquill.operators import explain as X
from emberquill.operators import merge as M
from emberquill.operators import retrieval as R
from emberquill.plans import retrieval_queries, table_queries, table_sql
from emberquill.session import shared_folder, table
from emberquill.sources import files

OWN = ["name_zh", "name_en", "category_zh", "genus", "hidden_ability", "habitat", "color", "shape", "growth_rate"]


def _latest(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    rows = table(spark, d, "pokedex_final").select(F.col("pokedex_number").try_cast("bigint").alias("entity_id"), "source_row", "loaded_at", *columns)
    return C.latest(rows.where(F.col("entity_id").isNotNull()), ["entity_id"], ["loaded_at", "source_row"])


def _images(spark: SparkSession, d: str) -> DataFrame:
    e = _latest(spark, d, ["image_url", "sprite_url"])
    pairs = F.array(*(F.struct(F.lit(kind).alias("image_kind"), F.col(c).alias("image_url"), F.lit(kind == "artwork").alias("is_primary"), (F.col("entity_id") * 2 + n).alias("image_id")) for n, (kind, c) in enumerate((("artwork", "image_url"), ("sprite", "sprite_url")))))
    return e.select("entity_id", F.explode(pairs).alias("i")).select("entity_id", "i.*").where(F.col("image_url").isNotNull())


def catalogue_contract(spark: SparkSession, d: str) -> DataFrame:
    """The flat contract of every entity's latest delivery, its children pivoted."""
    texts = ["description_zh", "flavor_text_en", "analysis_text"]
    e = _latest(spark, d, [*OWN, *texts])
    told = e.select("entity_id", F.explode(F.array(*(F.struct(F.lit(f"csv:{c}").alias("source_key"), F.col(c).alias("content")) for c in texts))).alias("t")).select("entity_id", "t.*").where(F.col("content").isNotNull())
    own = e.select("entity_id", *(T.optional(c).alias(c) if c in ("hidden_ability", "habitat") else c for c in OWN))
    return C.contract(own, table_queries._bridge(spark, d), table(spark, d, "type_definitions"), told, _images(spark, d))


def catalogue_metadata(spark: SparkSession, d: str) -> DataFrame:
    return C.metadata(_latest(spark, d, OWN), table_queries._bridge(spark, d), table(spark, d, "type_definitions"), _images(spark, d))


def image_order(spark: SparkSession, d: str) -> DataFrame:
    return C.image_order(_images(spark, d)).select("entity_id", "image_id", "image_kind", "place")


def _embedded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Chunks as first delivered, and a deterministic set of their vectors' states."""
    chunks = C.latest(table(spark, d, "pokemon_knowledge_chunks").select(F.col("id").alias("chunk_id"), "document_id", "chunk_no", "content_hash"), ["chunk_id"], ["chunk_no"])
    status = F.when(F.col("chunk_no") % 7 == 0, "failed").otherwise("ready")
    states = chunks.where(F.col("chunk_no") % 17 != 0).select("chunk_id", status.alias("status"), F.lit(True).alias("has_vector"), F.when(F.col("chunk_no") % 13 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.when(status == "failed", F.concat(F.lit("e"), F.col("chunk_no").cast("string"))).alias("last_error"))
    return chunks, states


def _sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "pokemon_knowledge_documents").select("id", F.col("pokemon_id").alias("entity_id"), "source_key", "version", "is_current", "status", "content_hash")
    described = docs.where("version = 1").groupBy("entity_id", "source_key").agg(F.max("content_hash").alias("content_hash"))
    return M.source_states(described, docs.where(F.col("entity_id").isNotNull()), M.embedding_states(*_embedded(spark, d)))


def embedding_states(spark: SparkSession, d: str) -> DataFrame:
    return M.embedding_states(*_embedded(spark, d)).where(F.col("document_id").isNotNull())


def source_states(spark: SparkSession, d: str) -> DataFrame:
    return _sources(spark, d).select("entity_id", "source_key", "status", "total", "ready").where(F.col("entity_id").isNotNull())


def entity_states(spark: SparkSession, d: str) -> DataFrame:
    return M.entity_states(_latest(spark, d, []).select("entity_id"), _sources(spark, d))


def chunk_sync(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after every third of them has vanished from its document's text and every fifth has a new number."""
    rows = C.latest(table(spark, d, "pokemon_knowledge_chunks").where(F.col("document_id").isNotNull()).select("id", "document_id", "is_current", "status", "chunk_no"), ["id"], ["chunk_no"])
    wanted = rows.where(F.col("chunk_no") % 3 != 0).select(F.when(F.col("chunk_no") % 5 == 0, F.concat("id", F.lit("n"))).otherwise(F.col("id")).alias("id"), "document_id")
    return M.synchronise_chunks(rows, wanted)


def visible_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that may be searched, by entity."""
    chunks = C.latest(table(spark, d, "pokemon_knowledge_chunks").select("id", "document_id", "content", "content_hash", "is_current", "status", "chunk_no"), ["id"], ["chunk_no"])
    docs = table(spark, d, "pokemon_knowledge_documents").select("id", F.col("pokemon_id").alias("entity_id"), "source_key", "document_kind", "language_code", "is_current", "status")
    vectors = chunks.select(F.col("id").alias("chunk_id"), F.lit(1).alias("model_id"), F.array(F.lit(1.0)).alias("embedding"), F.when(F.col("chunk_no") % 4 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.lit("ready").alias("status"))
    models = spark.createDataFrame([(1, True, True, 1), (2, False, True, 1)], "id int, is_active boolean, normalize_embeddings boolean, dimensions int")
    entities = _latest(spark, d, []).select(F.col("entity_id").alias("id"), (F.col("entity_id") % 5 != 0).alias("is_active"))
    return R.visible_chunks(vectors, models, chunks, docs, entities, model_id=1, dimension=1).groupBy("entity_id").agg(F.count("*").alias("chunks"), F.count_distinct("document_id").alias("documents"))


def activated_versions(spark: SparkSession, d: str) -> DataFrame:
    """Documents after the staged versions whose every chunk is ready took over; the latest content of each source is wanted."""
    docs = table(spark, d, "pokemon_knowledge_documents").select("id", "pokemon_id", "source_key", "version", "is_current", "content_hash")
    keys = ["pokemon_id", "source_key"]
    wanted = docs.groupBy(*keys).agg(F.max_by("content_hash", "version").alias("content_hash"))
    staged = M.staged(docs, wanted, keys).select(F.col("id").alias("document_id"))
    chunks = table(spark, d, "pokemon_knowledge_chunks").select("document_id", F.lit("ready").alias("status")).unionByName(docs.where("version % 2 = 1").select(F.col("id").alias("document_id"), F.lit("ready").alias("status")))
    return M.activated(docs, staged, chunks, keys).select("id", "is_current")


def switched_models(spark: SparkSession, d: str) -> DataFrame:
    return A.switched(table(spark, d, "type_definitions").select(F.col("code").alias("id"), (F.col("code") == "fire").alias("is_active")), "water")


def annotation_report(spark: SparkSession, d: str) -> DataFrame:
    return E.annotation_report(table(spark, d, "annotation_quality_row"))


def repeated_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Problems of payloads, a part of which repeat their types, images or descriptions."""
    rows = A.nested(table(spark, d, "pokedex_final"), table(spark, d, "type_definitions"))
    twice = lambda c, n: F.when(F.col("source_row") % n == 0, F.concat(c, c)).otherwise(F.col(c)).alias(c)
    return A.payload_problems(rows.select("source_row", twice("type_codes", 5), twice("descriptions", 7), twice("images", 11)), "source_row")


def stable_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Whether the hybrid retrieval gives every query the same entities and scores again when the corpus is partitioned otherwise."""
    asked = retrieval_queries._asked(spark, d)
    texts, vectors = retrieval_queries._texts(spark, d), retrieval_queries._vectors(spark, d)
    ranked = lambda t, v: R.hybrid(v, t, texts, asked).select("query_id", F.col("position").alias("rank"), "entity_id", "retrieval_score")
    return E.same_outputs(ranked(texts, vectors), ranked(texts.repartition(5, "chunk_id"), vectors.repartition(3, "chunk_id")), "query_id", "entity_id", ["retrieval_score"])


def checked_terms(spark: SparkSession, d: str) -> DataFrame:
    """Why a request's text can't be a vocabulary term of at most 40 letters, and whether each catalogue image is at a secure address."""
    terms = table(spark, d, "evaluation_cases").select(F.col("item_id").alias("id"), F.coalesce(T.term_problem("query", 40), F.lit("fine")).alias("verdict"))
    images = table(spark, d, "pokedex_final").select(F.col("source_row").alias("id"), F.when(T.secure_address("image_url"), "secure").otherwise("not secure").alias("verdict"))
    return terms.withColumn("what", F.lit("term")).unionByName(images.withColumn("what", F.lit("image")))


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The types written as CSV into the shared folder and read back strictly, with their row numbers."""
    folder = f"{shared_folder(spark)}/emberquill-csv-{uuid.uuid4().hex}"
    columns = ["code", "name_en", "name_zh"]
    table(spark, d, "type_definitions").select(columns).coalesce(1).orderBy("code").write.csv(folder, header=True)
    return files.read_csv(spark, f"{folder}/part-*.csv", columns, key=["code"], number="source_row")


def published_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Public Chinese descriptions through the catalogue's filters: of entities 5 to 50, the kind compared whatever its case."""
    rows = C.public_descriptions(table(spark, d, "pokemon_knowledge_documents"))
    return C.filtered(rows, equal={"is_current": True}, folded={"document_kind": " DESCRIPTION"}, between={"pokemon_id": (5, 50)}).select("id")


def cited_explanations(spark: SparkSession, d: str) -> DataFrame:
    """Problems of explanations made by rule from each request's evidence: some cite twice, some what they mustn't, some aren't Chinese."""
    evidence = table(spark, d, "evidence_response").where(F.col("request_id").isNotNull()).groupBy("request_id").agg(F.min("evidence_id").alias("first"), F.max("evidence_id").alias("last"))
    allowed = evidence.select("request_id", F.array("first").alias("evidence_ids"))
    prose = F.when(F.col("request_id") % 3 == 0, "a companion that likes quiet woods INTJ").otherwise("這隻寶可夢總是照顧夥伴也喜歡安靜的樹林INFP")
    cited = F.when(F.col("request_id") % 2 == 0, F.array("first", "first")).otherwise(F.array("first", "last"))
    made = evidence.where(F.col("request_id") % 5 != 0).select("request_id", prose.alias("text"), cited.alias("citations"), F.lit("INFP").alias("selected"))
    return X.problems(made, allowed, "request_id")


QUERIES = {
    f.__name__: f
    for f in (
        catalogue_contract, catalogue_metadata, image_order, embedding_states, source_states, entity_states, chunk_sync, visible_chunks, activated_versions, switched_models,
        annotation_report, repeated_payloads, stable_retrieval, checked_terms, csv_round_trip, published_catalogue, cited_explanations,
    )
}

_LATEST = "l AS (SELECT *, try_cast(pokedex_number AS BIGINT) AS entity_id FROM pokedex_final WHERE try_cast(pokedex_number AS BIGINT) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY try_cast(pokedex_number AS BIGINT) ORDER BY loaded_at DESC NULLS LAST, source_row DESC) = 1)"
_WS = r"[\s\p{Z}\x1c-\x1f\x{85}]"


def _told(c: str) -> str:
    """A text without outer blanks, null if empty or unknown."""
    bare = f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"
    return f"CASE WHEN {bare} <> '' AND lower({bare}) <> 'unknown' THEN {bare} END"


_TYPES = f"""b AS (SELECT entity_id, 1 AS slot, lower({_told('type_1')}) AS code FROM l UNION ALL SELECT entity_id, 2, lower({_told('type_2')}) FROM l),
y AS (SELECT entity_id, string_agg(name_zh, ', ' ORDER BY slot) AS type_zh, max(name_en) FILTER (slot = 1) AS type_1, max(name_en) FILTER (slot = 2) AS type_2 FROM b JOIN type_definitions USING (code) GROUP BY 1)"""
_CHUNKS = "c AS (SELECT id AS chunk_id, document_id, chunk_no, content_hash, is_current, status FROM pokemon_knowledge_chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY chunk_no DESC) = 1)"
_STATES = f"""{_CHUNKS}, n AS (SELECT document_id, count(*) AS total, count(*) FILTER (chunk_no % 17 <> 0 AND chunk_no % 7 <> 0 AND chunk_no % 13 <> 0) AS ready, count(*) FILTER (chunk_no % 17 <> 0 AND chunk_no % 7 = 0) AS failed,
  arg_max('e' || chunk_no, chunk_id) FILTER (chunk_no % 17 <> 0 AND chunk_no % 7 = 0) AS last_error FROM c GROUP BY 1)"""
_DOCS = """d AS (SELECT id, pokemon_id AS entity_id, source_key, version, is_current, status, content_hash FROM pokemon_knowledge_documents WHERE pokemon_id IS NOT NULL),
w AS (SELECT entity_id, source_key, max(content_hash) AS dh FROM d WHERE version = 1 GROUP BY 1, 2)"""
_SOURCES = f"""{_STATES}, {_DOCS}, s AS (SELECT d.* FROM d JOIN w ON w.entity_id = d.entity_id AND w.source_key = d.source_key AND w.dh = d.content_hash WHERE NOT is_current QUALIFY row_number() OVER (PARTITION BY d.entity_id, d.source_key ORDER BY version DESC, id DESC) = 1),
k AS (SELECT entity_id, source_key FROM w UNION SELECT entity_id, source_key FROM d WHERE is_current),
j AS (SELECT k.*, u.id AS cid, u.status AS cs, s.id AS sid, s.status AS ss, u.id IS NOT NULL AND (k.source_key = 'profile' OR coalesce(u.content_hash = w.dh, false)) AS m
  FROM k LEFT JOIN w USING (entity_id, source_key) LEFT JOIN (SELECT * FROM d WHERE is_current) u USING (entity_id, source_key) LEFT JOIN s USING (entity_id, source_key)),
o AS (SELECT j.*, CASE WHEN m THEN cid ELSE sid END AS target, CASE WHEN m THEN cs ELSE ss END AS ts FROM j),
q AS (SELECT o.entity_id, o.source_key, CASE WHEN m AND coalesce(total, 0) > 0 AND ready = total THEN 'ready' WHEN target IS NOT NULL AND (coalesce(ts = 'failed', false) OR coalesce(failed, 0) > 0) THEN 'failed'
  WHEN target IS NOT NULL OR cid IS NOT NULL THEN 'stale' ELSE 'unindexed' END AS status, coalesce(total, 0) AS total, coalesce(ready, 0) AS ready FROM o LEFT JOIN n ON n.document_id = o.target)"""
SQL = {
    "catalogue_contract": f"""WITH {_LATEST}, {_TYPES}
SELECT entity_id, name_zh, name_en, coalesce(category_zh, '') AS category_zh, coalesce(genus, '') AS genus, coalesce({_told('hidden_ability')}, 'Unknown') AS hidden_ability, coalesce({_told('habitat')}, 'Unknown') AS habitat, coalesce(color, '') AS color, coalesce(shape, '') AS shape, coalesce(growth_rate, '') AS growth_rate,
  coalesce(y.type_zh, '') AS type_zh, coalesce(y.type_1, 'Unknown') AS type_1, coalesce(y.type_2, 'Unknown') AS type_2, coalesce(description_zh, '') AS description_zh, coalesce(flavor_text_en, '') AS flavor_text_en, coalesce(analysis_text, '') AS analysis_text, coalesce(image_url, '') AS image_url, coalesce(sprite_url, '') AS sprite_url
FROM (SELECT * EXCLUDE (type_zh, type_1, type_2) FROM l) LEFT JOIN y USING (entity_id)""",
    "catalogue_metadata": f"""WITH {_LATEST}, {_TYPES}
SELECT entity_id, name_zh, name_en, coalesce(category_zh, '') AS category_zh, coalesce(genus, '') AS genus, coalesce(y.type_zh, '') AS type_zh, coalesce(y.type_1, '') AS type_1, coalesce(y.type_2, '') AS type_2, coalesce(image_url, '') AS image_url, coalesce(sprite_url, '') AS sprite_url FROM (SELECT * EXCLUDE (type_zh, type_1, type_2) FROM l) LEFT JOIN y USING (entity_id)""",
    "image_order": f"""WITH {_LATEST} SELECT entity_id, entity_id * 2 AS image_id, 'artwork' AS image_kind, 1 AS place FROM l WHERE image_url IS NOT NULL
UNION ALL SELECT entity_id, entity_id * 2 + 1, 'sprite', CASE WHEN image_url IS NULL THEN 1 ELSE 2 END FROM l WHERE sprite_url IS NOT NULL""",
    "embedding_states": f"WITH {_STATES} SELECT * FROM n WHERE document_id IS NOT NULL",
    "source_states": f"WITH {_SOURCES} SELECT * FROM q",
    "entity_states": f"WITH {_LATEST}, {_SOURCES} SELECT l.entity_id, CASE WHEN count(q.status) = 0 THEN 'unindexed' WHEN bool_or(q.status = 'failed') THEN 'failed' WHEN bool_and(q.status = 'ready') THEN 'ready' ELSE 'stale' END AS status FROM l LEFT JOIN q USING (entity_id) GROUP BY 1",
    "chunk_sync": """WITH c AS (SELECT * FROM pokemon_knowledge_chunks WHERE document_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY chunk_no DESC) = 1), t AS (SELECT DISTINCT document_id FROM c WHERE chunk_no % 3 <> 0)
SELECT id, document_id, CASE WHEN k THEN true WHEN r THEN false ELSE is_current END AS is_current, CASE WHEN k THEN 'ready' WHEN r THEN 'stale' ELSE status END AS status, CASE WHEN k THEN 'refresh' WHEN r THEN 'retire' ELSE 'untouched' END AS action
FROM (SELECT *, chunk_no % 3 <> 0 AND chunk_no % 5 <> 0 AS k, is_current AND document_id IN (SELECT document_id FROM t) AS r FROM c) UNION ALL SELECT id || 'n', document_id, true, 'ready', 'insert' FROM c WHERE chunk_no % 3 <> 0 AND chunk_no % 5 = 0""",
    "visible_chunks": f"""WITH {_LATEST}, {_CHUNKS} SELECT d.pokemon_id AS entity_id, count(*) AS chunks, count(DISTINCT d.id) AS documents FROM c JOIN pokemon_knowledge_documents d ON d.id = c.document_id JOIN l ON l.entity_id = d.pokemon_id
WHERE c.is_current AND c.status = 'ready' AND c.chunk_no % 4 <> 0 AND d.is_current AND d.status = 'ready' AND l.entity_id % 5 <> 0 GROUP BY 1""",
    "activated_versions": """WITH d AS (SELECT id, pokemon_id, source_key, version, is_current, content_hash FROM pokemon_knowledge_documents), w AS (SELECT pokemon_id, source_key, arg_max(content_hash, version) AS h FROM d GROUP BY 1, 2),
s AS (SELECT d.* FROM d JOIN w ON w.pokemon_id = d.pokemon_id AND w.source_key = d.source_key AND w.h = d.content_hash WHERE NOT is_current QUALIFY row_number() OVER (PARTITION BY d.pokemon_id, d.source_key ORDER BY version DESC) = 1),
t AS (SELECT * FROM s WHERE version % 2 = 1 OR id IN (SELECT document_id FROM pokemon_knowledge_chunks))
SELECT d.id, CASE WHEN t.id IS NULL THEN d.is_current ELSE d.id = t.id END AS is_current FROM d LEFT JOIN t ON t.pokemon_id = d.pokemon_id AND t.source_key = d.source_key""",
    "switched_models": "SELECT code AS id, code = 'water' AS is_active FROM type_definitions",
    "annotation_report": f"""WITH sl AS ({table_sql.SQL['annotation_quality']}), ka AS ({table_sql.SQL['weighted_kappa']}),
lo AS (SELECT CASE slice WHEN 'overall' THEN 'overall' ELSE 'slice:' || slice END AS section, value AS name, unnest(['case_count', 'candidate_count', 'double_annotation_coverage', 'conflict_rate', 'adjudication_coverage']) AS metric, unnest([case_count::DOUBLE, candidate_count::DOUBLE, double_annotation_coverage::DOUBLE, conflict_rate::DOUBLE, adjudication_coverage::DOUBLE]) AS v FROM sl)
SELECT section, name, metric, v AS value FROM lo
UNION ALL SELECT 'pair', annotator_a || '|' || annotator_b, unnest(['common_judgment_count', 'quadratic_weighted_kappa']), unnest([common_judgment_count::DOUBLE, quadratic_weighted_kappa::DOUBLE]) FROM ka
UNION ALL SELECT 'overall', 'all', 'annotator_count', count(DISTINCT annotator) FROM annotation_quality_row WHERE grade IS NOT NULL
UNION ALL SELECT 'overall', 'all', 'pair_count', count(*) FROM ka UNION ALL SELECT 'overall', 'all', 'mean_quadratic_weighted_kappa', round(avg(quadratic_weighted_kappa), 6) FROM ka""",
    "repeated_payloads": f"""WITH v AS ({table_sql.SQL['nested_values']})
SELECT source_row, 'types' AS problem FROM v WHERE source_row % 5 = 0 AND types <> '' UNION ALL SELECT source_row, 'descriptions' FROM v WHERE source_row % 7 = 0 AND descriptions > 0
UNION ALL SELECT source_row, 'primary_description' FROM pokedex_final WHERE source_row % 7 = 0 AND {_told('description_zh')} IS NOT NULL
UNION ALL SELECT source_row, 'image_kinds' FROM v WHERE source_row % 11 = 0 AND images > 0 UNION ALL SELECT source_row, 'primary_image' FROM pokedex_final WHERE source_row % 11 = 0 AND regexp_full_match(image_url, 'https?://[^/?#\\s@]+(/[^?#\\s]*)?')""",
    "stable_retrieval": f"WITH h AS ({retrieval_queries.SQL['hybrid_entities']}) SELECT DISTINCT query_id, true AS same_items, true AS same_scores FROM h",
    "checked_terms": rf"""SELECT item_id AS id, CASE WHEN trim(query) = '' OR query IS NULL THEN 'blank' WHEN regexp_matches(query, '[\p{{Cc}}\p{{Cf}}]') THEN 'control' WHEN length(regexp_replace(query, '^{_WS}+|{_WS}+$', '', 'g')) > 40 THEN 'length' ELSE 'fine' END AS verdict, 'term' AS what FROM evaluation_cases
UNION ALL SELECT source_row, CASE WHEN regexp_full_match(image_url, 'https://[^/?#\s@:]+(:[0-9]{{1,5}})?(/[^\s]*)?') THEN 'secure' ELSE 'not secure' END, 'image' FROM pokedex_final""",
    "csv_round_trip": "SELECT code, name_en, name_zh, (row_number() OVER (ORDER BY code) + 1)::INTEGER AS source_row FROM type_definitions",
    "published_catalogue": "SELECT id FROM pokemon_knowledge_documents WHERE is_current AND lower(trim(language_code)) = 'zh-hant' AND lower(trim(document_kind)) = 'description' AND pokemon_id BETWEEN 5 AND 50",
    "cited_explanations": """WITH e AS (SELECT request_id, min(evidence_id) AS a, max(evidence_id) AS z FROM evidence_response WHERE request_id IS NOT NULL GROUP BY 1)
SELECT request_id, 'missing' AS problem FROM e WHERE request_id % 5 = 0 UNION ALL SELECT request_id, 'duplicate_citation' FROM e WHERE request_id % 5 <> 0 AND (request_id % 2 = 0 OR a = z)
UNION ALL SELECT request_id, 'foreign_citation' FROM e WHERE request_id % 5 <> 0 AND request_id % 2 <> 0 AND a <> z UNION ALL SELECT request_id, unnest(['not_chinese', 'foreign_code']) FROM e WHERE request_id % 5 <> 0 AND request_id % 3 = 0""",
}
