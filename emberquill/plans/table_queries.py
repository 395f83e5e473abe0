"""Evaluation, feedback, catalogue, text and versioning queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberquill.functions import text as T
from emberquill.operators import aggregate as A
from emberquill.operators import catalog as C
from emberquill.operators import embedding as N
from emberquill.operators import evaluation as E
from emberquill.operators import feedback as B
from emberquill.operators import merge as M
from emberquill.operators import retrieval as R
from emberquill.plans.retrieval_queries import final_ranking
from emberquill.session import table

NOW = "2025-12-31 00:00:00"


# evaluation --------------------------------------------------------------------------------------


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    """Cases are the vectors divisible by 100; a vector of the same label is relevant, its grade 1 + number mod 3."""
    e = table(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = v.where(F.col("chunk_id") % 100 == 0).select(F.col("chunk_id").alias("query_id"), "vector")
    ranked = R.dense_topk(v, asked, 10).select(F.col("query_id").alias("case_id"), F.col("chunk_id").alias("item"), F.col("dense_rank").alias("rank"))
    cases = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("case_id"), "label")
    judged = e.select("label", F.col("vec_id").alias("item"), (1 + F.col("vec_id") % 3).alias("grade")).join(cases, "label").select("case_id", "item", "grade")
    return E.case_metrics(ranked, judged, k=10)


def eval_cases(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d).select("case_id", *(F.round(m, 6).alias(m) for m in E.METRICS))


def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return E.report(_evaluated(spark, d))


def annotation_quality(spark: SparkSession, d: str) -> DataFrame:
    return E.slices(table(spark, d, "annotation_quality_row"))


def weighted_kappa(spark: SparkSession, d: str) -> DataFrame:
    return E.pair_kappas(table(spark, d, "annotation_quality_row"))


def ready_cases(spark: SparkSession, d: str) -> DataFrame:
    return E.ready_cases(table(spark, d, "annotation_quality_row"))


def exported_cases(spark: SparkSession, d: str) -> DataFrame:
    return E.exported_cases(table(spark, d, "evaluation_cases"), table(spark, d, "annotation_quality_row"))


def quality_rows(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "annotation_quality_row")
    candidates = a.select("case_id", "pokemon_id").distinct()
    grades = a.where(F.col("grade").between(0, 3) & F.col("annotator").isNotNull()).select("case_id", "pokemon_id", "annotator", "grade")
    finals = a.groupBy("case_id", "pokemon_id").agg(F.max("final_grade").alias("final_grade"))
    return E.quality_rows(table(spark, d, "evaluation_cases"), candidates, grades, finals)


def percentile_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.summary(table(spark, d, "events"), "value", ["event_type"])


def rerank_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether cases over even numbers beat those over all by 0.001 nDCG within 250 ms; latency stands in as number mod 300."""
    cases = _evaluated(spark, d).withColumn("latency_ms", (F.col("case_id") % 300).cast("double"))
    return E.accepts(cases, cases.where(F.col("case_id") % 200 == 0), least_gain=0.001, most_added_ms=250.0)


# feedback ----------------------------------------------------------------------------------------


def _feedback(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests as impressions, their three best candidates as items, feedback by rule on a part of them."""
    impressions = table(spark, d, "recommendation_request").select(F.col("request_id").alias("impression_id"), F.concat(F.lit("v"), (F.col("request_id") % 3).cast("string")).alias("algorithm_version"), "created_at")
    items = final_ranking(spark, d).where("rank <= 3").select(F.col("request_id").alias("impression_id"), F.col("pokemon_id").alias("item_id"), "rank")
    given = items.where((F.col("impression_id") + F.col("item_id")) % 4 == 0).select(
        "impression_id", "item_id", (F.col("rank") + F.when(F.col("item_id") % 10 == 0, 1).otherwise(0)).alias("rank"), F.when(F.col("item_id") % 3 == 0, "not_match").otherwise("match").alias("verdict"),
        F.when(F.col("item_id") % 3 != 0, "no_reason").when(F.col("item_id") % 2 == 0, "wrong_type").otherwise("wrong_mood").alias("reason"),
    )
    return impressions, items, given


def feedback_summary(spark: SparkSession, d: str) -> DataFrame:
    impressions, _, given = _feedback(spark, d)
    return B.summary(given, impressions)


def feedback_by(spark: SparkSession, d: str) -> DataFrame:
    impressions, items, given = _feedback(spark, d)
    return B.by(given, items, impressions)


def feedback_checked(spark: SparkSession, d: str) -> DataFrame:
    _, items, given = _feedback(spark, d)
    return B.checked(given, items).select("impression_id", "item_id", "rank", "problem")


def retention_purge(spark: SparkSession, d: str) -> DataFrame:
    impressions, items, given = _feedback(spark, d)
    kept = B.retained(impressions, [items, given], 180, NOW)
    return kept[0].agg(F.count("*").alias("n")).select(F.lit("impressions").alias("kept"), "n").unionByName(kept[1].agg(F.count("*").alias("n")).select(F.lit("items").alias("kept"), "n")).unionByName(kept[2].agg(F.count("*").alias("n")).select(F.lit("feedback").alias("kept"), "n"))


# catalogue ---------------------------------------------------------------------------------------


SHOWN = ["name_zh", "name_en", "type_1", "type_2", "generation", "is_legendary", "habitat", "abilities", "hidden_ability", "egg_groups", "hp", "attack", "defense", "sp_attack", "sp_defense", "speed"]


def _entities(spark: SparkSession, d: str) -> DataFrame:
    """The latest delivery of every catalogue number, typed; the long texts aren't read."""
    rows = table(spark, d, "pokedex_final").select(F.col("pokedex_number").try_cast("bigint").alias("entity_id"), "source_row", "loaded_at", *SHOWN)
    rows = C.latest(rows.where(F.col("entity_id").isNotNull()), ["entity_id"], ["loaded_at", "source_row"])
    return rows.withColumn("generation_no", T.generation_number("generation")).withColumn("legendary", T.truth("is_legendary"))


def _bridge(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark, d)
    slots = e.select("entity_id", F.posexplode(F.array(T.optional("type_1"), T.optional("type_2"))).alias("slot", "name")).where(F.col("name").isNotNull())
    return slots.select("entity_id", (F.col("slot") + 1).alias("slot"), F.lower("name").alias("code"))


def catalog_page(spark: SparkSession, d: str) -> DataFrame:
    found = C.search(_entities(spark, d), names=["name_zh", "name_en"], text="or", equal={"legendary": False})
    return C.page(found, [F.asc("entity_id")], 2, 20).select("entity_id", "name_zh", "name_en", "generation_no")


def catalog_total(spark: SparkSession, d: str) -> DataFrame:
    return C.page_totals(C.search(_entities(spark, d), names=["name_zh", "name_en"], text="or", equal={"legendary": False}), 20)


def catalog_escaped_search(spark: SparkSession, d: str) -> DataFrame:
    """A pattern whose wildcards are meant literally: values with an underscore in their abilities."""
    return C.search(_entities(spark, d), names=["abilities", "egg_groups"], text="_gleam").select("entity_id", "abilities")


def catalog_type_exists(spark: SparkSession, d: str) -> DataFrame:
    return C.having_type(_entities(spark, d), _bridge(spark, d), table(spark, d, "type_definitions"), "WATER").select("entity_id", "name_en")


def entity_detail(spark: SparkSession, d: str) -> DataFrame:
    """Entities with their types by slot, evidence and document children counted, stats checked."""
    e = _entities(spark, d)
    types = C.pivoted(_bridge(spark, d), "entity_id", "slot", "code", [1, 2]).select("entity_id", F.col("1").alias("type_a"), F.col("2").alias("type_b"))
    docs = table(spark, d, "pokemon_knowledge_documents").where("is_current").groupBy(F.col("pokemon_id").alias("entity_id")).agg(F.count("*").alias("documents"), F.array_join(F.sort_array(F.collect_set("source_key")), ",").alias("sources"))
    stats = [T.whole_number(c).alias(c) for c in ("hp", "attack", "defense", "sp_attack", "sp_defense", "speed")]
    base = e.select("entity_id", "name_zh", T.optional("habitat").alias("habitat"), *stats)
    out = base.join(types, "entity_id", "left").join(docs, "entity_id", "left")
    return out.select("entity_id", "name_zh", F.coalesce("habitat", F.lit("Unknown")).alias("habitat"), (F.col("hp") + F.col("attack") + F.col("defense") + F.col("sp_attack") + F.col("sp_defense") + F.col("speed")).alias("total"), "type_a", "type_b", F.coalesce("documents", F.lit(0)).alias("documents"), "sources")


def type_children(spark: SparkSession, d: str) -> DataFrame:
    """Each entity's types as an ordered list of code and name."""
    named = _bridge(spark, d).join(table(spark, d, "type_definitions"), "code")
    lists = C.children(named, "entity_id", ["slot"], ["code", "name_zh"], "types")
    return lists.select("entity_id", F.array_join(F.transform("types", lambda t: F.concat_ws(":", t["slot"].cast("string"), t["code"], t["name_zh"])), "|").alias("types"))


def ability_terms(spark: SparkSession, d: str) -> DataFrame:
    return C.hidden_abilities(_entities(spark, d), ["entity_id"], "abilities", "hidden_ability")


def localised_types(spark: SparkSession, d: str) -> DataFrame:
    rows = _entities(spark, d).select("entity_id", F.concat_ws(",", "type_1", "type_2").alias("codes"))
    return C.localised(rows, ["entity_id"], "codes", table(spark, d, "type_definitions").select("code", "name_zh"))


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return C.hash_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 50)


def even_sample(spark: SparkSession, d: str) -> DataFrame:
    return C.even_sample(table(spark, d, "documents").select("doc_id"), ["doc_id"], 11)


def entities_with_evidence(spark: SparkSession, d: str) -> DataFrame:
    """One row: entities that have evidence under the guard of a current, ready document."""
    docs = table(spark, d, "pokemon_knowledge_documents").where(F.col("is_current") & (F.col("status") == "ready")).select(F.col("id").alias("document_id"))
    return table(spark, d, "evidence_response").join(docs, "document_id", "left_semi").agg(F.count_distinct("pokemon_id").alias("entities"), F.count_distinct("evidence_id").alias("evidence"))


# text --------------------------------------------------------------------------------------------


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pokemon_knowledge_documents").select("id", T.content_hash("content").alias("computed"), (T.content_hash("content") == F.col("content_hash")).alias("as_stored"))


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pokemon_knowledge_documents").select("id", T.stable_id(F.lit("document"), F.col("pokemon_id").cast("string"), F.col("source_key"), F.col("version").cast("string")).alias("stable_id"))


def fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.fixed_windows("text")).alias("place", "window_text"))


def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"))


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """Sentences packed into overlapping windows, with hashes and stable identifiers."""
    rows = table(spark, d, "pokemon_knowledge_documents").select("id", F.posexplode(T.packed_windows(T.sentences(F.col("content")))).alias("chunk_index", "content"))
    return rows.select("id", "chunk_index", F.length("content").alias("char_count"), T.content_hash("content").alias("content_hash"), T.stable_id(F.lit("chunk"), F.col("id"), F.col("chunk_index").cast("string"), T.content_hash("content")).alias("chunk_id"))


def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "recommendation_request").select("request_id", T.canonical("mbti").alias("mbti"), T.four_letter_code("mbti").alias("code"))


def query_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evaluation_cases").select("item_id", F.posexplode(T.query_tokens(F.col("query"))).alias("place", "token"))


def display_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pokedex_final").select("source_row", F.posexplode(T.paragraphs("description_zh")).alias("place", "paragraph"))


def chinese_summaries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pokedex_final").select("source_row", T.chinese_summary(F.col("description_zh")).alias("summary"), T.chinese_prose("description_zh").alias("chinese"))


def typed_fields(spark: SparkSession, d: str) -> DataFrame:
    """Strictly typed catalogue fields; what doesn't parse is null."""
    return table(spark, d, "pokedex_final").select(
        "source_row", T.whole_number("base_stat_total").alias("total"), T.finite_number("height_m").alias("height"), T.truth("is_mythical").alias("mythical"), T.generation_number("generation").alias("generation"), T.optional("habitat").alias("habitat"),
        T.web_address("image_url").alias("web"), T.artwork_address(F.lit("https://art.example.invalid/"), F.col("pokedex_number").try_cast("int")).alias("artwork"), T.safe_filename(F.col("genus")).alias("file_stem"),
    )


def length_buckets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evaluation_cases").groupBy(T.length_bucket("query_length").alias("bucket")).agg(F.count("*").alias("n"))


# versions ----------------------------------------------------------------------------------------

FIELDS = ["name_zh", "name_en", "type_zh", "habitat", "capture_rate"]


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of odd source rows merged into those of even ones."""
    rows = table(spark, d, "pokedex_final").select("pokedex_number", "source_row", "loaded_at", *FIELDS)
    one = lambda parity: C.latest(rows.where(F.col("source_row") % 2 == parity), ["pokedex_number"], ["loaded_at", "source_row"])
    return M.upsert(one(0), one(1), ["pokedex_number"], FIELDS)


def child_sync(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "pokemon_knowledge_documents")
    return M.synchronise(docs.where("version = 1"), docs.where("is_current"), ["pokemon_id", "source_key"])


def scd2_versions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "pokemon_knowledge_documents").withColumn("content_hash", T.content_hash("content"))
    incoming = docs.where(F.col("version") == 1).groupBy("pokemon_id", "source_key").agg(F.max("content").alias("content"))
    return M.next_versions(docs, incoming, ["pokemon_id", "source_key"]).select("pokemon_id", "source_key", "content_hash", "version", "action")


def retired_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "pokemon_knowledge_documents")
    return M.retired(docs, docs.where("source_description_id IS NOT NULL"), ["pokemon_id", "source_key"], "source_key").select("id", "source_key")


def pending_work(spark: SparkSession, d: str) -> DataFrame:
    """Chunks against a deterministic set of vectors: a fifth missing, some failed, empty or of old content."""
    chunks = C.latest(table(spark, d, "pokemon_knowledge_chunks").select(F.col("id").alias("chunk_id"), "chunk_no", "content_hash"), ["chunk_id"], ["chunk_no"])
    embedded = chunks.where(F.col("chunk_no") % 5 != 0).select("chunk_id", F.when(F.col("chunk_no") % 7 == 0, "failed").otherwise("ready").alias("status"), (F.col("chunk_no") % 11 != 0).alias("has_vector"), F.when(F.col("chunk_no") % 13 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"))
    return M.pending(chunks, embedded)


def index_states(spark: SparkSession, d: str) -> DataFrame:
    chunks = C.latest(table(spark, d, "pokemon_knowledge_chunks").select("id", "document_id", "status", "chunk_no"), ["id"], ["chunk_no"])
    return M.index_states(table(spark, d, "pokemon_knowledge_documents"), chunks)


def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    li, chunks = table(spark, d, "lineitem"), table(spark, d, "pokemon_knowledge_chunks")
    rows = M.violations(chunks, "chunk_no", {"not_blank": F.trim("content") != "", "char_count": F.col("char_count") == F.length("content"), "status": F.col("status").isin("ready", "stale", "failed")})
    line = M.violations(li.withColumn("k", F.concat_ws(":", "l_orderkey", "l_linenumber")), "k", {"discount": F.col("l_discount").between(0, 0.1), "quantity": F.col("l_quantity").between(1, 49)})
    unique = M.duplicates(chunks, ["id"], "unique_id")
    missing = M.orphans(table(spark, d, "evidence_response"), "chunk_id", chunks, "id", "evidence_id", "evidence_chunk").distinct()
    return rows.unionByName(line).unionByName(unique).unionByName(missing)


# aggregates and vectors --------------------------------------------------------------------------


def nested_rows(spark: SparkSession, d: str) -> DataFrame:
    """Errors of the catalogue's rows as typed aggregates."""
    out = A.nested(table(spark, d, "pokedex_final"), table(spark, d, "type_definitions"))
    return out.select("source_row", F.explode("errors").alias("e")).select("source_row", "e.field", "e.message")


def nested_values(spark: SparkSession, d: str) -> DataFrame:
    out = A.nested(table(spark, d, "pokedex_final"), table(spark, d, "type_definitions"))
    return out.select("source_row", "entity.number", "entity.generation", "entity.height_m", "stats.base_stat_total", F.array_join("type_codes", ",").alias("types"), F.size("descriptions").alias("descriptions"), F.size("images").alias("images"))


def case_view(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "annotation_quality_row")
    finals = a.groupBy("case_id", "pokemon_id").agg(F.max("final_grade").alias("final_grade"))
    out = A.case_view(table(spark, d, "evaluation_cases"), E.latest_grades(a), finals)
    return out.select("case_id", "pokemon_id", F.array_join(F.transform("grades", lambda g: F.concat_ws("=", g["annotator"], g["grade"].cast("string"))), "|").alias("grades"), "final_grade")


def embedded_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents that aren't blank, embedded by the hashing encoder: counts by status."""
    texts = table(spark, d, "documents").where(F.col("text").isNull() | (T.stripped("text") != ""))
    rows = texts.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), T.content_hash("text").alias("content_hash"))
    return N.embed(rows).groupBy("status").agg(F.count("*").alias("n"))


def public_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return C.public_descriptions(table(spark, d, "pokemon_knowledge_documents")).select("id", "pokemon_id")


def evidence_order(spark: SparkSession, d: str) -> DataFrame:
    """The ten first rows of evidence, Chinese before others, then by score and number."""
    rows = table(spark, d, "evidence_response").where(F.col("rrf_score").isNotNull() & ~F.isnan("rrf_score")).select("evidence_id", "language_code", "rrf_score").distinct()
    return C.evidence_first(rows, 10)


QUERIES = {
    f.__name__: f
    for f in (
        nested_rows, nested_values, case_view, embedded_chunks, public_descriptions, evidence_order,
        eval_cases, eval_metrics, annotation_quality, weighted_kappa, ready_cases, exported_cases, quality_rows, percentile_summary, rerank_gate, feedback_summary, feedback_by, feedback_checked, retention_purge,
        catalog_page, catalog_total, catalog_escaped_search, catalog_type_exists, entity_detail, type_children, ability_terms, localised_types, hash_sample, even_sample, entities_with_evidence,
        content_hashes, stable_ids, fixed_windows, sentence_counts, chunk_documents, canonical_names, query_tokens, display_paragraphs, chinese_summaries, typed_fields, length_buckets,
        upsert_merge, child_sync, scd2_versions, retired_sources, pending_work, index_states, constraint_violations,
    )
}
