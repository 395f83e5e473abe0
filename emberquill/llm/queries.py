"""The pN_ queries on the driver's tables, each with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberquill.llm import consensus, encode, leaks, lookalikes, near_dup, pieces, top_n, truncation
from emberquill.llm.sql import SQL
from emberquill.session import table

__all__ = ["QUERIES", "SQL"]

ALIKE_FIELDS = ("content", "flavor_text_en", "description_zh")


def _alike(spark: SparkSession, d: str):
    chunks, dex = table(spark, d, "pokemon_knowledge_chunks"), table(spark, d, "pokedex_final")
    rows = chunks.select(F.lit(0).alias("part"), F.col("chunk_no").alias("id"), F.col("content").alias("text"))
    for k, field in enumerate(ALIKE_FIELDS[1:], 1):
        rows = rows.unionByName(dex.select(F.lit(k).alias("part"), F.col("source_row").alias("id"), F.col(field).alias("text")))
    return near_dup.near_duplicates(rows, threshold=0.7, size=4, unit="char")


def _field():
    return F.element_at(F.array(*map(F.lit, ALIKE_FIELDS)), (F.col("part") + 1).cast("int")).alias("field")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.alike_pairs(*_alike(spark, d)).select(_field(), "row_a", "row_b")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.groups(*_alike(spark, d)).select(_field(), F.col("id").alias("row_id"), "class_id", "class_size", "links")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.audit(table(spark, d, "pokemon_knowledge_documents"), table(spark, d, "pokemon_knowledge_chunks"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "pokemon_knowledge_documents").select(F.col("id").alias("document_id"), "content")
    return pieces.split(documents, key="document_id").where("boundary <> 'end' OR chunk_index > 0")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    result = table(spark, d, "recommendation_result").select(
        F.lit("result").alias("kind"), F.col("request_id").alias("group_id"), F.col("pokemon_id").cast("string").alias("item"), F.col("total").alias("score"), F.col("pokemon_id").alias("tie")
    )
    evidence = table(spark, d, "evidence_response").select(
        F.lit("evidence").alias("kind"), F.col("pokemon_id").alias("group_id"), F.col("evidence_id").alias("item"), F.col("rrf_score").alias("score"), F.least("dense_rank", "lexical_rank").cast("long").alias("tie")
    )
    return result.unionByName(evidence)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n.best_per_group(_ranked(spark, d), ["kind", "group_id"], 3).drop("score")


def _written(spark: SparkSession, d: str) -> DataFrame:
    dex, requests = table(spark, d, "pokedex_final"), table(spark, d, "recommendation_request")
    parts = [dex.select(F.lit(f).alias("field"), F.col("source_row").alias("row_id"), F.col(f).alias("text")) for f in ("type_zh", "name_zh")]
    parts.append(requests.select(F.lit("text").alias("field"), F.col("request_id").alias("row_id"), "text"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.consistent(_written(spark, d), ["field", "row_id"]).where(F.size("kinds") > 0).select("field", "row_id")


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.consistent(_written(spark, d), ["field", "row_id"]).select("field", "row_id", "form", "kinds")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "annotation_quality_row"))[0].select("case_id", "pokemon_id", "grade")


def p7_annotators(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "annotation_quality_row"))[1]


def p7_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.agreement(table(spark, d, "annotation_quality_row"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"), key="doc_id")


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The length of what every document's ids decode to, and its hash."""
    back = encode.decode(encode.encode(table(spark, d, "documents"), key="doc_id"), key="doc_id")
    return back.select("doc_id", F.length("text").alias("chars"), F.md5("text").alias("md5"))


def p8_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Whether every document's token offsets are in order, and the place of the last character they cover."""
    spans = encode.encode(table(spark, d, "documents"), key="doc_id", offsets=True)
    in_order = F.coalesce(F.col("starts") == F.array_sort("starts"), F.lit(True)) & F.coalesce(F.col("ends") == F.array_sort("ends"), F.lit(True))
    return spans.select("doc_id", in_order.alias("in_order"), F.coalesce(F.array_max("ends"), F.lit(0)).alias("last"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "evaluation_cases"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(_leaks(spark, d), table(spark, d, "evaluation_cases"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents"), group=["source"])


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("cut").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(_judged(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p2_found, p2_groups, p4_found, p4_pieces, p5_found, p6_found, p6_forms, p7_found, p7_annotators, p7_agreement, p8_ids, p8_round_trip, p8_offsets, p9_found, p9_items, p10_found, p10_rates)
}
