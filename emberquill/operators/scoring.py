"""Affinities, keyword coverage, score blending, final order, reranking and daily choice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.window import Window

from emberquill.functions import text as T
from emberquill.functions import vectors as V
from emberquill.session import in_blocks

#: Prototypes and vocabulary entries that may be sent to the workers.
FEW = 20_000
#: A small vocabulary for queries without one: trait index, trait, term, weight.
DEMO_TERMS = [
    (0, "quiet", "quiet", 2.0), (0, "quiet", "gentle", 1.5), (0, "quiet", "安靜", 2.0), (0, "quiet", "沉默", 1.0),
    (1, "bold", "proud", 2.0), (1, "bold", "bright", 1.0), (1, "bold", "明亮", 2.0),
    (2, "loyal", "guard", 2.0), (2, "loyal", "keeps", 1.0), (2, "loyal", "守護", 2.0), (2, "loyal", "companion", 1.5),
    (3, "curious", "curious", 2.0), (3, "curious", "studies", 1.0), (3, "curious", "研究", 2.0),
]


def demo_vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEMO_TERMS, "trait_index int, trait string, term string, weight double")


def affinities(vectors: DataFrame, prototypes: DataFrame, name: str, coverage: DataFrame | None = None) -> DataFrame:
    """id, the prototype's name and the affinity of every vector and prototype.

    Without ``coverage`` the clipped cosine; with it (id, name, coverage) 0.8 of that and 0.2 of
    the coverage, clipped.  Prototypes are few, by count; zero vectors have affinity 0.
    """
    rows = sorted(prototypes.limit(FEW + 1).collect(), key=lambda r: r[name])
    if len(rows) > FEW:
        raise ValueError(f"more than {FEW} prototypes")
    names, matrix = [r[name] for r in rows], np.array([r["prototype"] for r in rows], float)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = matrix / np.where(norms > 0, norms, 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array(batch.column("vector").to_pylist(), float).reshape(batch.num_rows, -1)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            cos = np.clip((v / np.where(n > 0, n, 1)) @ matrix.T, 0, 1) if batch.num_rows and names else np.empty((batch.num_rows, 0))
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(batch.num_rows), len(names))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(names) * batch.num_rows, batch_type), pa.array(cos.ravel())], ["id", name, "affinity"])

    kind = prototypes.schema[name].dataType.simpleString()
    batch_type = {"int": pa.int32(), "bigint": pa.int64()}.get(kind, pa.string())
    ids = vectors.schema["id"].dataType.simpleString()
    out = vectors.where(F.col("vector").isNotNull()).select("id", "vector").mapInArrow(score, f"id {ids}, `{name}` {kind}, affinity double")
    if coverage is None:
        return out
    joined = out.join(coverage.select("id", name, "coverage"), ["id", name], "left")
    return joined.select("id", name, V.clipped(0.8 * F.col("affinity") + 0.2 * F.coalesce("coverage", F.lit(0.0))).alias("affinity"))


def best_terms(vocabulary: DataFrame) -> DataFrame:
    """One row a trait and canonical term: its greatest weight, the first display form on a tie."""
    form = vocabulary.withColumn("canonical", T.canonical("term"))
    w = Window.partitionBy("trait", "canonical").orderBy(F.desc("weight"), "term")
    return form.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def find_terms(rows: DataFrame, terms: list[str], *, affirmed: bool = False) -> DataFrame:
    """id and each of the terms that occurs in ``low`` (once a row); with ``affirmed`` only if one occurrence isn't negated.

    One automaton finds all terms in one pass over a text, however many there are.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for t in terms:
            machine.add_word(t, t)
        machine.make_automaton()
        for batch in batches:
            at, held = [], []
            for i, text in enumerate(batch.column("low").to_pylist()):
                own = dict.fromkeys(t for _, t in machine.iter(text)) if terms else ()
                own = [t for t in own if not affirmed or T.affirms(text, t)]
                at += [i] * len(own)
                held += own
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), pa.array(held, pa.string())], ["id", "form"])

    return rows.where(F.col("low").isNotNull()).select("id", "low").mapInArrow(find, f"id {rows.schema['id'].dataType.simpleString()}, form string")


def _occurring(rows: DataFrame, vocabulary: DataFrame, form: str, affirmed: bool) -> DataFrame:
    """id and the vocabulary's rows whose ``form`` occurs; the vocabulary goes to the workers in blocks of a checked size."""
    forms = vocabulary.select(form).where(F.coalesce(form, F.lit("")) != "").distinct()
    found = None
    for block in in_blocks(forms, form, FEW):
        one = find_terms(rows, sorted(r[0] for r in block), affirmed=affirmed)
        found = one if found is None else found.unionByName(one)
    return found.join(vocabulary, F.col("form") == F.col(form))


def _coverage(found: DataFrame, vocabulary: DataFrame) -> DataFrame:
    total = vocabulary.groupBy("trait").agg(F.sum("weight").alias("total"))
    return found.groupBy("id", "trait").agg(F.sum("weight").alias("w")).join(total, "trait").select("id", "trait", F.round(F.col("w") / F.col("total"), 8).alias("coverage"))


def substring_coverage(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """id, trait and the share of the trait's weight whose terms occur in the text, for traits that occur."""
    return _coverage(_occurring(rows.withColumn("low", F.lower("text")), vocabulary, "term", False), vocabulary)


def trait_vectors(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """id and the weights of its trait indices, dense from 0, at length one; all zero if nothing occurs.  Null texts have no row."""
    size = (vocabulary.agg(F.max("trait_index")).first()[0] or 0) + 1
    rows = rows.where(F.col("text").isNotNull()).withColumn("low", F.lower("text"))
    found = _occurring(rows, vocabulary, "term", False).select("id", "trait_index", "weight")
    padded = found.unionByName(rows.select("id", F.lit(0).alias("trait_index"), F.lit(0.0).alias("weight")))
    sums = [F.sum(F.when(F.col("trait_index") == i, F.col("weight")).otherwise(0.0)).alias(f"t{i}") for i in range(size)]
    grouped = padded.groupBy("id").agg(*sums)
    return grouped.select("id", F.transform(V.normalised(F.array(*(F.col(f"t{i}") for i in range(size)))), lambda x: F.round(x, 8)).alias("vector"))


def affirmed_rows(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """id and the rows of ``terms`` (with ``canonical``) that the text affirms, once a text row."""
    return _occurring(rows.select("id", T.behaviour("text").alias("low")), terms, "canonical", True)


def affirmed_coverage(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """id, trait, coverage: like ``substring_coverage``, counting only terms the text affirms, once a canonical form."""
    terms = best_terms(vocabulary)
    return _coverage(_occurring(rows.select("id", T.behaviour("text").alias("low")), terms, "canonical", True), terms)


def matched_terms(rows: DataFrame, vocabulary: DataFrame, most: int = 3) -> DataFrame:
    """id, place and term of the weightiest affirmed terms; type codes never count, ties go by canonical form."""
    terms = best_terms(vocabulary).where(T.four_letter_code("canonical").isNull())
    found = _occurring(rows.select("id", T.behaviour("text").alias("low")), terms, "canonical", True)
    best = found.groupBy("id", "canonical").agg(F.max(F.struct("weight", "term")).alias("b")).select("id", "canonical", "b.weight", "b.term")
    w = Window.partitionBy("id").orderBy(F.desc("weight"), "canonical")
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("id", "place", "term", "weight")


def components(semantic: Column, asked: Column, own: Column, place: Column) -> Column:
    """semantic, personality, typed and total of a query and an entity, from the two affinity arrays.

    ``personality`` is the clipped cosine of ``asked`` and ``own`` and counts for a quarter of the text
    match whenever neither is all zero, orthogonal ones included.  ``place`` is the chosen type's place
    in ``own`` from 0, or null; its affinity is then a quarter of the total.  All are rounded to 8 digits.
    """
    semantic, personality = V.clipped(semantic.cast("double")), V.cosine(asked, own)
    typed = F.when(place.isNotNull(), V.clipped(F.get(own, place).cast("double")))
    total = blend(semantic, F.when((V.norm(asked) > 0) & (V.norm(own) > 0), personality), typed)
    return F.struct(F.round(semantic, 8).alias("semantic"), F.round(personality, 8).alias("personality"), F.round(typed, 8).alias("typed"), total.alias("total"))


def blend(semantic: Column, personality: Column, typed: Column) -> Column:
    """The total: text match (three quarters semantic, one quarter personality unless that is null: a side without affinities), three quarters of it and one quarter the type's share if that isn't null; clipped, 8 digits."""
    text = F.when(personality.isNull(), semantic).otherwise(0.75 * semantic + 0.25 * personality)
    return F.round(V.clipped(F.when(typed.isNull(), text).otherwise(0.75 * text + 0.25 * typed)), 8)


def final_order(rows: DataFrame, group: str, order: list[Column], k: int, *, whole: bool = False) -> DataFrame:
    """The first ``k`` rows of every group in a total order, with ``rank`` from 1; with ``whole`` a group of fewer than ``k`` fails the query."""
    w = Window.partitionBy(group).orderBy(*order)
    ranked = rows.withColumn("rank", F.row_number().over(w))
    if not whole:
        return ranked.where(F.col("rank") <= k)
    counted = ranked.withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    short = F.raise_error(F.concat(F.lit(f"fewer than {k} candidates for "), F.col(group).cast("string"))).cast("int")
    return counted.withColumn("rank", F.when(F.col("_n") < k, short).otherwise(F.col("rank"))).where(F.col("rank") <= k).drop("_n")


def predicted(rows: DataFrame, query: str, text: str, predictor: Callable[[list[tuple[str, str]]], list[float]], *, batch: int = 64) -> DataFrame:
    """Rows with ``raw``: the predictor's score of each (query, text), ``batch`` pairs at a time.

    A batch that fails, or whose scores are of a wrong number or not finite, gets null: ``rerank`` then
    falls back to the base order for the groups concerned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            pairs = list(zip((q or "" for q in whole.column(query).to_pylist()), (t or "" for t in whole.column(text).to_pylist())))
            raw: list[float | None] = []
            for at in range(0, len(pairs), batch):
                own = pairs[at : at + batch]
                try:
                    scores = np.asarray(predictor(own), float).reshape(-1)
                    good = scores.shape == (len(own),) and bool(np.isfinite(scores).all())
                except Exception:  # the batch has no scores, the others go on
                    good = False
                raw += scores.tolist() if good else [None] * len(own)
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(raw, pa.float64())], [*whole.schema.names, "raw"])

    return rows.mapInArrow(run, T_.StructType([*rows.schema.fields, T_.StructField("raw", T_.DoubleType())]))


def rerank(rows: DataFrame, group: str, position: str, base: str, raw: str, *, weight: float, limit: int) -> DataFrame:
    """The first ``limit`` rows of every group by (1-w) base + w logistic(raw), ties by base, then position.

    Groups of under three, and groups with a null raw score within the limit, keep their totals and
    have no reranker score; rows past the limit keep their places behind.
    """
    size = F.count("*").over(Window.partitionBy(group))
    score = V.sigmoid(F.col(raw).cast("double"))
    inside = F.col(position) <= limit
    failed = F.max((inside & F.col(raw).isNull()).cast("int")).over(Window.partitionBy(group))
    enough = (F.least(F.col("_n"), F.lit(limit)) >= 3) & (F.col("_failed") == 0)
    out = rows.withColumn("_n", size).withColumn("_failed", failed).withColumn("_base", F.col(base))
    out = out.withColumn("pre_rerank_total", F.round("_base", 8)).withColumn("reranker", F.when(inside & enough, F.round(score, 8)))
    out = out.withColumn("total", F.when(inside & enough, F.round((1 - weight) * F.col("_base") + weight * score, 8)).otherwise(F.round("_base", 8)))
    w = Window.partitionBy(group).orderBy((~inside).cast("int"), F.desc("total"), F.desc("_base"), position)
    return out.withColumn("_rank", F.row_number().over(w)).drop("_n", "_failed", "_base", position).withColumnRenamed("_rank", "rank")


def daily_choice(rows: DataFrame, group: str, item: str, total: str, position: str, salt: tuple[str, ...]) -> DataFrame:
    """One row a group: 0.9 of the total on the group's range plus 0.1 of a daily hash; the place counts if the range is nil."""
    w = Window.partitionBy(group)
    low, high, n = F.min(total).over(w), F.max(total).over(w), F.count("*").over(w)
    placed = F.when(high - low > 1e-12, (F.col(total) - low) / (high - low)).otherwise(1 - (F.col(position) - 1).cast("double") / F.greatest(F.lit(1), n - 1))
    score = F.round(0.9 * placed + 0.1 * T.unit_hash(*map(F.lit, salt), F.col(item).cast("string")), 10)
    scored = rows.select(group, item, total, F.col(position).alias("source_rank"), score.alias("selection_score"))
    order = Window.partitionBy(group).orderBy(F.desc("selection_score"), F.desc(total), item)
    return scored.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def evidence_text(parts, longest: int = 1500) -> Column:
    """The non-blank texts of an array, stripped, joined by line breaks, at most ``longest`` characters."""
    kept = F.filter(F.transform(parts, lambda p: T.stripped(p)), lambda p: p != "")
    return F.substring(F.array_join(kept, "\n"), 1, longest)
