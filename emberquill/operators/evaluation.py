"""Ranking metrics, their report, agreement of annotators and slices of an annotated set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberquill.functions.text import length_bucket

METRICS = ("recall", "high_recall", "mrr", "ndcg", "hit_at_3", "precision_at_3", "weighted_precision_at_3", "mrr_at_3")


def _gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1


def case_metrics(ranked: DataFrame, judgments: DataFrame, *, k: int = 10) -> DataFrame:
    """One row a judged case with its metrics over its first ``k`` ranked items.

    ``ranked``: case_id, item, rank (from 1).  ``judgments``: case_id, item, grade (1 to 3; others
    don't count).  Cases without results score 0; results of cases without judgments are ignored.
    High recall counts grades from 2 and is 0 without any; the ideal of nDCG has as many places as
    the ranking has items.
    """
    if not 3 <= k <= 10:
        raise ValueError("k is from 3 to 10")
    judged = judgments.where(F.col("grade").between(1, 3)).groupBy("case_id", "item").agg(F.max("grade").alias("grade"))
    ranked = ranked.where(F.col("rank") <= k)
    sizes = ranked.groupBy("case_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("case_id").orderBy(F.desc("grade"), "item")
    ideal = judged.withColumn("place", F.row_number().over(order)).join(sizes, "case_id", "left")
    needs = ideal.groupBy("case_id").agg(
        F.count("*").alias("relevant"),
        F.sum((F.col("grade") >= 2).cast("int")).alias("high"),
        F.sum(F.when(F.col("place") <= F.col("n"), _gain(F.col("grade")) / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("ideal"),
    )
    hits = ranked.join(judged, ["case_id", "item"]).groupBy("case_id").agg(
        F.count("*").alias("hits"),
        F.sum((F.col("grade") >= 2).cast("int")).alias("high_hits"),
        F.min("rank").alias("first"),
        F.sum(_gain(F.col("grade")) / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.sum((F.col("rank") <= 3).cast("int")).alias("top"),
        F.sum(F.when(F.col("rank") <= 3, F.col("grade")).otherwise(0)).alias("top_grades"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    first = F.coalesce("first", F.lit(10**6))
    return needs.join(hits, "case_id", "left").select(
        "case_id",
        zero(F.col("hits") / F.col("relevant")).alias("recall"),
        zero(F.when(F.col("high") > 0, F.col("high_hits") / F.col("high"))).alias("high_recall"),
        zero(1.0 / F.col("first")).alias("mrr"),
        zero(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal"))).alias("ndcg"),
        F.when(first <= 3, 1.0).otherwise(0.0).alias("hit_at_3"),
        zero(F.col("top") / 3.0).alias("precision_at_3"),
        zero(F.col("top_grades") / 9.0).alias("weighted_precision_at_3"),
        F.when(first <= 3, 1.0 / first).otherwise(0.0).alias("mrr_at_3"),
    )


def report(cases: DataFrame, digits: int = 6) -> DataFrame:
    """One row: the number of cases, the mean of each metric and, if the cases have ``latency_ms``, its mean, median and 95th percentile (4 digits)."""
    late = [F.avg("latency_ms"), F.percentile("latency_ms", F.lit(0.5)), F.percentile("latency_ms", F.lit(0.95))] if "latency_ms" in cases.columns else []
    named = [F.round(c, 4).alias(n) for c, n in zip(late, ("latency_mean_ms", "latency_p50_ms", "latency_p95_ms"))]
    return cases.agg(F.count("*").alias("cases"), *(F.round(F.avg(m), digits).alias(m) for m in METRICS), *named)


def summary(rows: DataFrame, value: str, by: list[str], digits: int = 4) -> DataFrame:
    """count, mean, median, 95th percentile (linear) and maximum of a value by group."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg(value), digits).alias("mean"), F.round(F.percentile(value, F.lit(0.5)), digits).alias("p50"), F.round(F.percentile(value, F.lit(0.95)), digits).alias("p95"), F.round(F.max(value), digits).alias("max")
    )


def accepts(base: DataFrame, other: DataFrame, *, least_gain: float, most_added_ms: float) -> DataFrame:
    """One row: whether a second run's nDCG gains enough at an acceptable added 95th percentile."""
    runs = base.select(F.lit(0).alias("run"), "ndcg", "latency_ms").unionByName(other.select(F.lit(1).alias("run"), "ndcg", "latency_ms"))
    own = lambda c, r: F.when(F.col("run") == r, F.col(c))
    late = [F.percentile(own("latency_ms", r), F.lit(0.95)) for r in (0, 1)]
    one = runs.agg(F.round(F.avg(own("ndcg", 1)) - F.avg(own("ndcg", 0)), 6).alias("gain"), F.round(late[1] - late[0], 4).alias("added_p95_ms"))
    return one.withColumn("accepted", (F.col("gain") >= least_gain) & (F.col("added_p95_ms") <= most_added_ms))


def latest_grades(rows: DataFrame) -> DataFrame:
    """The latest grade of every item and annotator: case_id, pokemon_id, annotator, grade (0 to 3)."""
    rows = rows.where(F.col("annotator").isNotNull() & F.col("grade").between(0, 3))
    return rows.groupBy("case_id", "pokemon_id", "annotator").agg(F.max_by("grade", F.struct("created_at", "annotation_id")).alias("grade"))


def pair_kappas(rows: DataFrame) -> DataFrame:
    """annotator_a < annotator_b, their common items and their quadratic weighted kappa (6 digits).

    An item holds at most one grade an annotator, so the pairs of an item are bounded by the
    annotators, not by the rows.  If no disagreement is expected, kappa is 1 without any, else 0.
    """
    grades = latest_grades(rows)
    a = grades.select("case_id", "pokemon_id", F.col("annotator").alias("annotator_a"), F.col("grade").alias("ga"))
    b = grades.select("case_id", "pokemon_id", F.col("annotator").alias("annotator_b"), F.col("grade").alias("gb"))
    both = a.join(b, ["case_id", "pokemon_id"]).where("annotator_a < annotator_b")
    margins = [F.sum((F.col(c) == g).cast("double")).alias(f"{c}{g}") for c in ("ga", "gb") for g in range(4)]
    sums = both.groupBy("annotator_a", "annotator_b").agg(F.count("*").alias("common"), F.sum((F.col("ga") - F.col("gb")) ** 2 / 9.0).alias("seen"), *margins)
    expected = sum((F.lit((x - y) ** 2 / 9.0) * F.col(f"ga{x}") * F.col(f"gb{y}") for x in range(4) for y in range(4) if x != y), F.lit(0.0)) / (F.col("common") * F.col("common"))
    observed = F.col("seen") / F.col("common")
    kappa = F.when(expected == 0, F.when(observed == 0, 1.0).otherwise(0.0)).otherwise(1 - observed / expected)
    return sums.select("annotator_a", "annotator_b", F.col("common").alias("common_judgment_count"), F.round(kappa, 6).alias("quadratic_weighted_kappa"))


def slices(rows: DataFrame) -> DataFrame:
    """Coverage, conflict and adjudication by slice: all rows, each segment, each bucket of query length.

    A conflict takes two annotators and two grades; ratios without a denominator are 0.
    """
    bucket = length_bucket("query_length")
    kind = lambda name, value: F.struct(F.lit(name).alias("slice"), F.coalesce(value, F.lit("")).alias("value"))
    every = F.array(kind("overall", F.lit("all")), kind("segment", F.col("segment")), kind("query_length", bucket))
    marked = rows.select("case_id", "pokemon_id", "annotator", "grade", "final_grade", F.explode(every).alias("s"))
    graded = F.col("annotator").isNotNull() & F.col("grade").isNotNull()
    items = marked.groupBy("s.slice", "s.value", "case_id", "pokemon_id").agg(
        F.count_distinct(F.when(graded, F.col("annotator"))).alias("people"), F.count_distinct(F.when(graded, F.col("grade"))).alias("grades"), F.max(F.col("final_grade").isNotNull().cast("int")).alias("final")
    )
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    double, conflict = F.sum((F.col("people") >= 2).cast("int")), F.sum(((F.col("people") >= 2) & (F.col("grades") > 1)).cast("int"))
    return items.groupBy("slice", "value").agg(
        F.count_distinct("case_id").alias("case_count"), F.count("*").alias("candidate_count"), ratio(double, F.count("*")).alias("double_annotation_coverage"), ratio(conflict, double).alias("conflict_rate"), ratio(F.sum("final"), F.count("*")).alias("adjudication_coverage")
    )


def ready_cases(rows: DataFrame) -> DataFrame:
    """case_id and whether it may be used: every candidate has two annotators and a final grade, one is positive."""
    items = rows.groupBy("case_id", "pokemon_id").agg(F.count_distinct(F.when(F.col("grade").isNotNull(), F.col("annotator"))).alias("people"), F.max("final_grade").alias("final"))
    return items.groupBy("case_id").agg((F.bool_and((F.col("people") >= 2) & F.col("final").isNotNull()) & F.coalesce(F.bool_or(F.col("final") > 0), F.lit(False))).alias("ready"))


def quality_rows(cases: DataFrame, candidates: DataFrame, annotations: DataFrame, finals: DataFrame) -> DataFrame:
    """Case x candidate x annotation; a candidate without annotation has one row of nulls."""
    rows = cases.select("case_id", "segment", "query_length").join(candidates.select("case_id", "pokemon_id"), "case_id")
    return rows.join(annotations.select("case_id", "pokemon_id", "annotator", "grade"), ["case_id", "pokemon_id"], "left").join(finals.select("case_id", "pokemon_id", "final_grade"), ["case_id", "pokemon_id"], "left")


def exported_cases(cases: DataFrame, finals: DataFrame) -> DataFrame:
    """case_id, query, place (from 0), pokemon_id and grade of every graded item (grade over 0) of every case, items in order.

    One row an item: a case with any number of items is sorted, never gathered into a list.
    """
    graded = finals.where(F.col("final_grade") > 0).groupBy("case_id", "pokemon_id").agg(F.max("final_grade").alias("grade"))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("pokemon_id")) - 1
    return cases.select("case_id", "query").join(graded.withColumn("place", place), "case_id").select("case_id", "query", "place", "pokemon_id", "grade")


def annotation_report(rows: DataFrame) -> DataFrame:
    """The whole report as rows (section, name, metric, value): overall, annotator pairs and slices.

    overall adds the number of annotators and of pairs and the mean kappa of all pairs.
    """
    kappas = pair_kappas(rows)
    parts = slices(rows).withColumn("section", F.when(F.col("slice") == "overall", "overall").otherwise(F.concat(F.lit("slice:"), F.col("slice"))))
    metrics = ["case_count", "candidate_count", "double_annotation_coverage", "conflict_rate", "adjudication_coverage"]
    pairs = kappas.withColumn("name", F.concat_ws("|", "annotator_a", "annotator_b")).withColumn("section", F.lit("pair"))
    annotators = rows.where(F.col("annotator").isNotNull() & F.col("grade").isNotNull()).agg(F.count_distinct("annotator").alias("annotator_count"))
    over = kappas.agg(F.count("*").alias("pair_count"), F.round(F.avg("quadratic_weighted_kappa"), 6).alias("mean_quadratic_weighted_kappa"))

    def long(df: DataFrame, section, name, columns: list[str]) -> DataFrame:
        each = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns))
        return df.select(section.alias("section"), name.alias("name"), F.explode(each).alias("m")).select("section", "name", "m.metric", "m.value")

    whole = [F.lit("overall"), F.lit("all")]
    return (
        long(parts, F.col("section"), F.col("value"), metrics)
        .unionByName(long(pairs, F.col("section"), F.col("name"), ["common_judgment_count", "quadratic_weighted_kappa"]))
        .unionByName(long(annotators, *whole, ["annotator_count"]))
        .unionByName(long(over, *whole, ["pair_count", "mean_quadratic_weighted_kappa"]))
    )


def same_outputs(first: DataFrame, second: DataFrame, group: str, item: str, scores: list[str], *, relative: float = 1e-5, absolute: float = 1e-8) -> DataFrame:
    """group, same_items (the same item at every rank) and same_scores (all within tolerance) of two runs' ranked outputs.

    ``first`` and ``second``: group, rank, item and the scores; a place that only one run has is a
    difference; two nulls are equal.  Two sources are equivalent, and a repeated run stable, if all are true.
    """
    a = first.select(group, "rank", F.col(item).alias("_a"), *(F.col(s).alias(f"_a{s}") for s in scores), F.lit(True).alias("_x"))
    b = second.select(group, "rank", F.col(item).alias("_b"), *(F.col(s).alias(f"_b{s}") for s in scores), F.lit(True).alias("_y"))
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    close = F.lit(True)
    for s in scores:
        x, y = F.col(f"_a{s}"), F.col(f"_b{s}")
        close = close & (x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= absolute + relative * F.abs(y), F.lit(False)))
    joined = a.join(b, [group, "rank"], "full_outer")
    return joined.groupBy(group).agg(F.bool_and(both & F.col("_a").eqNullSafe(F.col("_b"))).alias("same_items"), F.bool_and(both & close).alias("same_scores"))
