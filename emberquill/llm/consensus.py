"""Consensus grades from disagreeing annotators, their agreement and reliability.

Method.  Iteratively reweighted voting: a weighted vote gives each item's consensus; each
annotator's accuracy is measured against the vote of the others (leave one out) and smoothed
towards the common accuracy; the log odds of that accuracy are the next weights.  It stops when no
accuracy moves by more than a tolerance; votes that swing between states are damped by ever smaller
steps, and what still doesn't settle is reported.  Annotators who meet the final consensus in too few of
their items are unreliable; each item's grade is the one most of its reliable annotators gave.
Agreement is Krippendorff's alpha, chance-corrected and defined for missing ratings.

Scale.  Ratings are reduced to the latest of each annotator and item before anything else, by
partial aggregation.  Each round is two aggregations of one row a rating; a hot item or annotator
is summed on the map side.  Scores stay in tables, whatever the number of annotators; weights are
broadcast only if a count has proved them few.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberquill.session import count_at_most, discard, materialise

GRADES = 4
#: Smoothing: pseudo-ratings at the common accuracy.
PRIOR = 4.0
#: Annotators that may be broadcast.
FEW = 100_000
RELIABLE = 0.6
#: Rounds after the plain ones in which weights move only half way, a third of it and so on.
DAMPED = 48
#: Accuracies are held this far from 0 and 1, weights at LEAST this.
CAP, LEAST = 0.02, 0.01
BLANKS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
ITEM = ["case_id", "pokemon_id"]


def latest_valid(rows: DataFrame) -> DataFrame:
    """The latest valid grade of every annotator and item: case_id, pokemon_id, annotator, grade."""
    name = F.lower(F.regexp_replace("annotator", BLANKS, ""))
    rows = rows.select(*ITEM, name.alias("annotator"), "grade", "created_at", "annotation_id")
    for c in (*ITEM, "annotator"):
        rows = rows.where(F.col(c).isNotNull())
    rows = rows.where((F.col("annotator") != "") & F.col("grade").between(0, GRADES - 1))
    order = F.struct("created_at", "annotation_id")
    return rows.groupBy(*ITEM, "annotator").agg(F.max_by("grade", order).cast("int").alias("grade"))


def _weighed(ratings: DataFrame, weights: DataFrame, few: bool) -> DataFrame:
    return ratings.join(F.broadcast(weights) if few else weights, "annotator")


def _votes(weighed: DataFrame) -> DataFrame:
    sums = [F.sum(F.when(F.col("grade") == g, F.col("w")).otherwise(0.0)).alias(f"v{g}") for g in range(GRADES)]
    return weighed.groupBy(*ITEM).agg(*sums)


def _top(values: list):
    """The place of the greatest value; ties go to the smaller grade.  Sums are rounded first: their order varies."""
    values = [F.round(v, 9) for v in values]
    best = F.greatest(*values)
    out = F.lit(GRADES - 1)
    for g in reversed(range(GRADES - 1)):
        out = F.when(values[g] == best, F.lit(g)).otherwise(out)
    return out


def _scores(ratings: DataFrame, weights: DataFrame, few: bool) -> DataFrame:
    """annotator, items, met (of the others' votes) and accuracy (against all votes), under the given weights."""
    weighed = _weighed(ratings, weights, few)
    others = [F.col(f"v{g}") - F.when(F.col("grade") == g, F.col("w")).otherwise(0.0) for g in range(GRADES)]
    scores = F.col("annotators") > 1  # alone, there is nobody to meet: null, which no sum or count takes
    met, meets = (F.when(scores, (F.col("grade") == _top(v)).cast("double")) for v in (others, [F.col(f"v{g}") for g in range(GRADES)]))
    judged = weighed.join(_votes(weighed), ITEM).select("annotator", met.alias("met"), meets.alias("meets"))
    return judged.groupBy("annotator").agg(F.count("met").alias("items"), F.coalesce(F.sum("met"), F.lit(0.0)).alias("met"), F.avg("meets").alias("accuracy"))


def consensus(rows: DataFrame, *, least: int = 3, rounds: int = 4, tolerance: float = 0.002) -> tuple[DataFrame, DataFrame]:
    """``items`` (case_id, pokemon_id, grade, support, annotators) and ``annotators``
    (annotator, items, accuracy, leave_one_out, weight, reliable, converged).

    ``rows``: annotation_id, case_id, pokemon_id, annotator, grade, created_at; other columns are
    ignored.  Names are compared without case and outer blanks; grades outside 0 to 3 don't count.
    Items graded by at least ``least`` annotators are given.  Annotators are scored on every item
    with two or more grades, and all who gave a valid grade are listed: without such an item they
    have 0 items, null accuracy, the common accuracy as leave_one_out and null reliable.

    Defined cases: rows with a null item, name or grade don't count; of equal times the greater
    annotation_id is later, null times are earliest; ties go to the weightier grade, then to the
    smaller; accuracies not settled after ``rounds`` plain and DAMPED ever smaller steps raise a
    RuntimeWarning, and the last votes are given with ``converged`` false; items without a reliable
    annotator get the weighted consensus; no rows give no rows.
    """
    ratings = latest_valid(rows)
    sizes = ratings.groupBy(*ITEM).agg(F.count("*").alias("annotators"))
    ratings = materialise(ratings.join(sizes, ITEM), "ratings")
    weights = ratings.select("annotator").distinct().withColumn("w", F.lit(1.0)).withColumn("leave_one_out", F.lit(None).cast("double"))
    few = count_at_most(weights, FEW) <= FEW
    raw, converged = ratings.limit(0), False
    for r in range(rounds + DAMPED):
        step = 1.0 if r < rounds else 1 / (r - rounds + 2)
        last, raw = raw, materialise(_scores(ratings, weights, few).join(weights.withColumnsRenamed({"w": "w_before", "leave_one_out": "before"}), "annotator"), "annotators")
        met, items = raw.agg(F.sum("met"), F.sum("items")).first()
        loo = (F.col("met") + PRIOR * (met / items if items else 0.0)) / (F.col("items") + PRIOR)
        capped = F.least(F.greatest(loo, F.lit(CAP)), F.lit(1 - CAP))
        weight = F.greatest(F.log(capped * (GRADES - 1) / (1 - capped)), F.lit(LEAST))
        scored = raw.select("annotator", "items", "accuracy", loo.alias("leave_one_out"), (step * weight + (1 - step) * F.col("w_before")).alias("w"), "before")
        weights = scored.select("annotator", "w", "leave_one_out")
        discard(last)
        if r and scored.agg(F.coalesce(F.max(F.abs(F.col("leave_one_out") - F.col("before"))), F.lit(0.0))).first()[0] <= tolerance:
            converged = True
            break
    if not converged:
        warnings.warn(f"consensus did not settle in {rounds + DAMPED} rounds", RuntimeWarning, stacklevel=2)
    annotators = scored.select("annotator", "items", "accuracy", "leave_one_out", F.col("w").alias("weight"), (F.col("accuracy") >= RELIABLE).alias("reliable"), F.lit(converged).alias("converged"))
    known = annotators.select("annotator", F.col("weight").alias("w"), "reliable")
    heads = [F.sum(((F.col("grade") == g) & F.coalesce("reliable", F.lit(False))).cast("double")).alias(f"n{g}") for g in range(GRADES)]
    sums = [F.sum(F.when(F.col("grade") == g, F.col("w")).otherwise(0.0)).alias(f"v{g}") for g in range(GRADES)]
    counted = _weighed(ratings.where(F.col("annotators") >= least), known, few).groupBy(*ITEM).agg(*heads, *sums, F.max("annotators").alias("annotators"))
    # heads decide, weights break ties: a weight is under 6, so a million of them stays under one head
    grade = _top([F.col(f"n{g}") + F.round(F.col(f"v{g}"), 6) * 1e-7 for g in range(GRADES)])
    heads_total = sum((F.col(f"n{g}") for g in range(1, GRADES)), F.col("n0"))
    support = F.greatest(*(F.col(f"n{g}") for g in range(GRADES))) / F.when(heads_total > 0, heads_total)
    items = counted.select(*ITEM, grade.cast("int").alias("grade"), support.alias("support"), "annotators")
    return items, annotators


def agreement(rows: DataFrame) -> DataFrame:
    """One row: items, ratings, observed and expected disagreement, and Krippendorff's alpha (nominal).

    Items with fewer than two valid grades can't agree and don't count.  Without any pair, or if
    all grades are equal, the expected disagreement is 0 and alpha is 1 if observed is 0 too, null
    without pairs.
    """
    ratings = latest_valid(rows)
    by = ratings.groupBy(*ITEM).agg(F.count("*").alias("m"), *(F.sum((F.col("grade") == g).cast("double")).alias(f"n{g}") for g in range(GRADES))).where("m > 1")
    same = sum((F.col(f"n{g}") * (F.col(f"n{g}") - 1) for g in range(1, GRADES)), F.col("n0") * (F.col("n0") - 1))
    total = by.agg(
        F.count("*").alias("items"), F.coalesce(F.sum("m"), F.lit(0)).alias("ratings"),
        F.sum((F.col("m") * (F.col("m") - 1) - same) / (F.col("m") - 1)).alias("d"), *(F.sum(f"n{g}").alias(f"s{g}") for g in range(GRADES)),
    )
    n = F.col("ratings")
    alike = sum((F.col(f"s{g}") * (F.col(f"s{g}") - 1) for g in range(1, GRADES)), F.col("s0") * (F.col("s0") - 1))
    out = total.select("items", "ratings", (F.col("d") / n).alias("observed"), ((n * (n - 1) - alike) / (n * (n - 1))).alias("expected"))
    alpha = F.when(F.col("ratings") == 0, None).when(F.col("expected") == 0, F.when(F.col("observed") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.col("observed") / F.col("expected"))
    return out.select("items", "ratings", *(F.round(c, 6).alias(c) for c in ("observed", "expected")), F.round(alpha, 6).alias("alpha"))
