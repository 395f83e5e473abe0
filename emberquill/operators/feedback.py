"""Feedback on shown results: checked upserts, summaries, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberquill.operators.merge import upsert


def _match():
    return (F.col("verdict") == "match").cast("int")


def checked(feedback: DataFrame, items: DataFrame) -> DataFrame:
    """Every feedback row with ``problem``: unknown_item, rank, or null.  ``items``: impression_id, item_id, rank."""
    shown = items.select("impression_id", "item_id", F.col("rank").alias("shown_rank"))
    joined = feedback.join(shown, ["impression_id", "item_id"], "left")
    return joined.withColumn("problem", F.when(F.col("shown_rank").isNull(), "unknown_item").when(~F.col("rank").eqNullSafe(F.col("shown_rank")), "rank")).drop("shown_rank")


def shown(impressions: DataFrame, items: DataFrame) -> DataFrame:
    """What keeps an impression with its items from being stored: impression_id and ``problem`` (unknown_impression, rank, repeated_rank, repeated_item)."""
    ranked = items.groupBy("impression_id").agg(F.bool_and(F.coalesce(F.col("rank").between(1, 3), F.lit(False))).alias("_r"), (F.count_distinct("rank") < F.count("rank")).alias("_dr"), (F.count_distinct("item_id") < F.count("*")).alias("_di"))
    known = impressions.select("impression_id").distinct().withColumn("_k", F.lit(True))
    rows = ranked.join(known, "impression_id", "left")
    rules = {"unknown_impression": F.col("_k").isNull(), "rank": ~F.col("_r"), "repeated_rank": F.col("_dr"), "repeated_item": F.col("_di")}
    return rows.select("impression_id", F.explode(F.array_compact(F.array(*(F.when(ok, F.lit(n)) for n, ok in rules.items())))).alias("problem"))


def upserted(stored: DataFrame, feedback: DataFrame, items: DataFrame) -> DataFrame:
    """Stored feedback with the valid rows of new feedback merged in, by impression and item, with ``action``; rows with a problem change nothing."""
    good = checked(feedback, items).where(F.col("problem").isNull())
    return upsert(stored, good, ["impression_id", "item_id"], ["rank", "verdict", "reason"])


def by(feedback: DataFrame, items: DataFrame, impressions: DataFrame) -> DataFrame:
    """dimension (rank, reason, algorithm), value, feedback_count and match_rate (6 digits)."""
    joined = feedback.select("impression_id", "item_id", "verdict", "reason").join(items.select("impression_id", "item_id", F.col("rank").alias("shown")), ["impression_id", "item_id"], "left").join(impressions.select("impression_id", "algorithm_version"), "impression_id", "left")
    kind = lambda name, value: F.struct(F.lit(name).alias("dimension"), value.alias("value"))
    every = F.array(kind("rank", F.col("shown").cast("string")), kind("reason", F.col("reason")), kind("algorithm", F.col("algorithm_version")))
    flat = joined.select(_match().alias("m"), F.explode(every).alias("d"))
    return flat.where("d.value IS NOT NULL").groupBy("d.dimension", "d.value").agg(F.count("*").alias("feedback_count"), F.round(F.sum("m") / F.count("*"), 6).alias("match_rate"))


def summary(feedback: DataFrame, impressions: DataFrame) -> DataFrame:
    """One row: impressions, rated impressions, response rate, feedback, match rate; rates without a denominator are 0."""
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    rows = impressions.select(F.lit(1).alias("s"), F.lit(None).cast(feedback.schema["impression_id"].dataType).alias("i"), F.lit(0).alias("m")).unionByName(feedback.select(F.lit(0).alias("s"), F.col("impression_id").alias("i"), _match().alias("m")))
    one = rows.agg(*(F.coalesce(c, F.lit(0)).alias(n) for n, c in (("total_impressions", F.sum("s")), ("rated_impressions", F.count_distinct("i")), ("total_feedback", F.sum(1 - F.col("s"))), ("matches", F.sum("m")))))
    return one.select("total_impressions", "rated_impressions", ratio(F.col("rated_impressions"), F.col("total_impressions")).alias("response_rate"), "total_feedback", ratio(F.col("matches"), F.col("total_feedback")).alias("match_rate"))


def retained(impressions: DataFrame, children: list[DataFrame], days: int, now: str) -> list[DataFrame]:
    """Impressions of the last ``days`` days before ``now``, and of each child table the rows that belong to them."""
    if not 7 <= days <= 365:
        raise ValueError("retention is from 7 to 365 days")
    kept = impressions.where(F.col("created_at") >= F.to_timestamp(F.lit(now)) - F.make_interval(days=F.lit(days)))
    return [kept, *(c.join(kept.select("impression_id"), "impression_id", "left_semi") for c in children)]
