"""Vector expressions on arrays of numbers, in double precision and array order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def clipped(c, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def cosine(a, b) -> Column:
    """The cosine clipped to 0..1; 0 if either is a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, clipped(dot(a, b) / n)).otherwise(0.0)


def sigmoid(c) -> Column:
    """The logistic function, its argument clamped to +-60."""
    x = clipped(c, -60.0, 60.0)
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def mean_vectors(rows: DataFrame, keys: list[str], vector: str, weight: Column | None = None, places: int = 8) -> DataFrame:
    """keys and ``vector``: the (weighted) mean of each group's vectors at length one, rounded.

    Sums are kept by place, so a group of any size is summed on the map side and no vector list is
    ever gathered.  Null vectors don't count; groups without weight give no row.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    flat = rows.where(F.col(vector).isNotNull()).select(*keys, w.alias("_w"), F.posexplode(vector).alias("_i", "_x"))
    mean = flat.groupBy(*keys, "_i").agg((F.sum(F.col("_x").cast("double") * F.col("_w")) / F.sum("_w")).alias("_m")).where(F.col("_m").isNotNull())
    lists = mean.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", "_m"))).alias("_v"))  # one entry a dimension
    return lists.select(*keys, F.transform(normalised(F.transform("_v", lambda p: p["_m"])), lambda x: F.round(x, places)).alias(vector))
