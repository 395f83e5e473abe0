"""Request metrics: cumulative histograms, quantiles, sliding rates, alerts, and their streaming forms.

The same expressions serve batch tables and streams; a stream adds a watermark, so state is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Upper bounds of the duration buckets in seconds; the last bucket holds all.
BOUNDS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)


def _label(bound: float) -> str:
    return f"{bound:g}"


def histogram(rows: DataFrame, by: list[str], seconds: Column) -> DataFrame:
    """by, le, bucket_count, total_count, total_sum: cumulative counts of every bound and +Inf.  Negative durations count as 0, null ones not at all."""
    rows = rows.where(seconds.isNotNull()).withColumn("_s", F.greatest(seconds, F.lit(0.0)))
    sums = [F.sum((F.col("_s") <= b).cast("bigint")).alias(f"b{i}") for i, b in enumerate(BOUNDS)]
    total = rows.groupBy(*by).agg(*sums, F.count("*").alias("total_count"), F.round(F.sum("_s"), 6).alias("total_sum"))
    pairs = [F.struct(F.lit(_label(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BOUNDS)]
    every = F.array(*pairs, F.struct(F.lit("+Inf").alias("le"), F.col("total_count").alias("n")))
    return total.select(*by, "total_count", "total_sum", F.explode(every).alias("b")).select(*by, "b.le", F.col("b.n").alias("bucket_count"), "total_count", "total_sum")


def quantile(buckets: DataFrame, by: list[str], q: float) -> DataFrame:
    """by and ``quantile``: linear within the first bucket that reaches it; the last finite bound past all of them; null without observations."""
    bound = F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").cast("double"))
    rows = buckets.select(*by, bound.alias("bound"), "bucket_count").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bound", "bucket_count"))).alias("b"))  # ten a group
    total = F.element_at("b", -1)["bucket_count"]
    place = F.expr(f"size(filter(b, x -> x.bucket_count < {q} * element_at(b, -1).bucket_count))")
    here, before = F.get("b", place), F.get("b", place - 1)
    low, had = F.coalesce(before["bound"], F.lit(0.0)), F.coalesce(before["bucket_count"], F.lit(0))
    inside = low + (here["bound"] - low) * (q * total - had) / (here["bucket_count"] - had)
    value = F.when(total > 0, F.when(here["bound"] == float("inf"), before["bound"]).otherwise(inside))
    return rows.select(*by, F.round(value, 6).alias("quantile"))


def rates(rows: DataFrame, by: list[str], time: str, length: str, slide: str) -> DataFrame:
    """window_start, by and ``n``: events in every sliding window that holds any."""
    return rows.where(F.col(time).isNotNull()).groupBy(F.window(time, length, slide).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def ratio(rows: DataFrame, bad: Column, time: str, length: str, slide: str) -> DataFrame:
    """window_start, total and ratio of bad events in every sliding window."""
    return rows.where(F.col(time).isNotNull()).groupBy(F.window(time, length, slide).alias("w")).agg(F.count("*").alias("total"), F.round(F.sum(bad.cast("int")) / F.count("*"), 6).alias("ratio")).select(F.col("w.start").alias("window_start"), "total", "ratio")


def holds(windows: DataFrame, firing: Column, step_seconds: int, least: int) -> DataFrame:
    """Windows at which a condition has held for ``least`` consecutive windows, with the length of its run so far.

    Windows are one row a step of the whole series, so their order is that of a small table.
    """
    stamped = windows.withColumn("_f", F.coalesce(firing, F.lit(False))).withColumn("_t", F.unix_timestamp("window_start"))
    order = Window.orderBy("_t")
    broken = (~F.col("_f")) | (F.col("_t") - F.lag("_t").over(order) != step_seconds)
    runs = stamped.withColumn("_run", F.sum(F.when(broken, 1).otherwise(0)).over(order))
    length = F.sum(F.col("_f").cast("int")).over(Window.partitionBy("_run").orderBy("_t"))
    return runs.withColumn("run", length).where(F.col("_f") & (F.col("run") >= least)).select("window_start", "run")


#: The alerts: what is measured over which window, its limit and how many minutes it must hold.
ALERTS = {
    "error_ratio": ("5 minutes", 0.05, 5),
    "p95_seconds": ("5 minutes", 2.5, 10),
    "limited": ("10 minutes", 5.0, 1),
    "failures": ("10 minutes", 2.0, 1),
    "attempts": ("10 minutes", 15.0, 1),
}


def alerts(rows: DataFrame, time: str, marks: dict[str, Column], seconds: Column, *, minute: str = "1 minute", scale: int = 1) -> DataFrame:
    """alert, window_start and run of every window at which an alert has held long enough.

    ``marks``: boolean columns error, limited, failures and attempts; ``seconds``: the duration.
    Windows slide by a minute (``scale`` minutes, windows and holds alike, for slower traffic).  The 95th
    percentile is that of the duration histogram, as ``quantile`` reads it.
    """
    step = f"{scale} minutes" if scale > 1 else minute
    own = {**marks, "p95_seconds": F.lit(False)}
    out = None
    for name, (length, limit, minutes) in ALERTS.items():
        length = f"{int(length.split()[0]) * scale} minutes"
        if name == "error_ratio":
            windows = ratio(rows, own["error"], time, length, step).select("window_start", F.col("ratio").alias("value"))
        elif name == "p95_seconds":
            slid = rows.where(F.col(time).isNotNull()).select(F.window(time, length, step)["start"].alias("window_start"), seconds.alias("_d"))
            windows = quantile(histogram(slid, ["window_start"], F.col("_d")), ["window_start"], 0.95).select("window_start", F.col("quantile").alias("value"))
        else:
            windows = rates(rows.where(own[name]), [], time, length, step).select("window_start", F.col("n").cast("double").alias("value"))
        held = holds(windows, F.col("value") > limit, 60 * scale, minutes).select(F.lit(name).alias("alert"), "window_start", "run")
        out = held if out is None else out.unionByName(held)
    return out


def offered_load(rows: DataFrame, client: str, time: str, ident: str, seconds: int) -> DataFrame:
    """client, ident, time and ``load``: the client's events in the ``seconds`` up to each, itself included.

    Every event is put into its slot of ``seconds`` and the next one, so a frame is counted within
    one client and slot: a busy client is split over time, not gathered.
    """
    rows = rows.where(F.col(client).isNotNull() & F.col(time).isNotNull())
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    slot = F.floor(micros / (seconds * 1_000_000)).cast("bigint")
    both = rows.select(client, ident, time, micros.alias("_m"), F.explode(F.array(F.struct(slot.alias("s"), F.lit(True).alias("own")), F.struct((slot + 1).alias("s"), F.lit(False).alias("own")))).alias("_p"))
    frame = Window.partitionBy(client, "_p.s").orderBy("_m").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return both.withColumn("load", F.count("*").over(frame)).where("_p.own").select(client, ident, time, "load")


def exposition(buckets: DataFrame, labels: list[str], metric: str) -> DataFrame:
    """place and line of a text exposition of a histogram: buckets, sum and count of every label set, in order."""
    text = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r"\\", r"\\\\\\\\"), '"', r'\\\\"'), F.lit('"')) for c in labels))
    rank = F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").cast("double"))
    lines = buckets.select(text.alias("_l"), F.struct(F.lit(0).alias("kind"), rank.alias("rank")).alias("_o"), F.concat(F.lit(metric + "_bucket{"), text, F.lit(',le="'), F.col("le"), F.lit('"} '), F.col("bucket_count").cast("string")).alias("line"))
    whole = buckets.where("le = '+Inf'")
    for kind, (name, value) in enumerate((("_sum", F.format_string("%.9f", F.col("total_sum"))), ("_count", F.col("total_count").cast("string"))), 1):
        lines = lines.unionByName(whole.select(text.alias("_l"), F.struct(F.lit(kind).alias("kind"), F.lit(0.0).alias("rank")).alias("_o"), F.concat(F.lit(metric + name + "{"), text, F.lit("} "), value).alias("line")))
    return lines.select(F.col("_l").alias("label_set"), F.col("_o.kind").alias("kind"), F.col("_o.rank").alias("rank"), "line").orderBy("label_set", "kind", "rank")


# streams -----------------------------------------------------------------------------------------


def tumbling(stream: DataFrame, by: list[str], time: str, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window; events later than ``late`` after the newest are left out of a stream."""
    return rates(stream.withWatermark(time, late), by, time, length, length)


def sessions(stream: DataFrame, client: str, time: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """client, session_start, session_end and n: runs of events without a pause of ``gap``."""
    rows = stream.withWatermark(time, late).where(F.col(client).isNotNull() & F.col(time).isNotNull())
    return rows.groupBy(F.session_window(time, gap).alias("s"), client).agg(F.count("*").alias("n")).select(client, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")
