"""Metrics, limits and calendar queries on the events table (durations are ``value`` / 40 seconds)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberquill.operators import calendar as K
from emberquill.operators import explain as X
from emberquill.session import table
from emberquill.streaming import limiter, metrics


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def _histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(_events(spark, d), ["event_type"], F.col("value") / 40)


def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _histogram(spark, d)


def histogram_quantile(spark: SparkSession, d: str) -> DataFrame:
    return metrics.quantile(_histogram(spark, d), ["event_type"], 0.95)


def exposition(spark: SparkSession, d: str) -> DataFrame:
    return metrics.exposition(_histogram(spark, d), ["event_type"], "request_duration_seconds").select("line")


def error_ratio(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ratio(_events(spark, d), F.col("event_type") == "error", "ts", "60 minutes", "10 minutes")


def alert_holds(spark: SparkSession, d: str) -> DataFrame:
    """Windows at which the error ratio has been over 0.3 for three windows."""
    return metrics.holds(error_ratio(spark, d), F.col("ratio") > 0.3, 600, 3)


def request_rate(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rates(_events(spark, d), ["event_type"], "ts", "60 minutes", "60 minutes")


def sliding_offered_load(spark: SparkSession, d: str) -> DataFrame:
    return metrics.offered_load(_events(spark, d), "user_id", "ts", "event_id", 36_000).select("event_id", "user_id", "load")


def rate_limit_decisions(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("explained", F.col("event_type") == "purchase")
    return limiter.decisions(rows, client="user_id", time="ts", ident="event_id", limit=3, seconds=86_400, flag="explained", flag_limit=1, flag_seconds=172_800)


def alert_rules(spark: SparkSession, d: str) -> DataFrame:
    """All five alerts over windows of hours: errors, slow requests, purchases for limited ones, signups for failures, clicks for attempts."""
    kind = F.col("event_type")
    return metrics.alerts(_events(spark, d), "ts", {"error": kind == "error", "limited": kind == "purchase", "failures": kind == "signup", "attempts": kind == "click"}, F.col("value") / 10, scale=60)


def limited_by_all(spark: SparkSession, d: str) -> DataFrame:
    """Decisions with a third limit over all clients for purchases."""
    rows = _events(spark, d).withColumn("explained", F.col("event_type") == "purchase")
    return limiter.decisions(rows, client="user_id", time="ts", ident="event_id", limit=3, seconds=600, flag="explained", flag_limit=2, flag_seconds=600, total_limit=2, total_seconds=600)


def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.tumbling(_events(spark, d), ["event_type"], "ts", "1 hour")


def session_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.sessions(_events(spark, d), "user_id", "ts", "6 hours")


def calendar_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", K.branch("ts").alias("branch"), K.valid_until("ts").alias("valid_until"), K.max_age("ts").alias("max_age"), K.lunar_phase(F.dayofmonth("ts")).alias("phase"))


def evidence_packets(spark: SparkSession, d: str) -> DataFrame:
    """Each request's evidence as compact JSON, scores clamped and rounded."""
    rows = table(spark, d, "evidence_response").where(F.col("request_id").isNotNull()).select("request_id", "evidence_id", X.evidence_id("chunk_id").alias("chunk"), "dense_rank", F.round(F.greatest(F.least("dense_score", F.lit(1.0)), F.lit(-1.0)), 8).alias("dense_score"))
    return X.packet(rows.distinct(), "request_id", ["evidence_id", "chunk", "dense_rank", "dense_score"], ["evidence_id"])


QUERIES = {
    f.__name__: f
    for f in (
        latency_histogram, histogram_quantile, exposition, error_ratio, alert_holds, request_rate, sliding_offered_load, rate_limit_decisions, alert_rules, limited_by_all,
        tumbling_counts, session_counts, calendar_blocks, evidence_packets,
    )
}

_B = metrics.BOUNDS
_H = "h AS (SELECT event_type, unnest([" + ", ".join(f"'{b:g}'" for b in _B) + ", '+Inf']) AS le, unnest([" + ", ".join(f"count(*) FILTER (greatest(value / 40, 0) <= {b})" for b in _B) + ", count(*)]) AS bucket_count, count(*) AS total_count, round(sum(greatest(value / 40, 0)), 6) AS total_sum FROM events WHERE value IS NOT NULL GROUP BY 1)"
_RATIO = "r AS (SELECT window_start, count(*) AS total, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS ratio FROM (SELECT event_type, time_bucket(INTERVAL 10 MINUTE, ts) - to_minutes(10 * k) AS window_start FROM events, range(0, 6) t(k)) GROUP BY 1)"
_BRANCH = "'" + K.BRANCHES + "'"
SQL = {
    "latency_histogram": f"WITH {_H} SELECT * FROM h",
    "histogram_quantile": f"""WITH {_H}, b AS (SELECT *, CASE le WHEN '+Inf' THEN 'infinity'::DOUBLE ELSE le::DOUBLE END AS bound FROM h), p AS (SELECT *, lag(bound, 1, 0) OVER w AS low, lag(bucket_count, 1, 0) OVER w AS had FROM b WINDOW w AS (PARTITION BY event_type ORDER BY bound))
SELECT event_type, round(CASE WHEN bound = 'infinity'::DOUBLE THEN low ELSE low + (bound - low) * (0.95 * total_count - had) / (bucket_count - had) END, 6) AS quantile FROM p WHERE bucket_count >= 0.95 * total_count QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY bound) = 1""",
    "exposition": f"""WITH {_H}, l AS (SELECT 'request_duration_seconds_bucket{{event_type="' || event_type || '",le="' || le || '"}} ' || bucket_count AS line FROM h
UNION ALL SELECT 'request_duration_seconds_sum{{event_type="' || event_type || '"}} ' || printf('%.9f', total_sum) FROM h WHERE le = '+Inf' UNION ALL SELECT 'request_duration_seconds_count{{event_type="' || event_type || '"}} ' || total_count FROM h WHERE le = '+Inf') SELECT line FROM l""",
    "error_ratio": f"WITH {_RATIO} SELECT * FROM r",
    "alert_holds": f"""WITH {_RATIO}, f AS (SELECT window_start, ratio > 0.3 AS f, epoch(window_start) - lag(epoch(window_start)) OVER (ORDER BY window_start) AS step FROM r), g AS (SELECT *, sum(CASE WHEN NOT f OR step <> 600 THEN 1 ELSE 0 END) OVER (ORDER BY window_start) AS run_id FROM f),
n AS (SELECT window_start, f, sum(f::INT) OVER (PARTITION BY run_id ORDER BY window_start)::BIGINT AS run FROM g) SELECT window_start, run FROM n WHERE f AND run >= 3""",
    "request_rate": "SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "tumbling_counts": "SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "sliding_offered_load": "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 35999999999 PRECEDING AND CURRENT ROW) AS load FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL",
    "session_counts": """WITH s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events))
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k""",
    "calendar_blocks": f"""WITH e AS (SELECT event_id, ts, hour(ts) AS h FROM events), u AS (SELECT *, date_trunc('day', ts) + to_hours(CASE WHEN h = 23 THEN 24 WHEN h = 0 THEN 1 ELSE least(((h - 1) // 2) * 2 + 3, 24) END::INTEGER) AS valid_until FROM e)
SELECT event_id, substr({_BRANCH}, (((h + 1) // 2) % 12 + 1)::INTEGER, 1) AS branch, valid_until, (epoch(valid_until) - floor(epoch(ts)))::INTEGER AS max_age, CASE WHEN day(ts) <= 7 THEN 'new' WHEN day(ts) <= 14 THEN 'waxing' WHEN day(ts) <= 21 THEN 'full' ELSE 'waning' END AS phase FROM u""",
}

# one request of every client a step, with the times its two limits still hold
SQL["rate_limit_decisions"] = """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, event_type = 'purchase' AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
r AS (SELECT 0::BIGINT AS k, user_id, NULL::BIGINT AS event_id, []::DOUBLE[] AS a, []::DOUBLE[] AS b, NULL::BOOLEAN AS ok, NULL::INTEGER AS remaining, NULL::INTEGER AS retry_after, NULL::VARCHAR AS scope FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT k, user_id, event_id, CASE WHEN wa = 0 AND wb = 0 THEN list_append(pa, t) ELSE pa END, CASE WHEN wa = 0 AND wb = 0 AND f THEN list_append(pb, t) ELSE pb END, wa = 0 AND wb = 0,
    CASE WHEN wa > 0 OR wb > 0 THEN 0 WHEN f THEN least(2 - len(pa), 0 - len(pb)) ELSE 2 - len(pa) END::INTEGER, CASE WHEN wa > 0 THEN wa ELSE wb END::INTEGER,
    CASE WHEN wa > 0 THEN 'requests' WHEN wb > 0 THEN 'flagged' WHEN f AND 0 - len(pb) < 2 - len(pa) THEN 'flagged' ELSE 'requests' END
  FROM (SELECT *, CASE WHEN len(pa) >= 3 THEN greatest(1, ceil(pa[1] + 86400 - t)) ELSE 0 END AS wa, CASE WHEN f AND len(pb) >= 1 THEN greatest(1, ceil(pb[1] + 172800 - t)) ELSE 0 END AS wb
    FROM (SELECT e.*, list_filter(r.a, lambda x: x > e.t - 86400) AS pa, list_filter(r.b, lambda x: x > e.t - 172800) AS pb FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)))
SELECT event_id AS ident, user_id AS client, ok AS allowed, remaining, retry_after, scope FROM r WHERE k > 0
"""


def _counted(name: str, kind: str, hours: int, limit: float, hold: int) -> str:
    windows = f"SELECT time_bucket(INTERVAL 60 MINUTE, ts) - to_hours(k) AS window_start, count(*)::DOUBLE AS v FROM events, range(0, {hours}) t(k) WHERE event_type = '{kind}' GROUP BY 1"
    return _held(name, windows, limit, hold)


def _held(name: str, windows: str, limit: float, hold: int) -> str:
    return f"""SELECT '{name}' AS alert, window_start, run FROM (SELECT window_start, f, sum(f::INT) OVER (PARTITION BY g ORDER BY window_start)::BIGINT AS run FROM (
  SELECT *, sum(CASE WHEN NOT f OR step <> 3600 THEN 1 ELSE 0 END) OVER (ORDER BY window_start) AS g FROM (SELECT window_start, coalesce(v > {limit}, false) AS f, epoch(window_start) - lag(epoch(window_start)) OVER (ORDER BY window_start) AS step FROM ({windows})))) WHERE f AND run >= {hold}"""


_SLID = "SELECT time_bucket(INTERVAL 60 MINUTE, ts) - to_hours(k) AS window_start, event_type, greatest(value / 10, 0) AS s FROM events, range(0, 5) t(k)"
_P95 = f"""SELECT window_start, CASE WHEN bound = 'infinity'::DOUBLE THEN low ELSE low + (bound - low) * (0.95 * n - had) / (c - had) END AS v FROM (
  SELECT *, lag(bound, 1, 0) OVER w AS low, lag(c, 1, 0) OVER w AS had FROM (SELECT window_start, n, unnest([{", ".join(f"{b}::DOUBLE" for b in _B)}, 'infinity'::DOUBLE]) AS bound, unnest(cs) AS c FROM (SELECT window_start, count(*) AS n, [{", ".join(f"count(*) FILTER (s <= {b})" for b in _B)}, count(*)] AS cs FROM ({_SLID}) WHERE s IS NOT NULL GROUP BY 1)) WINDOW w AS (PARTITION BY window_start ORDER BY bound))
WHERE c >= 0.95 * n QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY bound) = 1"""
SQL["alert_rules"] = " UNION ALL ".join(
    (
        _held("error_ratio", f"SELECT window_start, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS v FROM ({_SLID}) GROUP BY 1", 0.05, 5),
        _held("p95_seconds", _P95, 2.5, 10), _counted("limited", "purchase", 10, 5, 1), _counted("failures", "signup", 10, 2, 1), _counted("attempts", "click", 10, 15, 1),
    )
)
