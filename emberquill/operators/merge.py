"""Upserts, versions and incremental work as functions from tables to tables.

A new table replaces the old by being written beside it: nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberquill.functions.text import content_hash, stable_id


def differs(columns: list[str], a: str, b: str) -> Column:
    """Whether any column of ``a`` is distinct from that of ``b``, nulls being equal."""
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def upsert(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The merged table with ``action``: insert, update (some column differs), keep or untouched (not in the source)."""
    t, s = target.select(*keys, *columns, F.lit(True).alias("_t")).alias("t"), source.select(*keys, *columns, F.lit(True).alias("_s")).alias("s")
    both = t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys], "full_outer")
    changed = differs(columns, "t", "s")
    action = F.when(F.col("_t").isNull(), "insert").when(F.col("_s").isNull(), "untouched").when(changed, "update").otherwise("keep")
    pick = lambda c: F.when(F.col("_s").isNull(), F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    return both.select(*(F.coalesce(f"s.{k}", f"t.{k}").alias(k) for k in keys), *(pick(c) for c in columns), action.alias("action"))


def synchronise(target: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``action`` of a child table brought to ``wanted``: delete, insert or keep."""
    t, w = target.select(*keys).distinct().withColumn("_t", F.lit(1)), wanted.select(*keys).distinct().withColumn("_w", F.lit(1))
    return t.join(w, keys, "full_outer").select(*keys, F.when(F.col("_w").isNull(), "delete").when(F.col("_t").isNull(), "insert").otherwise("keep").alias("action"))


def next_versions(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """keys, content_hash, version, action and document_id of incoming contents against stored versions.

    ``stored``: keys, version, is_current, content_hash; ``incoming``: keys, content.  The current
    version is kept if its hash is the same; else the version is one above the highest stored.
    """
    current = stored.where("is_current").groupBy(*keys).agg(F.max_by("content_hash", "version").alias("held"), F.max("version").alias("held_version"))
    top = stored.groupBy(*keys).agg(F.max("version").alias("top"))
    rows = incoming.select(*keys, content_hash("content").alias("content_hash")).join(current, keys, "left").join(top, keys, "left")
    same = F.col("held").eqNullSafe(F.col("content_hash"))
    version = F.when(same, F.col("held_version")).otherwise(F.coalesce("top", F.lit(0)) + 1)
    action = F.when(same, "keep").when(F.col("held").isNull(), "first").otherwise("replace")
    out = rows.select(*keys, "content_hash", version.cast("int").alias("version"), action.alias("action"))
    return out.withColumn("document_id", stable_id(F.lit("document"), *(F.col(k).cast("string") for k in keys), F.col("version").cast("string"), F.col("content_hash")))


def retired(stored: DataFrame, incoming: DataFrame, keys: list[str], source: str, kept: str = "profile") -> DataFrame:
    """Current versions whose source is no longer delivered, except the kept one."""
    return stored.where(F.col("is_current") & (F.col(source) != kept)).join(incoming.select(*keys).distinct(), keys, "left_anti")


def staged(stored: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The latest version that isn't current and has the wanted hash, by key."""
    rows = stored.where(~F.col("is_current")).join(wanted.select(*keys, "content_hash"), [*keys, "content_hash"])
    w = Window.partitionBy(*keys).orderBy(F.desc("version"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pending(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """Chunks whose vector is missing, not ready, empty or of another content, with the reason.

    ``embedded``: chunk_id, status, has_vector, content_hash (one row a chunk).
    """
    e = embedded.select(F.col("chunk_id"), F.col("status").alias("_s"), F.col("has_vector").alias("_v"), F.col("content_hash").alias("_h"))
    joined = chunks.select("chunk_id", "content_hash").join(e, "chunk_id", "left")
    reason = F.when(F.col("_s").isNull() & F.col("_h").isNull(), "missing").when(~F.col("_s").eqNullSafe(F.lit("ready")), "not_ready").when(~F.coalesce("_v", F.lit(False)), "empty").when(~F.col("_h").eqNullSafe(F.col("content_hash")), "changed")
    return joined.select("chunk_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def index_states(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id, total, ready, failed and state of every document: ready, failed, stale or unindexed."""
    per = chunks.groupBy("document_id").agg(F.count("*").alias("total"), F.sum((F.col("status") == "ready").cast("int")).alias("ready"), F.sum((F.col("status") == "failed").cast("int")).alias("failed"))
    joined = documents.select(F.col("id").alias("document_id"), "is_current", F.col("status").alias("_s")).join(per, "document_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    state = F.when(F.col("is_current") & (n("total") > 0) & (n("ready") == n("total")), "ready").when((F.col("_s") == "failed") | (n("failed") > 0), "failed").when(n("total") > 0, "stale").otherwise("unindexed")
    return joined.select("document_id", n("total").alias("total"), n("ready").alias("ready"), n("failed").alias("failed"), state.alias("state"))


def embedding_states(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """document_id, total, ready, failed and last_error over each document's chunks.

    ``chunks``: chunk_id, document_id, content_hash; ``embedded``: chunk_id, status, has_vector,
    content_hash, last_error.  A chunk is ready if its vector is there and of its content; the last
    error is that of the failed chunk with the greatest chunk_id that names one.
    """
    e = embedded.select("chunk_id", F.col("status").alias("_s"), F.col("has_vector").alias("_v"), F.col("content_hash").alias("_h"), "last_error")
    rows = chunks.select("chunk_id", "document_id", "content_hash").join(e, "chunk_id", "left")
    ready = F.coalesce((F.col("_s") == "ready") & F.col("_v") & (F.col("_h") == F.col("content_hash")), F.lit(False))
    failed = F.coalesce(F.col("_s") == "failed", F.lit(False))
    named = failed & (F.coalesce("last_error", F.lit("")) != "")
    return rows.groupBy("document_id").agg(F.count("*").alias("total"), F.count_if(ready).alias("ready"), F.count_if(failed).alias("failed"), F.max_by("last_error", F.when(named, F.col("chunk_id"))).alias("last_error"))


def source_states(descriptions: DataFrame, documents: DataFrame, states: DataFrame) -> DataFrame:
    """entity_id, source_key, status, current_id, staged_id, total, ready and last_error of every source that has a description or a document.

    ``descriptions``: entity_id, source_key, content_hash; ``documents``: id, entity_id, source_key,
    version, is_current, status, content_hash; ``states`` as ``embedding_states`` makes them.  The
    current document counts if its content is the description's (the profile's always), else the
    latest staged one that has it.  ready: every chunk is; failed: the document or a chunk is; stale: there
    is a document, but not ready; unindexed: there is none.
    """
    keys = ["entity_id", "source_key"]
    current = documents.where("is_current").select(*keys, F.col("id").alias("current_id"), F.col("content_hash").alias("_ch"), F.col("status").alias("_cs"))
    waiting = documents.where(~F.col("is_current")).join(descriptions.select(*keys, "content_hash"), [*keys, "content_hash"])
    waiting = waiting.groupBy(*keys).agg(F.max(F.struct("version", "id", "status")).alias("_w")).select(*keys, F.col("_w.id").alias("staged_id"), F.col("_w.status").alias("_ws"))
    wanted = descriptions.select(*keys, F.col("content_hash").alias("_dh"))
    rows = wanted.join(current, keys, "full_outer").join(waiting, keys, "full_outer")
    matches = F.col("current_id").isNotNull() & ((F.col("source_key") == "profile") | F.coalesce(F.col("_ch") == F.col("_dh"), F.lit(False)))
    rows = rows.withColumn("_m", matches).withColumn("document_id", F.when(F.col("_m"), F.col("current_id")).otherwise(F.col("staged_id"))).join(states, "document_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    own = F.when(F.col("_m"), F.col("_cs")).otherwise(F.col("_ws"))
    status = (
        F.when(F.col("_m") & (n("total") > 0) & (n("ready") == n("total")), "ready")
        .when(F.col("document_id").isNotNull() & (F.coalesce(own == "failed", F.lit(False)) | (n("failed") > 0)), "failed")
        .when(F.col("document_id").isNotNull() | F.col("current_id").isNotNull(), "stale")
        .otherwise("unindexed")
    )
    return rows.select(*keys, status.alias("status"), "current_id", "staged_id", n("total").alias("total"), n("ready").alias("ready"), "last_error")


def entity_states(entities: DataFrame, sources: DataFrame) -> DataFrame:
    """entity_id and status over its sources: failed before stale before ready; unindexed without any source."""
    rolled = sources.groupBy("entity_id").agg(F.bool_or(F.col("status") == "failed").alias("_f"), F.bool_and(F.col("status") == "ready").alias("_r"))
    status = F.when(F.col("_f").isNull(), "unindexed").when(F.col("_f"), "failed").when(F.col("_r"), "ready").otherwise("stale")
    return entities.select("entity_id").join(rolled, "entity_id", "left").select("entity_id", status.alias("status"))


def synchronise_chunks(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, document_id, is_current, status and ``action`` of a document's chunks after its text was split anew.

    ``stored``: id, document_id, is_current, status; ``wanted``: id, document_id.  Wanted chunks are
    current and ready (insert, or refresh if they were stored), current ones of the same documents that
    aren't wanted become stale (retire), all others stay (untouched).
    """
    touched = wanted.select("document_id").distinct().withColumn("_d", F.lit(True))
    s = stored.select("id", F.col("document_id").alias("_sd"), F.col("is_current").alias("_c"), F.col("status").alias("_s"))
    rows = s.join(wanted.select("id", F.col("document_id").alias("_wd")), "id", "full_outer").withColumn("document_id", F.coalesce("_wd", "_sd")).join(touched, "document_id", "left")
    asked = F.col("_wd").isNotNull()
    action = F.when(asked & F.col("_sd").isNull(), "insert").when(asked, "refresh").when(F.col("_d") & F.col("_c"), "retire").otherwise("untouched")
    rows = rows.withColumn("action", action)
    gone = F.col("action") == "retire"
    return rows.select("id", "document_id", F.when(asked, True).when(gone, False).otherwise(F.col("_c")).alias("is_current"), F.when(asked, "ready").when(gone, "stale").otherwise(F.col("_s")).alias("status"), "action")


def activated(documents: DataFrame, staged_ids: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Documents after staged versions whose every chunk is ready took over; the others keep serving."""
    per = chunks.join(staged_ids.select("document_id"), "document_id", "left_semi").groupBy("document_id").agg(F.bool_and(F.col("status") == "ready").alias("all_ready"))
    taking = documents.join(per.where("all_ready").select(F.col("document_id").alias("id")), "id", "left_semi").select(*keys, F.col("id").alias("_new"))
    joined = documents.join(taking, keys, "left")
    current = F.when(F.col("_new").isNull(), F.col("is_current")).otherwise(F.col("id") == F.col("_new"))
    return joined.select("id", *keys, current.alias("is_current"))


def violations(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """key and ``constraint`` of every row check that is false (a check that is null holds)."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in checks.items())))
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(failed).alias("constraint"))


def duplicates(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The keys that occur more than once, as violations of a uniqueness constraint."""
    return rows.groupBy(*keys).count().where("count > 1").select(F.concat_ws(":", *(F.col(k).cast("string") for k in keys)).alias("key"), F.lit(name).alias("constraint"))


def orphans(rows: DataFrame, key: str, parent: DataFrame, parent_key: str, own: str, name: str) -> DataFrame:
    """Rows whose reference names no parent, as violations."""
    return rows.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti").select(F.col(own).cast("string").alias("key"), F.lit(name).alias("constraint"))
