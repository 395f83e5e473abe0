"""Catalogue queries: search, pages, child assembly, localisation, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberquill.functions import text as T
from emberquill.session import materialise


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last delivered row of every key; nulls in ``order`` come first."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *(F.col("_r")[c].alias(c) for c in rest)).select(rows.columns)


def like_text(c: str, text: str) -> Column:
    """Case-insensitive substring match; wildcards in ``text`` are ordinary characters."""
    escaped = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return F.col(c).ilike(f"%{escaped}%")


def search(entities: DataFrame, *, names: list[str], text: str | None = None, equal: dict | None = None) -> DataFrame:
    """Rows whose name holds ``text`` and whose columns equal the given values; None asks for nothing."""
    out = entities
    if text:
        match = like_text(names[0], text)
        for n in names[1:]:
            match = match | like_text(n, text)
        out = out.where(match)
    for c, v in (equal or {}).items():
        if v is not None:
            out = out.where(F.col(c) == v)
    return out


def having_type(entities: DataFrame, bridge: DataFrame, types: DataFrame, wanted: str) -> DataFrame:
    """Entities of a type given by code or English name in any case, or by its exact Chinese name."""
    low = wanted.lower()
    hit = types.where((F.lower("code") == low) | (F.lower("name_en") == low) | (F.col("name_zh") == wanted)).select("code")
    return entities.join(bridge.join(hit, "code").select("entity_id").distinct(), "entity_id", "left_semi")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of a total order, numbered from 1."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("pages are numbered from 1 and hold 1 to 100 rows")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_totals(rows: DataFrame, size: int) -> DataFrame:
    """One row: the number of rows and of pages."""
    return rows.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("bigint"))


def children(rows: DataFrame, key: str, order: list[str], fields: list[str], name: str) -> DataFrame:
    """key and ``name``: its child rows as ordered structs; children of one parent are few by nature."""
    items = F.sort_array(F.collect_list(F.struct(*order, *(f for f in fields if f not in order))))
    return rows.groupBy(key).agg(items.alias(name))


def pivoted(rows: DataFrame, key: str, by: str, value: str, names: list) -> DataFrame:
    """key and one column a name: the value of the child row so named, null without one."""
    return rows.groupBy(key).agg(*(F.max(F.when(F.col(by) == n, F.col(value))).alias(str(n)) for n in names))


def localised(rows: DataFrame, keys: list[str], column: str, terms: DataFrame) -> DataFrame:
    """keys, place, code and name_zh of every code of a list; unknown codes keep their raw form and say so.

    ``terms``: code (normal form), name_zh.
    """
    codes = rows.select(*keys, F.posexplode(T.split_codes(F.col(column))).alias("place", "raw")).withColumn("code", T.normal_code("raw"))
    joined = codes.join(terms.select("code", "name_zh"), "code", "left")
    return joined.select(*keys, "place", F.when(F.col("name_zh").isNull(), F.col("raw")).otherwise(F.col("code")).alias("code"), F.coalesce("name_zh", F.lit("未收錄")).alias("name_zh"))


def hidden_abilities(rows: DataFrame, keys: list[str], abilities: str, hidden: str) -> DataFrame:
    """keys, place, code and is_hidden: the listed abilities, the hidden one added at the end if it isn't listed."""
    listed, extra = T.split_codes(F.col(abilities)), F.when(T.stripped(F.coalesce(hidden, F.lit(""))) != "", T.stripped(hidden))
    known = F.exists(listed, lambda a: T.normal_code(a) == T.normal_code(extra))
    every = F.when(extra.isNotNull() & ~known, F.concat(listed, F.array(extra))).otherwise(listed)
    return rows.select(*keys, extra.alias("_h"), F.posexplode(every).alias("place", "raw")).select(*keys, "place", T.normal_code("raw").alias("code"), F.coalesce(T.normal_code("raw") == T.normal_code("_h"), F.lit(False)).alias("is_hidden"))


def hash_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows in the order of the key's MD5: the same rows every time."""
    return rows.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def even_sample(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """``n`` rows spread evenly over a total order, its ends included; all rows if they are fewer.

    Places are found from sorted partitions and their sizes, so no single task sees all rows; the
    partitions are written first, as their bounds are drawn anew by every run.
    """
    total = rows.count()
    if total <= n or n < 2:
        return rows if total <= n else rows.orderBy(*order).limit(n)
    wanted = sorted({int(i * (total - 1) / (n - 1) + 0.5) for i in range(n)})
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ranged = materialise(ranged, "ranged")
    sizes = {r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # one a partition
    start, base = 0, F.lit(0)
    for p in sorted(sizes):
        base = F.when(F.col("_p") == p, F.lit(start)).otherwise(base)
        start += sizes[p]
    return ranged.where((base + F.col("_i")).isin(wanted)).drop("_p", "_i")


def contract(entities: DataFrame, bridge: DataFrame, types: DataFrame, descriptions: DataFrame, images: DataFrame) -> DataFrame:
    """One flat row an entity: its own columns, types by slot, descriptions by source and images by kind.

    ``bridge``: entity_id, slot, code; ``types``: code, name_en, name_zh; ``descriptions``: entity_id,
    source_key (with or without ``csv:``), content; ``images``: entity_id, image_kind, image_url.
    Missing types, hidden abilities and habitats are ``Unknown``, other missing texts empty.
    """
    named = bridge.join(types.select("code", "name_en", "name_zh"), "code")
    slots = named.groupBy("entity_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slot", "name_zh"))), lambda t: t["name_zh"]), ", ").alias("type_zh"),  # two an entity
        *(F.max(F.when(F.col("slot") == n, F.col("name_en"))).alias(f"type_{n}") for n in (1, 2)),
    )
    sources = ["description_zh", "flavor_text_en", "analysis_text"]
    told = pivoted(descriptions.withColumn("source_key", F.regexp_replace("source_key", "^csv:", "")), "entity_id", "source_key", "content", sources)
    shown = pivoted(images, "entity_id", "image_kind", "image_url", ["artwork", "sprite"]).withColumnsRenamed({"artwork": "image_url", "sprite": "sprite_url"})
    out = entities
    for child in (slots, told, shown):
        out = out.join(child, "entity_id", "left")
    unknown = [c for c in ("type_1", "type_2", "hidden_ability", "habitat") if c in out.columns]
    empty = [c for c in ("type_zh", "category_zh", "genus", *sources, "image_url", "sprite_url", "color", "shape", "growth_rate") if c in out.columns]
    return out.withColumns({**{c: F.coalesce(F.nullif(c, F.lit("")), F.lit("Unknown")) for c in unknown}, **{c: F.coalesce(c, F.lit("")) for c in empty}})


def metadata(entities: DataFrame, bridge: DataFrame, types: DataFrame, images: DataFrame) -> DataFrame:
    """Display fields only: entity_id, names, category, genus, type names and both images; what is missing is empty."""
    named = bridge.join(types.select("code", "name_en", "name_zh"), "code")
    slots = named.groupBy("entity_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slot", "name_zh"))), lambda t: t["name_zh"]), ", ").alias("type_zh"),
        *(F.max(F.when(F.col("slot") == n, F.col("name_en"))).alias(f"type_{n}") for n in (1, 2)),
    )
    shown = pivoted(images, "entity_id", "image_kind", "image_url", ["artwork", "sprite"]).withColumnsRenamed({"artwork": "image_url", "sprite": "sprite_url"})
    out = entities.select("entity_id", "name_zh", "name_en", "category_zh", "genus").join(slots, "entity_id", "left").join(shown, "entity_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in out.columns if c not in ("entity_id", "name_zh", "name_en")})


def image_order(images: DataFrame) -> DataFrame:
    """entity_id, image_id, image_kind, image_url and place from 1: the primary image first, then by kind and number."""
    order = Window.partitionBy("entity_id").orderBy(F.coalesce("is_primary", F.lit(False)).cast("int").desc(), "image_kind", "image_id")
    return images.select("entity_id", "image_id", "image_kind", "image_url", F.row_number().over(order).alias("place"))


def with_state(rows: DataFrame, state: DataFrame, column: str) -> DataFrame:
    """Rows with a column of a one-row table added to each; ValueError unless it has exactly one row."""
    found = state.select(column).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"the state has {'no row' if not found else 'more than one row'}")
    return rows.withColumn(column, F.lit(found[0][0]).cast(state.schema[column].dataType))


def filtered(rows: DataFrame, *, equal: dict | None = None, folded: dict | None = None, between: dict | None = None) -> DataFrame:
    """Rows whose columns equal values, equal them whatever the case and outer blanks, and lie in ranges (low, high), ends included; None asks for nothing."""
    for c, v in (equal or {}).items():
        rows = rows if v is None else rows.where(F.col(c) == F.lit(v))
    for c, v in (folded or {}).items():
        rows = rows if v is None else rows.where(T.canonical(c) == T.canonical_value(v))
    for c, (low, high) in (between or {}).items():
        rows = rows if low is None else rows.where(F.col(c) >= F.lit(low))
        rows = rows if high is None else rows.where(F.col(c) <= F.lit(high))
    return rows


def public_descriptions(documents: DataFrame, language: str = "zh-hant", kind: str = "description") -> DataFrame:
    """Documents of one language and kind, however these are written."""
    return documents.where((F.lower(T.stripped("language_code")) == language) & (F.lower(T.stripped("document_kind")) == kind))


def evidence_first(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` first rows of evidence: Chinese before others, then by score, then by number."""
    return rows.orderBy(F.when(F.lower("language_code").startswith("zh"), 0).otherwise(1), F.desc("rrf_score"), "evidence_id").limit(n)
