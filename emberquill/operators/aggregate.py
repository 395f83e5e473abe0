"""Catalogue rows as typed, nested aggregates with their errors, and rules on nested payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberquill.functions import text as T
from emberquill.operators.records import STATS

#: Types that may become literals of a plan.
FEW_TYPES = 1_000
#: Decimal columns, scaled columns and source texts (field, language, kind).
SCALED = ("scaled_hp", "scaled_attack", "scaled_defense", "scaled_sp_attack", "scaled_sp_defense", "scaled_speed", "scaled_height_m", "scaled_weight_kg")
TEXTS = (("description_zh", "zh-Hant", "description"), ("flavor_text_en", "en", "flavor"), ("analysis_text", "mul", "analysis"))


def _error(ok: Column, field: str, message: str) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))


def nested(rows: DataFrame, types: DataFrame) -> DataFrame:
    """source_row, entity, type_codes, stats, descriptions, images and ``errors`` (empty if the row is valid).

    ``types`` (code, name_en, name_zh) is a small fixed table; the Chinese types must be those of
    the English ones in order, separated by commas of either width, or be blank for a lone Normal.
    """
    known = types.select(F.lower("name_en"), "code", "name_zh").limit(FEW_TYPES + 1).collect()
    if len(known) > FEW_TYPES:
        raise ValueError(f"more than {FEW_TYPES} types")
    table = F.array(*(F.struct(F.lit(en).alias("en"), F.lit(code).cast("string").alias("code"), F.lit(zh).cast("string").alias("name_zh")) for en, code, zh in known or [("", None, None)]))
    find = lambda name: F.get(F.filter(table, lambda t: t["en"] == F.lower(name)), F.lit(0))
    given = F.array_compact(F.array(T.optional("type_1"), T.optional("type_2")))
    codes = F.transform(given, lambda g: find(g)["code"])
    chinese = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce("type_zh", F.lit("")), "，", ","), ","), lambda s: T.stripped(s)), lambda s: s != "")
    expected = F.transform(given, lambda g: find(g)["name_zh"])
    stats = {c: T.whole_number(c) for c in (*STATS, "base_stat_total")}
    total = sum((stats[c] for c in STATS[1:]), stats[STATS[0]])
    scaled = {c: T.finite_number(c) for c in SCALED}
    checks = [
        *(_error(v.between(0, 32767), c, "not a whole number in range") for c, v in stats.items()),
        *(_error(v.isNotNull(), c, "not a finite number") for c, v in scaled.items()),
        _error(total == stats["base_stat_total"], "base_stat_total", "not the sum of the six stats"),
        _error(T.generation_number("generation").isNotNull(), "generation", "unknown"),
        *(_error(T.truth(c).isNotNull(), c, "neither true nor false") for c in ("is_legendary", "is_mythical", "is_baby")),
        *(_error(T.whole_number(c).isin(-1, 1), c, "neither 1 nor -1") for c in ("is_outlier", "lof_outlier")),
        *(_error(T.finite_number(c) >= 0, c, "not a finite number from 0") for c in ("height_m", "weight_kg")),
        _error((F.size(codes) > 0) & ~F.exists(codes, lambda c: c.isNull()), "type_1", "unknown"),
        _error((chinese == expected) | ((F.size(chinese) == 0) & (expected == F.array(F.lit("一般")))), "type_zh", "not the types in Chinese"),
        *(_error(T.web_address(c), c, "no plain web address") for c in ("image_url", "sprite_url")),
        *(_error(T.stripped(F.coalesce(c, F.lit(""))) != "", c, "blank") for c in ("name_zh", "name_en")),
    ]
    texts = [F.when(T.optional(c).isNotNull(), F.struct(F.lit(lang).alias("language_code"), F.lit(kind).alias("description_kind"), F.lit(c).alias("source_key"), T.stripped(c).alias("content"), T.content_hash(c).alias("content_hash"), F.lit(kind == "description").alias("is_primary"))) for c, lang, kind in TEXTS]
    images = [F.when(T.web_address(c), F.struct(F.lit(kind).alias("image_kind"), F.col(c).alias("image_url"), F.lit(kind == "artwork").alias("is_primary"))) for c, kind in (("image_url", "artwork"), ("sprite_url", "sprite"))]
    return rows.select(
        "source_row",
        F.struct(
            T.whole_number("pokedex_number").alias("number"), T.stripped("name_zh").alias("name_zh"), T.stripped("name_en").alias("name_en"), T.generation_number("generation").alias("generation"), T.finite_number("height_m").cast("decimal(6,2)").alias("height_m"),
            T.finite_number("weight_kg").cast("decimal(8,2)").alias("weight_kg"), *(T.truth(c).alias(c) for c in ("is_legendary", "is_mythical", "is_baby")), *(T.optional(c).alias(c) for c in ("habitat", "growth_rate", "color", "shape")),
        ).alias("entity"),
        codes.alias("type_codes"),
        F.struct(*(v.alias(c) for c, v in {**stats, **scaled}.items())).alias("stats"),
        F.array_compact(F.array(*texts)).alias("descriptions"),
        F.array_compact(F.array(*images)).alias("images"),
        F.array_compact(F.array(*checks)).alias("errors"),
    )


def payload_problems(rows: DataFrame, key: str) -> DataFrame:
    """key and ``problem`` of payloads whose children repeat: types, descriptions, primary_description, image_kinds, primary_image.

    ``rows``: type_codes (array), descriptions and images as ``nested`` makes them.  A source key
    counts without its ``csv:`` prefix; one description a language and kind may be primary.
    """
    repeated = lambda a: F.size(F.array_distinct(a)) < F.size(a)
    sources = F.transform("descriptions", lambda d: F.struct(d["language_code"], d["description_kind"], F.regexp_replace(d["source_key"], "^csv:", "")))
    primary = F.transform(F.filter("descriptions", lambda d: d["is_primary"]), lambda d: F.struct(d["language_code"], d["description_kind"]))
    rules = {
        "types": repeated(F.col("type_codes")), "descriptions": repeated(sources), "primary_description": repeated(primary),
        "image_kinds": repeated(F.transform("images", lambda i: i["image_kind"])), "primary_image": F.size(F.filter("images", lambda i: i["is_primary"])) > 1,
    }
    return rows.select(key, F.explode(F.array_compact(F.array(*(F.when(ok, F.lit(n)) for n, ok in rules.items())))).alias("problem"))


def switched(models: DataFrame, chosen) -> DataFrame:
    """Models with the chosen one active and no other."""
    return models.withColumn("is_active", F.coalesce(F.col("id") == F.lit(chosen), F.lit(False)))


def case_view(cases: DataFrame, grades: DataFrame, finals: DataFrame) -> DataFrame:
    """One row a case and candidate with its grades as an ordered list of annotator and grade, and the final grade; set-based, not a query a case."""
    lists = grades.groupBy("case_id", "pokemon_id").agg(F.sort_array(F.collect_list(F.struct("annotator", "grade"))).alias("grades"))  # one an annotator
    return cases.select("case_id", "query").join(lists, "case_id").join(finals.select("case_id", "pokemon_id", "final_grade"), ["case_id", "pokemon_id"], "left")
