"""Grounded explanations: evidence packets, local templates, and checks of generated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberquill.functions import text as T


def evidence_id(chunk_id) -> Column:
    """ev_ and the chunk's identifier without hyphens."""
    return F.concat(F.lit("ev_"), F.regexp_replace(chunk_id, "-", ""))


def excerpt(c, longest: int = 240) -> Column:
    return F.substring(c, 1, longest)


def packet(rows: DataFrame, key: str, fields: list[str], order: list[str]) -> DataFrame:
    """key and ``packet``: the evidence of each entity as compact JSON, in a fixed order."""
    items = F.sort_array(F.collect_list(F.struct(*order, *(f for f in fields if f not in order))))
    return rows.groupBy(key).agg(F.to_json(items).alias("packet"))


def canonical_json(rows: DataFrame, columns: list[str]) -> Column:
    """A row as compact JSON with its keys in order; equal rows give equal text."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


#: The sentences of local explanations; {} stands for what is told.
SENTENCES = {
    "traits": "你的描述呈現出{}的個性傾向。",
    "no_traits": "這次以你的個性描述比較寶可夢的行為資料。",
    "type": "你選填的 {} 也作為配對參考。",
    "summary": "圖鑑資料呈現出{}",
    "own_traits": "整體帶有{}的特質",
    "foreign": "目前可引用的資料以外文為主，詳細行為請參考下方證據。",
    "shared": "你的描述與牠的資料都提到{}，這是這次配對的相似之處。",
    "apart": "你提到{}，牠的資料則呈現{}；兩者也保留了不同的行為特色。",
    "neither": "這份結果是行為與文字關聯的參考，你可以對照證據判斷是否符合自己的感受。",
    "nameless": "這隻寶可夢",
    "today": "今天的{}訊號偏向{}。",
    "signal": "{}替這段節奏加入另一層參考。",
    "today_summary": "{}在圖鑑資料中呈現出{}。",
    "today_traits": "{}帶有{}的性格特質。",
    "today_end": "兩者在今日的節奏上形成呼應，因此成為這個時辰的代表寶可夢。",
    "no_sign": "今日星座",
    "steady": "穩定前進",
    "vivid": "鮮明",
}


def _say(sentence: str, *values: Column) -> Column:
    parts = SENTENCES[sentence].split("{}")
    return F.concat(*(x for pair in zip(map(F.lit, parts), [*values, F.lit("")]) for x in pair))


def _joined(values: Column, most: int = 3) -> Column:
    return F.array_join(F.slice(values, 1, most), "、")


def _named(name: Column) -> Column:
    return F.coalesce(F.nullif(T.stripped(name), F.lit("")), F.lit(SENTENCES["nameless"]))


def local_text(name: Column, asked: Column, own: Column, summary: Column, selected: Column) -> Column:
    """The explanation made without a provider: what the asker told, what the entity's evidence tells, and what both share.

    ``asked`` and ``own``: arrays of traits (only distinct ones with an ideograph count, three at most);
    ``summary``: a Chinese summary, maybe empty; ``selected``: a four-letter code or null.
    """
    asked, own = T.ideographic_traits(F.coalesce(asked, F.array())), T.ideographic_traits(F.coalesce(own, F.array()))
    ends = F.regexp_replace(F.coalesce(summary, F.lit("")), "[。！？；]+$", "")
    teller = F.when(F.size(asked) > 0, _say("traits", _joined(asked))).otherwise(F.lit(SENTENCES["no_traits"]))
    teller = F.concat(teller, F.when(selected.isNotNull(), _say("type", selected)).otherwise(F.lit("")))
    parts = F.array_compact(F.array(F.when(F.coalesce(summary, F.lit("")) != "", _say("summary", ends)), F.when(F.size(own) > 0, _say("own_traits", _joined(own)))))
    told = F.when(F.size(parts) > 0, F.concat(_named(name), F.array_join(parts, "，"), F.lit("。"))).otherwise(F.concat(_named(name), F.lit(SENTENCES["foreign"])))
    shared = F.filter(asked, lambda t: F.array_contains(own, t))
    fit = F.when(F.size(shared) > 0, _say("shared", _joined(shared))).when((F.size(asked) > 0) & (F.size(own) > 0), _say("apart", _joined(asked, 2), _joined(own, 2))).otherwise(F.lit(SENTENCES["neither"]))
    return F.concat(teller, told, fit)


def daily_text(name: Column, sign: Column, traits: Column, signals: Column, summary: Column, own: Column) -> Column:
    """The explanation of a day's choice: the sign's traits and the last signal, the entity's summary or traits, and a closing sentence."""
    traits, own = T.ideographic_traits(F.coalesce(traits, F.array())), T.ideographic_traits(F.coalesce(own, F.array()))
    opening = _say("today", F.coalesce(sign, F.lit(SENTENCES["no_sign"])), F.coalesce(F.nullif(_joined(traits), F.lit("")), F.lit(SENTENCES["steady"])))
    last = F.when(F.size(F.coalesce(signals, F.array())) > 0, _say("signal", F.element_at(signals, -1))).otherwise(F.lit(""))
    ends = F.regexp_replace(F.coalesce(summary, F.lit("")), "[。！？；]+$", "")
    told = F.when(F.coalesce(summary, F.lit("")) != "", _say("today_summary", _named(name), ends)).otherwise(_say("today_traits", _named(name), F.coalesce(F.nullif(_joined(own), F.lit("")), F.lit(SENTENCES["vivid"]))))
    return F.concat(opening, last, told, F.lit(SENTENCES["today_end"]))


def entity_tag(source: Column, version: Column, revision: Column, content_hash: Column) -> Column:
    """The tag of a published catalogue: source, version, revision and the first sixteen letters of its hash, in double quotes."""
    return F.format_string('"%s-%s-r%d-%s"', source, version, revision, F.substring(content_hash, 1, 16))


def daily_query(sign: Column, solar_date: Column, lunar_date: Column, term: Column, branch: Column, terms: Column, types: Column) -> Column:
    """The text a day's choice is retrieved by: the same for the same calendar, terms and types."""
    heads = F.array(F.concat(F.lit("今日"), sign, F.lit("代表寶可夢")), F.concat(F.lit("國曆"), solar_date), F.concat(F.lit("農曆"), lunar_date), F.concat(term, branch, F.lit("時")))
    return F.array_join(F.concat(heads, terms, types), " ")


def problems(explanations: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """key and ``problem`` of explanations that break a rule.

    ``explanations``: key, text, citations, selected (a four-letter code or null); ``allowed``: key,
    evidence_ids.  Problems: missing, duplicate_entity, unknown_entity, duplicate_citation,
    foreign_citation, not_chinese, foreign_code.
    """
    counted = explanations.groupBy(key).agg(F.count("*").alias("_n"))
    joined = explanations.join(counted, key).join(allowed.select(key, "evidence_ids"), key, "left")
    codes = F.transform(F.regexp_extract_all(F.upper(T.compatible("text")), F.lit(r"(?<![A-Z])([EI][SN][TF][JP])(?:-[AT])?(?![A-Z])"), 1), lambda c: c)
    rules = {
        "duplicate_entity": F.col("_n") > 1,
        "unknown_entity": F.col("evidence_ids").isNull(),
        "duplicate_citation": F.size(F.array_distinct("citations")) < F.size("citations"),
        "foreign_citation": F.size(F.array_except("citations", F.coalesce("evidence_ids", F.array().cast("array<string>")))) > 0,
        "not_chinese": ~T.chinese_prose("text"),
        "foreign_code": F.exists(codes, lambda c: ~c.eqNullSafe(F.col("selected"))),
    }
    found = joined.select(key, F.explode(F.array_compact(F.array(*(F.when(ok, F.lit(name)) for name, ok in rules.items())))).alias("problem")).distinct()
    missing = allowed.select(key).distinct().join(explanations.select(key), key, "left_anti").select(key, F.lit("missing").alias("problem"))
    return found.unionByName(missing)
