"""Queries of the general data operators (rows that fail to parse, packed fields), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberquill.operators import packed, records
from emberquill.session import table


def _parsed(spark: SparkSession, d: str, with_fields: bool) -> DataFrame:
    return records.parse_records(table(spark, d, "pokedex_final_raw"), table(spark, d, "type_definitions"), with_fields=with_fields)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return records.rejected(_parsed(spark, d, False))


def p1_valid(spark: SparkSession, d: str) -> DataFrame:
    return records.valid(_parsed(spark, d, True))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return packed.split_values(table(spark, d, "pokedex_final"), ["source_row"], ["abilities", "egg_groups", "type_zh"], blank_fields=("type_zh",))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).where("values > 1").select("source_row", "field", "pos", "val")


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d)


QUERIES = {f.__name__: f for f in (p1_found, p1_valid, p3_found, p3_values)}

_F = '(?:"(?:[^"]|"")*"|[^",]*)'


def _nth(n: int) -> str:
    return f"""trim(regexp_replace(regexp_extract(l, '^(?:{_F},){{{n}}}({_F})', 1), '^"|"$', '', 'g'))"""


_SUM = " + ".join(f"try_cast({_nth(n)} AS DOUBLE)" for n in range(13, 19))
_VALUES = r"""
WITH f AS (
  SELECT source_row, 'abilities' AS field, abilities AS t, '[^,，、;；|｜/／\t\n\r]+' AS bare FROM pokedex_final
  UNION ALL SELECT source_row, 'egg_groups', egg_groups, '[^,，、;；|｜/／\t\n\r]+' FROM pokedex_final
  UNION ALL SELECT source_row, 'type_zh', type_zh, '[^,，、;；|｜/／\s\x{3000}\x{2000}-\x{200A}\x{A0}\x{202F}]+' FROM pokedex_final),
g AS (SELECT source_row, field, bare, regexp_replace(regexp_replace(t, '^\s*\[', ''), '\]\s*$', '') AS t FROM f),
x AS (SELECT source_row, field, list_filter(list_transform(regexp_extract_all(t, '\s*"(?:[^"]|"")*"|\s*“[^”]*”|\s*「[^」]*」|' || bare),
  lambda v: regexp_replace(replace(regexp_replace(regexp_replace(v, '^[\s\x{3000}\x{2000}-\x{200A}\x{A0}\x{202F}]+|[\s\x{3000}\x{2000}-\x{200A}\x{A0}\x{202F}]+$', '', 'g'), '^["“「]|["”」]$', '', 'g'), '""', '"'), '^\s+|\s+$', '', 'g')), lambda v: v <> '') AS vs FROM g)
"""
SQL = {
    "p1_found": f"""
WITH r AS (SELECT raw_id, regexp_replace(coalesce(raw_line, ''), '\\r$', '') AS l FROM pokedex_final_raw WHERE line_no IS DISTINCT FROM 1),
s AS (SELECT *, regexp_full_match(l, '{_F}(,{_F})*') AS strict, regexp_replace(l, '"(?:[^"]|"")*"', 'q', 'g') AS bare FROM r),
j AS (SELECT raw_id, CASE
  WHEN NOT strict THEN 'quoting'
  WHEN length(bare) - length(replace(bare, ',', '')) <> 43 THEN 'column_count'
  WHEN {_nth(4)} NOT IN (SELECT name_en FROM type_definitions) THEN 'type_1'
  WHEN NOT regexp_full_match(lower({_nth(24)}), 'gen-(i|ii|iii|iv|v|vi|vii|viii|ix)') THEN 'generation'
  WHEN NOT regexp_full_match({_nth(19)}, '\\+?[0-9]+(\\.0+)?') OR coalesce({_SUM} <> try_cast({_nth(19)} AS DOUBLE), true) THEN 'base_stat_total'
  END AS reason FROM s)
SELECT raw_id, reason FROM j WHERE reason IS NOT NULL
""",
    "p3_found": _VALUES + "SELECT source_row, field, unnest(range(1, len(vs) + 1))::INTEGER AS pos, unnest(vs) AS val FROM x WHERE len(vs) > 1",
    "p3_values": _VALUES + "SELECT source_row, field, unnest(range(1, len(vs) + 1))::INTEGER AS pos, unnest(vs) AS val, NULL::VARCHAR AS error, len(vs)::INTEGER AS values FROM x",
}

SQL["p1_valid"] = (
    SQL["p1_found"].rsplit("SELECT raw_id, reason FROM j", 1)[0]
    + "SELECT s.raw_id, "
    + ", ".join(f"""(CASE WHEN starts_with(f{n}, '"') THEN replace(f{n}[2:-2], '""', '"') ELSE f{n} END) AS {c}""" for n, c in enumerate(records.HEADER))
    + " FROM j JOIN (SELECT raw_id, "
    + ", ".join(f"regexp_extract(l, '^(?:{_F},){{{n}}}({_F})', 1) AS f{n}" for n in range(len(records.HEADER)))
    + " FROM s WHERE strict) s USING (raw_id) WHERE reason IS NULL"
)
