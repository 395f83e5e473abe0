"""Catalogue records: the valid ones as rows, the others with the reason they fail.

Blocks of records are parsed together on a columnar path: one regular expression over the whole
block for the quoting, Arrow's CSV reader for the fields, vectorised checks for the values, each with
one answer for all.  A block that fails any of them is halved, and its halves are tried again, until
what fails is a single record; that is diagnosed by a strict scanner, which has the last word.  Fields
read once are halved without being read again.  A block without bad records costs a few vector
calls, a bad record about log2(block) of them.  Records are independent rows, so nothing is shuffled.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberquill.session import count_at_most

#: The catalogue's columns in order.
HEADER = [
    "pokedex_number", "name_zh", "name_en", "type_zh", "type_1", "type_2", "category_zh", "genus", "description_zh", "flavor_text_en", "analysis_text", "image_url", "sprite_url",
    "hp", "attack", "defense", "sp_attack", "sp_defense", "speed", "base_stat_total", "height_m", "weight_kg", "abilities", "hidden_ability", "generation", "is_legendary",
    "is_mythical", "is_baby", "color", "shape", "egg_groups", "habitat", "growth_rate", "capture_rate", "is_outlier", "lof_outlier", "scaled_hp", "scaled_attack",
    "scaled_defense", "scaled_sp_attack", "scaled_sp_defense", "scaled_speed", "scaled_height_m", "scaled_weight_kg",
]
STATS = ("hp", "attack", "defense", "sp_attack", "sp_defense", "speed")
CHECKED = ("type_1", "generation", *STATS, "base_stat_total")
#: The nine generations, compared without case.
GENERATIONS = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]

#: Records parsed together.
BLOCK = 4096
#: Types that may be sent to the workers.
FEW_TYPES = 10_000
#: Between records of a block; one that holds it is diagnosed alone.
APART = "\x1e"
FIELD = rf'(?:[^",{APART}]*|"(?:[^"{APART}]|"")*")'
STRICT = rf"\A{FIELD}(?:[,{APART}]{FIELD})*\z"
GENERATION = rf"(?i)\Agen-(?:{'|'.join(GENERATIONS)})\z"
WHOLE = r"\A\+?[0-9]+(?:\.0+)?\z"
#: What the columnar path takes for a whole number: digits that can't overflow a sum.
SHORT = r"\A\+?[0-9]{1,15}(?:\.0+)?\z"


def block_fields(lines: list[str]) -> pa.Table | None:
    """The fields of a block of records, and those that are checked also trimmed; None if the quoting or the number of fields of any is wrong."""
    if not pc.match_substring_regex(pa.array([APART.join(lines)], pa.large_string()), STRICT)[0].as_py() or any(APART in line for line in lines):
        return None
    body = ("\n".join(lines) + "\n").encode()
    try:
        fields = csv.read_csv(
            io.BytesIO(body),
            read_options=csv.ReadOptions(column_names=HEADER, use_threads=False, block_size=len(body) + 1),
            parse_options=csv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False),
            convert_options=csv.ConvertOptions(column_types=dict.fromkeys(HEADER, pa.string()), strings_can_be_null=False, quoted_strings_can_be_null=False),
        )
    except pa.ArrowInvalid:
        return None
    if fields.num_rows != len(lines):
        return None
    for c in CHECKED:
        fields = fields.append_column(f"{c} trimmed", pc.utf8_trim_whitespace(fields[c]))
    return fields


def plausible(fields: pa.Table, types: pa.Array) -> bool:
    """Whether all records of a block have valid values."""
    value = lambda c: fields[f"{c} trimmed"]
    every = lambda mask: pc.all(mask, min_count=0).as_py()
    if not every(pc.is_in(value("type_1"), value_set=types)) or not every(pc.match_substring_regex(value("generation"), GENERATION)):
        return False
    numbers = [value(c) for c in (*STATS, "base_stat_total")]
    if not all(every(pc.match_substring_regex(n, SHORT)) for n in numbers):
        return False
    *stats, total = (pc.cast(pc.replace_substring_regex(n, r"\A\+|\.0+\z", ""), pa.int64()) for n in numbers)
    summed = stats[0]
    for s in stats[1:]:
        summed = pc.add(summed, s)
    return every(pc.equal(summed, total))


def scan_fields(line: str) -> list[str] | None:
    """The fields of one record by a strict scanner; None if its quoting is wrong."""
    out, at, size = [], 0, len(line)
    while True:
        if at < size and line[at] == '"':
            value, at = [], at + 1
            while True:
                end = line.find('"', at)
                if end < 0:
                    return None
                value.append(line[at:end])
                if line[end + 1 : end + 2] != '"':
                    at = end + 1
                    break
                value.append('"')
                at = end + 2
            out.append("".join(value))
        else:
            end = line.find(",", at)
            end = size if end < 0 else end
            if '"' in line[at:end]:
                return None
            out.append(line[at:end])
            at = end
        if at == size:
            return out
        if line[at] != ",":
            return None
        at += 1


def diagnose(line: str, types: set[str]) -> tuple[str | None, list[str] | None]:
    """(reason, None) of a bad record, (None, fields) of a valid one."""
    fields = scan_fields(line)
    if fields is None:
        return "quoting", None
    if len(fields) != len(HEADER):
        return "column_count", None
    value = dict(zip(HEADER, (f.strip() for f in fields)))
    if value["type_1"] not in types:
        return "type_1", None
    if not re.search(GENERATION.replace(r"\z", r"\Z"), value["generation"]):
        return "generation", None
    whole = re.compile(WHOLE.replace(r"\z", r"\Z"))
    numbers = [value[c] for c in (*STATS, "base_stat_total")]
    if not all(whole.match(n) for n in numbers):
        return "base_stat_total", None
    *stats, total = [int(n.split(".")[0]) for n in numbers]
    return (None, fields) if sum(stats) == total else ("base_stat_total", None)


def _parse(types: list[str], with_fields: bool):
    known, names = set(types), pa.array(types, pa.string())

    def solve(keys: list, lines: list[str], fields: pa.Table | None, out: list) -> None:
        if len(lines) == 1:
            reason, values = diagnose(lines[0], known)
            out.append((keys[0], reason, values if with_fields else None))
            return
        if fields is None:
            fields = block_fields(lines)
        if fields is not None and plausible(fields, names):
            values = zip(*(fields[c].to_pylist() for c in HEADER)) if with_fields else [None] * len(keys)
            out.extend((k, None, v) for k, v in zip(keys, values))
        else:
            half = len(lines) // 2
            solve(keys[:half], lines[:half], fields and fields.slice(0, half), out)
            solve(keys[half:], lines[half:], fields and fields.slice(half), out)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("raw_id").to_pylist()
            lines = [(t[:-1] if t.endswith("\r") else t) if t else "" for t in batch.column("raw_line").to_pylist()]
            for at in range(0, len(keys), BLOCK):
                out: list = []
                solve(keys[at : at + BLOCK], lines[at : at + BLOCK], None, out)
                cols = [[k for k, _, _ in out], [r for _, r, _ in out], [list(v) if v is not None else None for _, _, v in out]]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.string()))], ["raw_id", "reason", "fields"])

    return parse


def parse_records(raw: DataFrame, types: DataFrame, *, with_fields: bool = True) -> DataFrame:
    """Every record (not headers, ``line_no`` 1) with ``raw_id``, ``reason`` (null if valid) and ``fields`` (null if not).

    ``raw``: raw_id, line_no, raw_line; ``types``: name_en; other columns are ignored.  Reasons, in
    the order they are tried: quoting, column_count, type_1, generation, base_stat_total.

    Defined cases: a null or empty record has one empty field, so its column count is wrong; a null
    line number is no header; repeated records are judged each; without types every record fails on
    ``type_1``; an empty table gives no rows.
    """
    wanted = types.select("name_en").where(F.col("name_en").isNotNull()).distinct()
    if count_at_most(wanted, FEW_TYPES) > FEW_TYPES:
        raise ValueError(f"more than {FEW_TYPES} types")
    names = sorted(r[0] for r in wanted.collect())
    rows = raw.where(F.coalesce("line_no", F.lit(0)) != 1).select(F.col("raw_id").cast("long").alias("raw_id"), "raw_line")
    return rows.mapInArrow(_parse(names, with_fields), "raw_id bigint, reason string, fields array<string>")


def rejected(parsed: DataFrame) -> DataFrame:
    """raw_id and reason of the records that fail."""
    return parsed.where(F.col("reason").isNotNull()).select("raw_id", "reason")


def valid(parsed: DataFrame) -> DataFrame:
    """raw_id and the named columns of the valid records, as strings."""
    return parsed.where(F.col("reason").isNull()).select("raw_id", *(F.col("fields")[i].alias(c) for i, c in enumerate(HEADER)))
