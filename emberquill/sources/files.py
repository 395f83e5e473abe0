"""Readers and writers: strict CSV, JSON lines, catalogues, binary files, atomic sinks, audit logs."""

from __future__ import annotations

import csv
import json
import math
import os
import tempfile
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberquill.functions.text import canonical_value, normal_code, stripped
from emberquill.session import materialise


class HeaderError(ValueError):
    """A header with missing, unexpected or repeated columns."""


def check_header(found: list[str], wanted: list[str]) -> None:
    problems = {"repeated": sorted({c for c in found if found.count(c) > 1}), "missing": [c for c in wanted if c not in found], "unexpected": [c for c in found if c not in wanted]}
    if any(problems.values()):
        raise HeaderError("; ".join(f"{k}: {', '.join(v)}" for k, v in problems.items() if v))


def read_csv(spark: SparkSession, path: str, columns: list[str], *, key: list[str] | None = None, number: str | None = None) -> DataFrame:
    """A UTF-8 CSV with exactly these columns, all strings, quoted line breaks kept; a byte order mark is dropped.

    ``number`` names a column for each record's row number, the header being row 1.  A file whose
    records may hold line breaks is read by one task, which is what makes the numbers those of the file.
    Raises HeaderError for a wrong header, ValueError for an empty file, repeated keys or a ``number`` that is a column.
    """
    head = spark.read.option("lineSep", "\n").text(path).first()
    if head is None:
        raise ValueError("the file is empty")
    check_header(next(csv.reader([head[0].lstrip("\ufeff").rstrip("\r")]), []), columns)
    if number in columns:
        raise ValueError(f"{number} is a column of the file")
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"', inferSchema=False, enforceSchema=True, schema=", ".join(f"`{c}` string" for c in columns), mode="FAILFAST")
    if number:
        raw = raw.withColumn(number, (F.monotonically_increasing_id() + 2).cast("int"))
    if raw.limit(1).count() == 0:
        raise ValueError("the file has no rows")
    if key and raw.groupBy(*key).count().where("count > 1").limit(1).count():
        raise ValueError(f"repeated {', '.join(key)}")
    return raw


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1) and line of a text file of any size.

    The file is split by bytes; a line's number is its number in its split plus the lines of the
    splits before, one count a split.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"), F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i"), F.col("_metadata.file_block_start").alias("_b"))
    rows = materialise(rows, "lines")
    sizes = rows.groupBy("_b").agg(F.count("*").alias("n"), F.min("_i").alias("first")).orderBy("_b").collect()  # one a split
    base, start = F.lit(0).cast("long"), 1
    for r in sizes:
        base = F.when(F.col("_b") == r["_b"], F.lit(start - r["first"])).otherwise(base)
        start += r["n"]
    return rows.select((base + F.col("_i")).alias("line_no"), "line")


def judged_cases(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(judgments, errors) of evaluation cases whose relevance is graded or binary.

    ``rows``: id, query, relevance (array of pokedex_number and grade) and relevant_pokedex_numbers
    (array of numbers).  judgments: id, number, grade; a binary one has grade 1.  Errors (id, error):
    no_query, both_forms, no_relevance, grade (not 1 to 3), repeated (a number judged twice).
    """
    graded, binary = F.size(F.coalesce("relevance", F.array())) > 0, F.size(F.coalesce("relevant_pokedex_numbers", F.array())) > 0
    one = F.when(graded, F.transform("relevance", lambda r: F.struct(r["pokedex_number"].cast("long").alias("number"), r["grade"].cast("int").alias("grade")))).otherwise(
        F.transform(F.coalesce("relevant_pokedex_numbers", F.array().cast("array<bigint>")), lambda n: F.struct(n.cast("long").alias("number"), F.lit(1).alias("grade")))
    )
    marked = rows.select("id", "query", one.alias("j"), graded.alias("g"), binary.alias("b"))
    error = (
        F.when(F.coalesce(F.trim("query"), F.lit("")) == "", "no_query")
        .when(F.col("g") & F.col("b"), "both_forms")
        .when(F.size("j") == 0, "no_relevance")
        .when(F.exists("j", lambda x: ~F.coalesce(x["grade"].between(1, 3), F.lit(False))), "grade")
        .when(F.size(F.array_distinct(F.transform("j", lambda x: x["number"]))) < F.size("j"), "repeated")
    )
    marked = marked.withColumn("error", error)
    good = marked.where(F.col("error").isNull()).select("id", F.explode("j").alias("j")).select("id", "j.number", "j.grade")
    return good, marked.where(F.col("error").isNotNull()).select("id", "error")


def read_jsonl(spark: SparkSession, path: str, schema: str, *, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of a JSON-lines file; errors have the file's line number from 1 and the line.

    Blank lines are neither; rows repeated by ``key`` are errors but for the first.
    """
    lines = numbered_lines(spark, path)
    parsed = lines.where(F.trim("line") != "").select("line_no", "line", F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r._bad").isNotNull() | F.col("r").isNull()
    fine = parsed.where(~bad)
    errors = parsed.where(bad).select("line_no", "line", F.lit("malformed").alias("error"))
    if key:
        first = fine.groupBy(F.col(f"r.{key}").alias("_k")).agg(F.min("line_no").alias("_first"))
        fine = fine.join(first, F.col(f"r.{key}").eqNullSafe(F.col("_k")))
        errors = errors.unionByName(fine.where("line_no > _first").select("line_no", "line", F.lit("duplicate").alias("error")))
        fine = fine.where("line_no = _first")
    return fine.select("line_no", "r.*").drop("_bad"), errors


def write_jsonl(rows: DataFrame, path: str, order: list[str]) -> int:
    """One JSON-lines file, written beside and renamed into place; returns its rows.

    For exports that fit a file: rows are streamed through the driver one partition at a time.
    """
    folder = os.path.dirname(os.path.abspath(path))
    handle, part = tempfile.mkstemp(dir=folder, suffix=".part")
    n = 0
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            for r in rows.orderBy(*order).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
                out.write(json.dumps(json.loads(r["j"]), ensure_ascii=False, separators=(",", ":")) + "\n")
                n += 1
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise
    return n


def read_translations(spark: SparkSession, path: str) -> DataFrame:
    """group, code (normal form) and name_zh of a JSON file {group: {code: name}}; raises for blanks and repeated codes."""
    data = json.loads(spark.read.text(path, wholetext=True).first()[0])
    rows = [(g, c, n) for g, entries in data.items() for c, n in entries.items()]
    out = spark.createDataFrame(rows, "group string, code string, name_zh string").select("group", normal_code("code").alias("code"), stripped("name_zh").alias("name_zh"))
    if out.where("code = '' OR name_zh = ''").limit(1).count():
        raise ValueError("blank code or name")
    if out.groupBy("group", "code").count().where("count > 1").limit(1).count():
        raise ValueError("repeated code")
    return out


def read_catalogue(spark: SparkSession, path: str) -> tuple[dict, str]:
    """A JSON catalogue on any file system and the SHA-256 of its canonical form: keys in order, no blanks, no escapes."""
    data = json.loads(spark.read.text(path, wholetext=True).first()[0])
    return data, sha256(json.dumps(data, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def read_images(spark: SparkSession, pattern: str) -> DataFrame:
    """path, size, sha256, width and height of binary files; width and height only of PNGs.

    The dimensions are big-endian numbers at fixed places, after the signature and the chunk's name.
    """
    files = spark.read.format("binaryFile").load(pattern)
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    png = (F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A") & (F.hex(F.substring("content", 13, 4)) == "49484452")
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.when(png, number(17)).alias("width"), F.when(png, number(21)).alias("height"))


#: The columns of a manifest of images.
MANIFEST = ["path", "size", "sha256", "width", "height"]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest of images, typed; raises for a wrong header, repeated paths and numbers that aren't."""
    rows = read_csv(spark, path, MANIFEST, key=["path"])
    typed = rows.select("path", F.col("size").cast("long").alias("size"), "sha256", F.nullif("width", F.lit("")).cast("int").alias("width"), F.nullif("height", F.lit("")).cast("int").alias("height"))
    if typed.where("size IS NULL OR size < 0").limit(1).count():
        raise ValueError("a size isn't a number from 0")
    return typed


def write_manifest(rows: DataFrame, path: str) -> int:
    """A manifest in the order of its paths, written beside and renamed into place; returns its rows.  Rows are streamed through the driver."""
    handle, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".part")
    n = 0
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as out:
            writer = csv.writer(out, lineterminator="\n")
            writer.writerow(MANIFEST)
            for n, r in enumerate(rows.select(MANIFEST).orderBy("path").toLocalIterator(), 1):
                writer.writerow(["" if v is None else v for v in r])
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise
    return n


#: The four-letter codes, in order, and the least number of weighted terms of a profile.
CODES = ["ENFJ", "ENFP", "ENTJ", "ENTP", "ESFJ", "ESFP", "ESTJ", "ESTP", "INFJ", "INFP", "INTJ", "INTP", "ISFJ", "ISFP", "ISTJ", "ISTP"]
LEAST_TERMS = 12


def catalogue_problems(data: dict) -> list[str]:
    """What is wrong with a catalogue of profiles, empty if nothing: version, revision, codes and their order, texts, terms and weights.

    ``data``: version, revision, profiles; a profile: code, texts (all other strings) and weighted_terms (term, weight).
    """
    problems = []
    if not isinstance(data, dict):
        return ["root"]
    if not isinstance(data.get("version"), str) or not data["version"].strip():
        problems.append("version")
    if isinstance(data.get("revision"), bool) or not isinstance(data.get("revision"), int) or data["revision"] < 1:
        problems.append("revision")
    profiles = data.get("profiles") if isinstance(data.get("profiles"), list) else []
    if [p.get("code") if isinstance(p, dict) else None for p in profiles] != CODES:
        problems.append("codes")
    for p in (p for p in profiles if isinstance(p, dict)):
        code, terms = p.get("code"), p.get("weighted_terms")
        if any(isinstance(v, str) and not v.strip() for v in p.values()):
            problems.append(f"{code}: blank text")
        if not isinstance(terms, list) or len(terms) < LEAST_TERMS:
            problems.append(f"{code}: too few terms")
            continue
        forms = [canonical_value(str(t.get("term", ""))) for t in terms if isinstance(t, dict)]
        if len(set(forms)) < len(terms) or "" in forms:
            problems.append(f"{code}: blank or repeated terms")
        weights = [t.get("weight") for t in terms if isinstance(t, dict)]
        if any(isinstance(w, bool) or not isinstance(w, (int, float)) or not math.isfinite(w) or not 0 < w <= 5 for w in weights):
            problems.append(f"{code}: weight")
    return problems


def integrity(catalogue: DataFrame, manifest: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """key and ``problem`` over a catalogue, its manifest and the files: no_manifest, not_in_catalogue, no_file, size, hash."""
    m = manifest.select(key, F.col("size").alias("ms"), F.col("sha256").alias("mh"), F.lit(1).alias("_m"))
    f = files.select(key, F.col("size").alias("fs"), F.col("sha256").alias("fh"), F.lit(1).alias("_f"))
    c = catalogue.select(key, F.lit(1).alias("_c"))
    both = c.join(m, key, "full_outer").join(f, key, "left")
    rules = [("no_manifest", F.col("_m").isNull()), ("not_in_catalogue", F.col("_c").isNull()), ("no_file", F.col("_f").isNull()), ("size", F.col("ms") != F.col("fs")), ("hash", F.col("mh") != F.col("fh"))]
    return both.select(key, F.explode(F.array_compact(F.array(*(F.when(ok, F.lit(n)) for n, ok in rules)))).alias("problem"))


#: Who may act, and how it may end.
ROLES, OUTCOMES = ["viewer", "editor", "admin"], ["succeeded", "noop"]


def append_audit(rows: DataFrame, path: str) -> None:
    """Adds audit rows to a Parquet log; nothing in it is ever changed.  A role or outcome that isn't known fails the whole append."""
    checks = [(c, known) for c, known in (("actor_role", ROLES), ("outcome", OUTCOMES)) if c in rows.columns]
    for c, known in checks:
        odd = F.raise_error(F.concat(F.lit(f"{c} isn't one of {', '.join(known)}: "), F.coalesce(c, F.lit("null"))))
        rows = rows.withColumn(c, F.when(F.col(c).isin(known), F.col(c)).otherwise(odd))
    rows.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def read_table(spark: SparkSession, url: str, name: str, *, column: str, low: int, high: int, parts: int, properties: dict[str, str]) -> DataFrame:
    """A relational table over JDBC, read in ``parts`` ranges of a numeric column."""
    return spark.read.jdbc(url, name, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties)
