"""Texts that stop before their author did, by character n-gram models read from the end.

Method.  Three counts over the distinct texts of a column, all of n-grams up to ORDER, decide:

1. *Closing lines.*  How often a line opens with an n-gram in a text's first line, which is prose, and
   how often in later ones.  A last line whose opening comes in later lines only, and there with other
   ends than first lines have (signatures, tags, measurements, lists), is taken off, line by line.
2. *Ends.*  For the final context of what is left and its shorter suffixes, how often text ends there
   and how often it goes on.  The log odds of ending, the text left out of its own evidence and
   shorter suffixes backing up longer ones, are high after a finished sentence and very low inside
   words, numbers and sentences.
3. *Tails.*  A context that ends texts more surely than sentences do, which also stand inside texts,
   is no end of prose.  Of the places in the last line from which on the text recurs as an ending of
   other texts, and hardly otherwise, the one with the best log odds is where the prose ends.

Symbols, opening marks and marks of omission at an end are no context: what they follow is.  The threshold is set by
language and column, where the histogram of log odds splits best.

Scale.  Copies are left out by the hash of the whole folded text, within a task and then by one shuffle,
so they don't vote.  The corpus is scanned twice for n-grams, each time for those that pass a bitmap of
the wanted ones (fixed size, made by the workers); sums per n-gram are shuffled and joined, whatever
their number.  Nothing but the bitmaps, two totals and the histogram reaches the driver.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberquill.session import discard, materialise

ORDER = 4
#: Characters scanned together; counts a task holds before it merges them, openings before it hands them on.
TOGETHER, HELD, OPENINGS = 200_000, 2_000_000, 500_000
#: Marks of texts a task holds to leave out copies before the shuffle.
REMEMBERED = 200_000
#: Bits of the map of wanted n-grams.
SLOTS = 1 << 24
#: Values of a language that weigh as much as the split of all languages together.
SHRINK = 1000
#: How far below and above the median log odds are told apart.
REACH = (-7.0, 1.0)
#: Weight of the shorter context, in observations.
BACKOFF = 10.0
#: Share of later lines, and log likelihood ratio, from which an opening is that of closing lines, or is not.
LATER, DECISIVE = 0.98, 9.0
#: Share of the first lines that a character ends, from which it is one prose ends with.
FINAL = 0.02
#: Log odds of ending from which a tail is looked for; texts a tail recurs in, and its least share of endings.
SURE, RECURS, ENDS = -0.85, 3, 0.5
DIGITS = re.compile(r"\d")
#: Marks of omission, also written as two or more dots.
OMISSION = ("…", "⋯", "‥", "..")
#: Unicode's categories of what ends no prose: symbols, formats and the like, combining marks of symbols, opening marks.
NO_END = frozenset(("Sc", "Sk", "Sm", "So", "Cc", "Cf", "Cn", "Co", "Cs", "Mn", "Me", "Pi", "Ps"))


def folded(text: str | None) -> list[str]:
    """What the models see: lines that aren't blank, in lower case, every digit a zero, blanks one blank."""
    return [line for line in (" ".join(part.split()) for part in DIGITS.sub("0", text.lower()).split("\n")) if line] if text else []


def bare(text: str) -> str:
    """The text without what ends no prose: blanks, symbols, formats, opening brackets and quotes, marks of omission."""
    end = len(text)
    while end:
        if text.endswith(OMISSION, 0, end):
            end = len(text[:end].rstrip("…⋯‥."))
        elif text[end - 1].isspace() or unicodedata.category(text[end - 1]) in NO_END:
            end -= 1
        else:
            break
    return text[:end]


def marked(lines: list[str]) -> bytes:
    """What tells one text from another: a hash of the whole."""
    return hashlib.blake2b("\n".join(lines).encode("utf-8", "surrogatepass"), digest_size=16).digest()


#: Between texts that are scanned together: a code point that stands for no character.
APART = chr(0x10FFFF)


def contexts(text: str) -> Iterator[np.ndarray]:
    """Hashes of the n-grams that end at each place, order after order from 1 to ORDER; the first places of an order, which have none, hold other numbers."""
    units = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(units), np.uint64)
    for n in range(ORDER):
        h[n:] = (h[n:] + units[: len(units) - n]) * np.uint64(0x9E3779B97F4A7C15)
        h[n:] ^= h[n:] >> np.uint64(29)
        yield (h ^ np.uint64(n + 1)).view(np.int64)


@lru_cache(maxsize=100_000)
def final_contexts(text: str) -> list[int]:
    """Hashes of a text's last n-grams, from order 1 to ORDER, as far as it is long enough."""
    return [int(h[-1]) for n, h in enumerate(contexts(text)) if len(text) > n]


# texts and their closing lines -------------------------------------------------------------------


def _marks(key: str, group: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = map(folded, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, *group)), pa.array([marked(x) if x else None for x in lines], pa.binary())], [key, *group, "mark"])

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folded texts with their marks; copies a task meets among its last REMEMBERED are left out here, the others by the shuffle."""
    seen: set[bytes] = set()
    for batch in batches:
        marks, texts = [], []
        for text in batch.column("text").to_pylist():
            lines = folded(text)
            if not lines or (mark := marked(lines)) in seen:
                continue
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add(mark)
            marks.append(mark)
            texts.append(lines)
        yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), pa.array(texts, pa.list_(pa.string()))], ["mark", "lines"])


def _openings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often first and later lines open with each n-gram and end with each character."""
    first: Counter[tuple[str, str]] = Counter()
    later: Counter[tuple[str, str]] = Counter()

    def out() -> pa.RecordBatch:
        seen = list(first.keys() | later.keys())
        return pa.RecordBatch.from_arrays([pa.array([g for g, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.string()), pa.array([first[x] for x in seen], pa.int64()), pa.array([later[x] for x in seen], pa.int64())], ["gram", "final", "first", "later"])

    for batch in batches:
        for lines in batch.column("lines").to_pylist():
            for k, line in enumerate(lines):
                (later if k else first).update((line[:n], line[-1]) for n in range(1, min(ORDER, len(line)) + 1))
        if len(first) + len(later) > OPENINGS:
            yield out()
            first.clear()
            later.clear()
    yield out()


def closing_openings(texts: DataFrame) -> DataFrame:
    """gram and ``closing`` of the openings that decide, either way: of later lines only, which seldom end as first lines do."""
    counts = materialise(texts.mapInArrow(_openings, "gram string, final string, first bigint, later bigint").groupBy("gram", "final").agg(F.sum("first").alias("first"), F.sum("later").alias("later")), "openings")
    single = counts.where(F.length("gram") == 1)
    whole = single.agg(F.sum("first"), F.sum("later")).first()
    firsts, laters = whole[0] or 0, whole[1] or 0
    finals = single.groupBy("final").agg(F.sum("first").alias("n")).where(F.col("n") >= FINAL * max(firsts, 1)).select("final", F.lit(True).alias("stop"))  # at most 1 / FINAL rows
    by = counts.join(F.broadcast(finals), "final", "left").groupBy("gram").agg(F.sum("first").alias("first"), F.sum("later").alias("later"), F.sum(F.when(F.col("stop"), F.col("later")).otherwise(0)).alias("stops"))
    base = min(max(laters / max(firsts + laters, 1), 1e-6), LATER - 1e-6)
    share = F.col("later") / (F.col("first") + F.col("later"))
    term = lambda count, p, q: F.when(count > 0, count * F.log(p / q)).otherwise(0.0)
    against = lambda q: term(F.col("later"), share, F.lit(q)) + term(F.col("first"), 1 - share, F.lit(1 - q))
    alone, mixed = (share >= LATER) & (against(base) >= DECISIVE), (share < LATER) & (against(LATER) >= DECISIVE)
    return by.where(alone | mixed).select("gram", (alone & (F.col("stops") * 2 < F.col("later"))).alias("closing"))


def _prose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their closing lines: all as one line, its last line bare, and the last characters of that."""
    for batch in batches:
        bodies, lasts, suffixes = [], [], []
        for lines, closing in zip(batch.column("lines").to_pylist(), batch.column("closing").to_pylist()):
            end, odd = len(lines), set(closing or ())
            while end > 1 and end - 1 in odd:
                end -= 1
            last = bare(lines[end - 1])
            bodies.append(" ".join(lines[:end]))
            lasts.append(last or None)
            suffixes.append(last[-ORDER:] or None)
        yield pa.RecordBatch.from_arrays([batch.column("mark"), pa.array(bodies, pa.string()), pa.array(lasts, pa.string()), pa.array(suffixes, pa.string())], ["mark", "body", "last", "suffix"])


def prose(texts: DataFrame) -> DataFrame:
    """mark, body, last and suffix of every distinct text (mark, lines)."""
    later = texts.select("mark", F.posexplode("lines").alias("place", "line")).where("place > 0")
    grams = later.select("mark", "place", F.posexplode(F.transform(F.sequence(F.lit(1), F.least(F.lit(ORDER), F.length("line"))), lambda n: F.substring("line", F.lit(1), n))).alias("n", "gram"))
    lines = grams.join(closing_openings(texts), "gram").groupBy("mark", "place").agg(F.max_by("closing", "n").alias("closing")).where("closing")
    closing = lines.groupBy("mark").agg(F.collect_list("place").alias("closing"))  # a text's own lines
    return texts.join(closing, "mark", "left").mapInArrow(_prose, "mark binary, body string, last string, suffix string")


# the n-gram model --------------------------------------------------------------------------------


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        suffixes = batch.column("suffix").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("suffix"), pa.array([final_contexts(s) for s in suffixes], pa.list_(pa.int64()))], ["suffix", "grams"])


def with_grams(suffixes: DataFrame) -> DataFrame:
    """suffix, order (from 0) and gram of distinct suffixes."""
    return suffixes.select("suffix").mapInArrow(_grams, "suffix string, grams array<bigint>").select("suffix", F.posexplode("grams").alias("order", "gram"))


def _bits(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(slots // 64, np.uint64)
        for batch in batches:
            slot = batch.column("gram").to_numpy(zero_copy_only=False) & (slots - 1)
            np.bitwise_or.at(words, slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64))
        seen = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(words[seen].view(np.int64))], ["place", "bits"])

    return run


def bitmap(grams: DataFrame) -> np.ndarray:
    """A map of the wanted n-grams with SLOTS bits, packed: at most SLOTS / 64 rows reach the driver."""
    rows = grams.select("gram").mapInArrow(_bits(SLOTS), "place bigint, bits bigint").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(SLOTS // 64, np.int64)
    words[rows["place"].to_numpy()] = rows["bits"].to_numpy()
    return words.view(np.uint8)


def _totals(packed: np.ndarray):
    slots = len(packed) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(packed, bitorder="little").view(bool)
        grams, counts, held = [], [], 0

        def merge() -> None:
            nonlocal grams, counts, held
            if grams:
                unique, at = np.unique(np.concatenate(grams), return_inverse=True)
                grams, counts = [unique], [np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)]
                held = len(unique)

        def scan(bodies: list[str]) -> None:
            nonlocal held
            for h in contexts(APART + APART.join(bodies)):  # n-grams over two texts hold APART, which no ending does
                unique, n = np.unique(h[wanted[h & (slots - 1)]], return_counts=True)
                grams.append(unique)
                counts.append(n)
                held += len(unique)

        for batch in batches:
            bodies, size = [], 0
            for body in batch.column("body").to_pylist():
                bodies.append(body)
                size += len(body)
                if size > TOGETHER:
                    scan(bodies)
                    bodies, size = [], 0
            if bodies:
                scan(bodies)
            if held > HELD:
                merge()
                if held > HELD // 2:  # mostly different ones: handed on, memory stays bounded
                    yield pa.RecordBatch.from_arrays([pa.array(grams.pop()), pa.array(counts.pop())], ["gram", "total"])
                    held = 0
        merge()
        if grams:
            yield pa.RecordBatch.from_arrays([pa.array(grams[0]), pa.array(counts[0])], ["gram", "total"])

    return run


def totals(bodies: DataFrame, grams: DataFrame) -> DataFrame:
    """gram and total: how often each wanted n-gram, and some others, occurs in the bodies."""
    return bodies.select("body").mapInArrow(_totals(bitmap(grams)), "gram bigint, total bigint").groupBy("gram").agg(F.sum("total").alias("total"))


def log_odds(grams: DataFrame, ended: DataFrame, total: DataFrame, own: int) -> DataFrame:
    """suffix, log_odds of ending there, and ``others``: by order, how often its n-gram goes on.

    ``own``: whether a text that is judged there also ends there (1), or was only seen there (0).
    """
    seen = grams.join(ended, "gram", "left").join(total, "gram", "left").select("suffix", "order", F.coalesce("ended", F.lit(0)).alias("e"), F.coalesce("total", F.lit(1)).alias("t"))
    evidence = seen.groupBy("suffix").agg(F.sort_array(F.collect_list(F.struct("order", "e", "t"))).alias("x"))  # ORDER structs a suffix
    known, rest = lambda x: F.greatest(x["e"] - own, F.lit(0)), lambda x: F.greatest(x["t"] - 1, x["e"] - own, F.lit(0))
    chance = F.aggregate("x", F.lit(1e-3), lambda p, x: (known(x) + BACKOFF * p) / (rest(x) + BACKOFF))
    return evidence.select("suffix", F.log(chance / (1 - chance)).alias("log_odds"), F.transform("x", lambda x: F.greatest(x["t"] - x["e"], F.lit(0))).alias("others"))


# tails -------------------------------------------------------------------------------------------


def starts(last: str) -> list[tuple[int, str]]:
    """Places in a line where a tail may begin, where words, blanks and other signs meet, with what stands before it, bare."""
    kind = [0 if c.isspace() else 1 if c.isalnum() else ord(c) + 2 for c in last]
    return [(i, before) for i in range(len(last) - 1, 0, -1) if kind[i] != kind[i - 1] and kind[i] and (before := bare(last[:i]))]


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, tails, sizes, suffixes = [], [], [], []
        for k, last in enumerate(batch.column("last").to_pylist()):
            for i, before in starts(last):
                at.append(k)
                tails.append(hashlib.blake2b(last[i:].encode("utf-8", "surrogatepass"), digest_size=16).digest())
                sizes.append(min(len(last) - i, ORDER))
                suffixes.append(before[-ORDER:])
        yield pa.RecordBatch.from_arrays([batch.column("mark").take(pa.array(at, pa.int64())), batch.column("others").take(pa.array(at, pa.int64())), pa.array(tails, pa.binary()), pa.array(sizes, pa.int32()), pa.array(suffixes, pa.string())], ["mark", "others", "tail", "size", "suffix"])


def before_tails(bodies: DataFrame, scores: DataFrame, ended: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """mark and log_odds of the texts that end with a tail: those of the best place before one; and the tables it is made of."""
    sure = bodies.select("mark", "last", "suffix").join(scores.where(F.col("log_odds") > SURE).select("suffix", "others"), "suffix")
    tails = materialise(sure.select("mark", "last", "others").mapInArrow(_tails, "mark binary, others array<bigint>, tail binary, size int, suffix string"), "tails")
    known = tails.groupBy("tail").agg(F.count("*").alias("n")).where(F.col("n") >= RECURS)
    goes_on = F.element_at("others", F.least("size", F.size("others")))
    allowed = tails.join(known, "tail").where((F.col("n") - 1) / (F.col("n") + 1 + goes_on) >= ENDS)
    allowed = materialise(allowed.select("mark", "suffix").distinct(), "allowed")
    grams = materialise(with_grams(allowed.select("suffix").distinct()), "place-grams")
    places = log_odds(grams, ended, totals(bodies, grams), 0)
    return allowed.join(places, "suffix").groupBy("mark").agg(F.max("log_odds").alias("log_odds")), [tails, allowed, grams]


def scored(texts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """mark and ``log_odds`` of ending of every distinct text (mark, lines) that has prose, and the tables it is made of."""
    bodies = materialise(prose(texts), "prose")
    ends = bodies.where(F.col("suffix").isNotNull())
    suffixes = ends.groupBy("suffix").agg(F.count("*").alias("n"))
    grams = materialise(with_grams(suffixes), "grams")
    ended = materialise(grams.join(suffixes, "suffix").groupBy("gram").agg(F.sum("n").alias("ended")), "ended")
    scores = materialise(log_odds(grams, ended, totals(bodies, grams), 1), "scores")
    before, done = before_tails(bodies, scores, ended)
    judged = ends.select("mark", "suffix").join(scores, "suffix").join(before.withColumnRenamed("log_odds", "before"), "mark", "left").select("mark", F.coalesce("before", "log_odds").alias("log_odds"))
    return judged, [bodies, grams, ended, scores, *done]


# verdicts ----------------------------------------------------------------------------------------


def language(column):
    """en, zh, mul or other, whatever the spelling of the tag."""
    tag = F.lower(F.trim(F.coalesce(column, F.lit(""))))
    return F.when(tag.startswith("en"), "en").when(tag.startswith("zh"), "zh").when(tag == "mul", "mul").otherwise("other")


def split_point(values: np.ndarray, weights: np.ndarray) -> float:
    """The value that splits a weighted histogram with the greatest variance between its parts (Otsu).

    Most values end a sentence, so the median is their typical log odds; evidence further than
    REACH from it counts as at REACH, or the long tail of impossible endings would draw the split.
    """
    order = np.argsort(values)
    v, w = values[order], weights[order].astype(float)
    if len(v) < 2:
        return -math.inf
    median = v[np.searchsorted(np.cumsum(w), w.sum() / 2)]
    v = np.clip(v, median + REACH[0], median + REACH[1])
    w0 = np.cumsum(w)[:-1]
    m0 = np.cumsum(w * v)[:-1]
    total, mass = w.sum(), (w * v).sum()
    between = (mass * w0 / total - m0) ** 2 / np.maximum(w0 * (total - w0), 1e-9)
    k = int(np.argmax(between))
    return float((v[k] + v[k + 1]) / 2)


def thresholds(judged: DataFrame) -> dict[str, float]:
    """The threshold of each language, from mark, language and log_odds of every row; copies count once a language."""
    once = judged.where(F.col("log_odds").isNotNull()).groupBy("mark").agg(F.first("log_odds").alias("log_odds"), F.collect_set("language").alias("languages"))  # equal texts, equal log odds; four languages
    spread = once.select(F.round(F.col("log_odds") * 10).alias("bin"), F.explode(F.concat("languages", F.array(F.lit(None).cast("string")))).alias("language"))  # null: all languages together
    bins = spread.groupBy("language", "bin").count().collect()  # some hundred
    split = lambda rs: split_point(np.array([r["bin"] / 10 for r in rs]), np.array([r["count"] for r in rs]))
    pooled, limits = split([r for r in bins if r["language"] is None]), {}
    for lang in {r["language"] for r in bins} - {None}:
        own = [r for r in bins if r["language"] == lang]
        n, point = sum(r["count"] for r in own), split(own)
        limits[lang] = (n * point + SHRINK * pooled) / (n + SHRINK) if math.isfinite(point) else pooled
    return {lang: v for lang, v in sorted(limits.items()) if math.isfinite(v)}


def truncated(documents: DataFrame, *, key: str = "doc_id", group: list[str] | None = None, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """``key``, group columns, ``column``, ``language``, ``log_odds``, ``threshold`` and ``cut`` (boolean, never null), one row a value.

    ``documents``: key, ``lang``, the group columns (say, the source) and the text columns.  Every
    column has models and thresholds of its own, thresholds by language.

    Defined cases: null, empty and blank texts, and texts of symbols only, aren't cut; unknown
    languages are judged together; a language's threshold is drawn to that of all, the more the fewer
    its values; with a single kind of ending in all there is no threshold and no cut; copies are
    judged alike and count once in the models and in each language's threshold; an empty table gives
    no rows; key and group columns can't have the names of result columns (ValueError).
    """
    group = group or []
    if clash := {"language", "log_odds", "threshold", "column", "cut", "mark", "text"} & {key, *group}:
        raise ValueError(f"the result has columns of these names: {', '.join(sorted(clash))}")
    out = None
    for column in columns:
        rows = documents.select(key, F.col(column).alias("text"), *group, language(F.col("lang")).alias("language"))
        kept = [*group, "language"]
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        texts = materialise(rows.select("text").mapInArrow(_texts, "mark binary, lines array<string>").dropDuplicates(["mark"]), "texts")
        marks = rows.select(key, *kept, "text").mapInArrow(_marks(key, kept), ", ".join(f"`{c}` {kinds[c]}" for c in (key, *kept)) + ", mark binary")
        scores, done = scored(texts)
        judged = materialise(marks.join(scores, "mark", "left"), "judged")
        discard(texts, *done)
        limit = F.lit(None).cast("double")
        for lang, value in thresholds(judged).items():
            limit = F.when(F.col("language") == lang, F.lit(value)).otherwise(limit)
        one = judged.select(key, *group, F.lit(column).alias("column"), "language", "log_odds", limit.alias("threshold"), F.coalesce(F.col("log_odds") < limit, F.lit(False)).alias("cut"))
        out = one if out is None else out.unionByName(one)
    return out


def rates(judged: DataFrame, by: str = "source") -> DataFrame:
    """Each source's values with prose, cut values and rate of cut values (6 decimals)."""
    some = judged.where(F.col("log_odds").isNotNull()).groupBy(by).agg(F.count("*").alias("texts"), F.sum(F.col("cut").cast("long")).alias("cut_texts"))
    return some.withColumn("cut_rate", F.round(F.col("cut_texts") / F.col("texts"), 6))
