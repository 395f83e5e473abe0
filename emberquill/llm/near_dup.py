"""Near-duplicate texts: banded MinHash candidates, odd-sketch screening, exact verification.

Method.  Every distinct text becomes ``bands * rows`` MinHash samples of its shingle set.  The
samples of each band are hashed into one key; texts sharing a key are candidates.  All samples are
also folded into a parity bitmap (odd sketch): sample i flips one bit chosen by (i, value), so the
XOR of two bitmaps holds a set bit for every odd number of unshared samples, and its population
count estimates high similarities closely.  Candidates whose estimate is clearly below the
threshold are dropped; the rest are verified on the exact shingle sets.

Scale.  Identical texts are reduced to one representative before any pairing (map-side first), so
copies never meet in a band.  The one large shuffle carries a key and a number per text and band, is
written once and read once, in as many tasks as its rows need: texts of a band meet where it is
sorted.  Bands of more than FAMILY texts are handed to a join of their own, which can be split.
Candidate pairs grow with true likeness: six samples a band let a pair of similarity 0.2 meet in a
given band with probability 6e-5.  Screening moves sketches of 64 bytes.  For verification pairs are
laid on a grid of blocks by both ends, so a text is sent to as many blocks as it has partners in, and
never to more than two rows of the grid, whatever the size of its family.  Nothing is capped, and
nothing but counts reaches the driver.

With the defaults (44 bands of 6) a pair of similarity 0.7 becomes a candidate with probability
0.996, of 0.75 with 0.9998.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberquill.session import discard, materialise

BANDS, ROWS, SKETCH_BITS = 44, 6, 512
#: Screening keeps an estimate this far under the threshold: over four standard errors of 264 samples.
SLACK = 0.14
#: Grams hashed at a time; small enough to stay in the processor's cache.
BLOCK = 24_000
#: Bits of a band's key: chance collisions are screened like any candidates.
KEY_BITS = 40
#: Texts of a band that are paired where they meet, rows of the band shuffle a task, pairs of a verification block.
FAMILY, PER_TASK, PER_BLOCK = 256, 400_000, 20_000
#: Tasks of a shuffle at most: beyond, a task sorts more rows, and verifies more blocks one after the other.
MOST_TASKS = 50_000
#: Characters of texts whose shingle sets a verifying task keeps.
KEPT = 2_000_000
SPACES = r"[\s\p{Z}\x1c-\x1f\x85]+"


def normalised(text):
    """Lower case, each run of white space one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), SPACES, " "))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _units(texts: list[str], unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all units (code points or words) of the texts, and how many each text has."""
    if unit == "char":
        raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
        return np.frombuffer(b"".join(raw), np.uint32).astype(np.uint64), np.array([len(r) // 4 for r in raw], np.int64)
    words = [t.split() for t in texts]
    flat = np.array([w for ws in words for w in ws], dtype=object)
    return (pd.util.hash_array(flat, categorize=False) if len(flat) else np.empty(0, np.uint64)), np.array([len(w) for w in words], np.int64)


def shingle_hashes(texts: list[str], size: int, unit: str = "char") -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of every shingle, text after text, and the number of shingles of each text."""
    units, n = _units(texts, unit)
    counts = np.maximum(n - size + 1, 0)
    if not counts.sum():
        return np.empty(0, np.uint32), counts
    starts = np.cumsum(n) - n
    at = np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + units[at + k] + np.uint64(1)
    return (_mix(h) >> np.uint64(32)).astype(np.uint32), counts


def signatures(texts: list[str], size: int, unit: str, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band keys (texts x bands, int64), odd sketches (texts x words, int64), shingles per text.

    Texts without shingles get keys of their own place, which the caller must ignore.
    """
    k = bands * rows
    hashes, counts = shingle_hashes(texts, size, unit)
    some = np.flatnonzero(counts)
    sig = np.full((k, len(texts)), 0xFFFFFFFF, np.uint32)
    factors = (_mix(np.arange(1, k + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    ends = np.cumsum(counts[some])
    first = 0
    while first < len(some):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        block = hashes[base : ends[last - 1]]
        offsets = np.concatenate([[0], ends[first : last - 1] - base]).astype(np.intp)
        scratch = np.empty_like(block)
        for i in range(k):
            np.multiply(block, factors[i], out=scratch)
            sig[i, some[first:last]] = np.minimum.reduceat(scratch, offsets)
        first = last
    keys = np.empty((len(texts), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(texts), b + 1, np.uint64)
        for r in range(rows):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[b * rows + r])
        keys[:, b] = h
    place = _mix(sig.astype(np.uint64) + (np.arange(1, k + 1, dtype=np.uint64) << np.uint64(32))[:, None]) % np.uint64(SKETCH_BITS)
    flips = np.bincount((place.astype(np.int64) + np.arange(len(texts)) * SKETCH_BITS).ravel(), minlength=len(texts) * SKETCH_BITS)
    bits = np.packbits((flips & 1).astype(np.uint8).reshape(len(texts), SKETCH_BITS), axis=1)
    return keys.view(np.int64), bits.view(np.int64), counts


def _signer(size: int, unit: str, bands: int, rows: int, what: str):
    """Band rows (band, uid) or sketches (uid, sketch) of texts that hold a shingle."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                keys, bits, counts = signatures(part.column("text").to_pylist(), size, unit, bands, rows)
                keep = np.flatnonzero(counts)
                uid = part.column("uid").to_numpy()[keep]
                if what == "bands":  # rows of one part and band meet
                    key = _mix(keys[keep].view(np.uint64) + (uid % 16).astype(np.uint64)[:, None]) >> np.uint64(64 - KEY_BITS)
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(uid, bands))], ["band", "uid"])
                else:
                    offsets = pa.array(np.arange(0, bits[keep].size + 1, bits.shape[1], dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(uid), pa.ListArray.from_arrays(offsets, pa.array(bits[keep].ravel()))], ["uid", "sketch"])

    return sign


def meetings(band: np.ndarray, uid: np.ndarray, family: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (ua < ub) of equal bands, given in order of band and uid, and a mask of the rows of bands with more than ``family``."""
    starts = np.flatnonzero(np.r_[True, band[1:] != band[:-1]]) if len(band) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(band)])
    large = np.repeat(sizes > family, sizes)
    band, uid = band[~large], uid[~large]
    ua, ub = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for step in range(1, family):
        same = np.flatnonzero(band[step:] == band[:-step]) if step < len(band) else ()
        if not len(same):
            break
        ua.append(uid[same])
        ub.append(uid[same + step])
    return np.concatenate(ua), np.concatenate(ub), large


def _meet(family: int):
    """Pairs (ua, ub) of rows in order of band and uid; rows of large bands come out as (uid, null, band)."""

    def out(ua, ub, band) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.r_[ua, band[0]]), pa.concat_arrays([pa.array(ub, pa.int64()), pa.nulls(len(band[0]), pa.int64())]), pa.concat_arrays([pa.nulls(len(ua), pa.int64()), pa.array(band[1], pa.int64())])], ["ua", "ub", "band"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_band, held_uid, streamed = np.empty(0, np.int64), np.empty(0, np.int64), None
        for batch in batches:
            band, uid = np.r_[held_band, batch.column("band").to_numpy()], np.r_[held_uid, batch.column("uid").to_numpy()]
            if not len(band):
                continue
            more = int(np.searchsorted(band, streamed, "right")) if streamed is not None else 0  # the rest of a large band
            if more:
                yield out(uid[:0], uid[:0], (uid[:more], band[:more]))
            band, uid = band[more:], uid[more:]
            last = int(np.searchsorted(band, band[-1])) if len(band) else 0
            streamed = None if not more or len(band) else streamed
            if len(band) - last > family:
                streamed, last = band[-1], len(band)
            ua, ub, large = meetings(band[:last], uid[:last], family)
            yield out(ua, ub, (uid[:last][large], band[:last][large]))
            held_band, held_uid = band[last:], uid[last:]
        ua, ub, _ = meetings(held_band, held_uid, family)
        yield out(ua, ub, (held_uid[:0], held_band[:0]))

    return meet


def candidates(texts: DataFrame, *, size: int, unit: str, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs ua < ub of texts (uid, text) of one part that share a band, and the table they are read from."""
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-texts.count() * bands // PER_TASK)))
    banded = texts.mapInArrow(_signer(size, unit, bands, rows, "bands"), "band bigint, uid bigint").repartition(tasks, "band").sortWithinPartitions("band", "uid")
    met = materialise(banded.mapInArrow(_meet(FAMILY), "ua bigint, ub bigint, band bigint"), "near-met")
    large = met.where("ub IS NULL").select("band", "ua")
    more = large.join(large.select("band", F.col("ua").alias("ub")), "band").where("ua < ub").select("ua", "ub")
    return met.where("ub IS NOT NULL").select("ua", "ub").unionByName(more).distinct(), met


def _verifier(size: int, unit: str, num: int, den: int):
    """Alike pairs (ua, ub, similarity) of rows in order of block: first its texts (ua, text), then its pairs (ua, ub) in order."""

    def shingles(text: str) -> frozenset:
        units = text if unit == "char" else tuple(text.split())
        return frozenset(units[i : i + size] for i in range(len(units) - size + 1))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, texts, sets, kept = None, {}, {}, 0
        for batch in batches:
            ua, ub, similarity = [], [], []
            for b, a, c, text in zip(*(batch.column(n).to_pylist() for n in ("block", "ua", "ub", "text"))):
                if b != block:
                    block, texts, sets, kept = b, {}, {}, 0
                if c is None:
                    texts[a] = text
                    continue
                for uid in (a, c):
                    if uid not in sets:
                        if kept > KEPT:
                            sets, kept = {u: sets[u] for u in (a, c) if u in sets}, 0
                        sets[uid] = shingles(texts[uid])
                        kept += len(texts[uid])
                left, right = sets[a], sets[c]
                both = len(left & right)
                joint = len(left) + len(right) - both
                if both * den >= joint * num:
                    ua.append(a)
                    ub.append(c)
                    similarity.append(both / max(joint, 1))
            yield pa.RecordBatch.from_arrays([pa.array(ua, pa.int64()), pa.array(ub, pa.int64()), pa.array(similarity, pa.float64())], ["ua", "ub", "similarity"])

    return verify


def verified(pairs: DataFrame, texts: DataFrame, *, size: int, unit: str, num: int, den: int, done: tuple[DataFrame, ...] = ()) -> DataFrame:
    """The pairs whose shingle sets share at least num / den of their union, with their similarity.  Tables in ``done`` aren't needed once the pairs are written."""
    pairs = materialise(pairs.select("ua", "ub"), "near-likely")
    discard(*done)
    side = max(1, round((pairs.count() / PER_BLOCK) ** 0.5))
    row, column = (F.pmod(F.xxhash64(c), F.lit(side)) for c in ("ua", "ub"))
    laid = pairs.select((row * side + column).alias("block"), "ua", "ub")
    ends = laid.select("block", F.explode(F.array("ua", "ub")).alias("uid")).distinct()
    sent = ends.join(texts, "uid").select("block", F.col("uid").alias("ua"), F.lit(None).cast("bigint").alias("ub"), "text")
    every = laid.withColumn("text", F.lit(None).cast("string")).unionByName(sent)
    ordered = every.repartition(min(MOST_TASKS, side * side), "block").sortWithinPartitions("block", F.col("ub").isNotNull(), "ua", "ub")
    return ordered.mapInArrow(_verifier(size, unit, num, den), "ua bigint, ub bigint, similarity double")


def near_duplicates(
    rows: DataFrame, *, threshold: float = 0.8, size: int = 5, unit: str = "word", bands: int = BANDS, band_rows: int = ROWS
) -> tuple[DataFrame, DataFrame]:
    """Representatives of equal texts, and the links between alike representatives.

    ``rows``: ``part`` (a small int from 0 to 15; only rows of one part are compared), ``id``
    (bigint from 0 to 2**58, unique in its part) and ``text``; other columns are ignored.

    Returns ``members`` (part, id, uid: the representative's key) and ``links`` (ua < ub,
    similarity): all candidate pairs of distinct normalised texts whose shingle sets share at
    least ``threshold`` of their union.

    Defined cases: null texts are in neither result; empty, blank and texts shorter than a
    shingle belong to the class of their identical texts and have no links; equal texts share one
    uid whatever their length; an empty table gives empty results.
    """
    num, den = round(threshold * 1000), 1000
    text = rows.where(F.col("text").isNotNull()).select(F.col("part").cast("long").alias("part"), F.col("id").cast("long").alias("id"), normalised("text").alias("text"))
    text = text.withColumn("key", F.unhex(F.md5("text")))
    uid = F.col("id") * 16 + F.col("part")
    distinct = materialise(text.groupBy("part", "key").agg(F.min(uid).alias("uid"), F.first("text").alias("text")).select("uid", "text"), "near-distinct")
    reps = text.groupBy("part", "key").agg(F.min(uid).alias("uid"))
    members = materialise(text.select("part", "id", "key").join(reps, ["part", "key"]).select("part", "id", "uid"), "near-members")

    pairs, met = candidates(distinct, size=size, unit=unit, bands=bands, rows=band_rows)
    sketches = materialise(distinct.mapInArrow(_signer(size, unit, bands, band_rows, "sketches"), "uid bigint, sketch array<bigint>"), "near-sketches")
    words = SKETCH_BITS // 64
    unlike = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(1, words)), F.bit_count(F.col("sa")[0].bitwiseXOR(F.col("sb")[0])))
    samples = bands * band_rows
    most = SKETCH_BITS / 2 * (1 - np.exp(-4 * samples * (1 - max(0.0, threshold - SLACK)) / SKETCH_BITS))
    likely = (
        pairs.join(sketches.select(F.col("uid").alias("ua"), F.col("sketch").alias("sa")), "ua")
        .join(sketches.select(F.col("uid").alias("ub"), F.col("sketch").alias("sb")), "ub")
        .where(unlike <= F.lit(float(most)))
    )
    return members, verified(likely, distinct, size=size, unit=unit, num=num, den=den, done=(met, sketches))


def alike_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs (part, row_a < row_b) of rows whose texts are equal or linked."""
    copied = members.groupBy("uid").count().where("count > 1").select(F.col("uid").alias("ua"), F.col("uid").alias("ub"))
    joined = links.select("ua", "ub").unionByName(copied)
    a = members.select("part", F.col("id").alias("a"), F.col("uid").alias("ua"))
    b = members.select(F.col("id").alias("b"), F.col("uid").alias("ub"))
    return (
        joined.join(a, "ua").join(b, "ub").where("ua <> ub OR a < b")
        .select("part", F.least("a", "b").alias("row_a"), F.greatest("a", "b").alias("row_b"))
    )


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components: (uid, component = least uid), for every uid in ``links``.

    Alternates large-star and small-star steps; each round's edges are written to the shared
    folder and only their count reaches the driver.  Raises if it doesn't settle in ``rounds``.
    """
    edges = materialise(links.select("ua", "ub").where("ua <> ub"), "stars")
    seen = None
    for _ in range(rounds):
        both = edges.select("ua", "ub").unionByName(edges.select(F.col("ub").alias("ua"), F.col("ua").alias("ub")))
        least = both.groupBy("ua").agg(F.least(F.min("ub"), F.col("ua")).alias("m"))
        large = both.join(least, "ua").where("ub > ua").select(F.col("ub").alias("ua"), F.col("m").alias("ub")).where("ua <> ub").distinct()
        large = materialise(large, "stars")
        down = large.select(F.greatest("ua", "ub").alias("ua"), F.least("ua", "ub").alias("ub"))
        least = down.groupBy("ua").agg(F.min("ub").alias("m"))
        small = down.join(least, "ua")
        small = small.select(F.col("ub").alias("ua"), F.col("m").alias("ub")).unionByName(small.select("ua", F.col("m").alias("ub"))).where("ua <> ub").distinct()
        before, edges = edges, materialise(small, "stars")
        discard(before, large)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("ua", "ub").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    tops = edges.select(F.col("ub").alias("uid")).distinct().withColumn("component", F.col("uid"))
    return edges.groupBy("ua").agg(F.min("ub").alias("component")).withColumnRenamed("ua", "uid").unionByName(tops)


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per text row: part, id, class_id (least id of its component), class_size, links (alike distinct texts)."""
    links = materialise(links, "near-links")
    comp = components(links)
    ends = links.select(F.col("ua").alias("uid")).unionByName(links.select(F.col("ub").alias("uid"))).groupBy("uid").agg(F.count("*").alias("links"))
    joined = members.join(comp, "uid", "left").join(ends, "uid", "left").select("part", "id", F.coalesce("component", "uid").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    sizes = joined.groupBy("component").agg(F.count("*").alias("class_size"), F.min("id").alias("class_id"))
    return joined.join(sizes, "component").select("part", "id", "class_id", "class_size", "links")
