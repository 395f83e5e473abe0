"""Evaluation passages inside a corpus: a prefix-filtered set join with exact verification.

Method.  Items and documents are reduced to their letters and digits in lower case and seen as
sets of shingles.  A shared run of L characters makes every shingle of an item's L-window occur in
the document, so one necessary token a window suffices as its prefix: the rarest by document
frequency.  Documents are joined with the prefix tokens only; bounds on length and position drop
matches that leave no room for a run of L; the rest are verified by extending the match on its
diagonal, character by character, over both texts.

Scale.  Items are the stated query set: they go to the workers in blocks of a checked size, the
corpus is scanned in place and never shuffled.  Frequencies are summed on the map side and are as
many as the block's shingles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberquill.session import materialise

#: Characters of a shingle: half the shortest run.
SHINGLE = 10
#: Items sent to the workers at a time.
BLOCK = 20_000
#: Shortest shared run by language of the item.
RUNS = {"en": 50, "zh-Hant": 20}
DROPPED = re.compile(r"[\W_]+")


def letters(text: str | None) -> str:
    """Letters and digits in lower case."""
    return DROPPED.sub("", text.lower()) if text else ""


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashes(units: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every shingle."""
    n = len(units) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    wide = units.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + wide[k : k + n] + np.uint64(1)
    return (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


#: Between texts that are scanned together, and how many characters are.
APART, TOGETHER = chr(0x10FFFF), 200_000
#: Slots of the table that is asked before the sorted tokens are.
SLOTS = 1 << 22


class Tokens:
    """A sorted set of shingle hashes to look up many at once."""

    def __init__(self, tokens: np.ndarray) -> None:
        self.sorted, self.slots = tokens, np.zeros(SLOTS, bool)
        self.slots[(tokens & np.uint64(SLOTS - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` whose hash is a token, and the token's place."""
        if not len(self.sorted):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        hit = np.flatnonzero(self.slots[(h & np.uint64(SLOTS - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.sorted, h[hit]), len(self.sorted) - 1)
        same = self.sorted[at] == h[hit]
        return hit[same], at[same]


def scanned(batch: pa.RecordBatch, tokens: Tokens) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some rows at a time: the first, their code points together, where each begins, the places of tokens and which."""
    rows = [letters(t) for t in batch.column("text").to_pylist()]
    first = 0
    while first < len(rows):
        last, size = first, 0
        while last < len(rows) and (last == first or size < TOGETHER):
            size += len(rows[last]) + 1
            last += 1
        units = points(APART.join(rows[first:last]))  # shingles over two rows hold APART, which no item does
        begins = np.cumsum([0, *(len(r) + 1 for r in rows[first:last])])
        yield first, units, begins, *tokens.find(hashes(units))
        first = last


class Items:
    """A block of items: texts, shingles and, once frequencies are known, prefix tokens."""

    def __init__(self, rows: list[tuple[int, str, int]]) -> None:
        self.ids = [i for i, _, _ in rows]
        self.runs = np.array([r for _, _, r in rows], np.int64)
        self.texts = [points(t) for _, t, _ in rows]
        self.hashes = [hashes(t) for t in self.texts]
        self.all = np.unique(np.concatenate([*self.hashes, np.empty(0, np.uint64)]))

    def prefix(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted tokens, where the places of each begin, and the places: item and position."""
        token, item, place = [], [], []
        for k, h in enumerate(self.hashes):
            wide = int(self.runs[k]) - SHINGLE + 1
            if wide < 1 or len(h) < wide:
                continue
            rarity = counts[np.searchsorted(self.all, h)].astype(np.int64) * len(h) + np.arange(len(h))
            windows = np.lib.stride_tricks.sliding_window_view(rarity, wide)
            for p in np.unique(windows.argmin(axis=1) + np.arange(len(windows))):
                token.append(h[p])
                item.append(k)
                place.append(p)
        token, item, place = np.array(token, np.uint64), np.array(item, np.int64), np.array(place, np.int64)
        order = np.argsort(token, kind="stable")
        unique, first = np.unique(token[order], return_index=True)
        return unique, np.r_[first, len(token)], item[order], place[order]


def _counter(items: Items):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens = np.zeros(len(items.all), np.int64), Tokens(items.all)
        for batch in batches:
            for _, _, begins, hit, token in scanned(batch, tokens):
                row = np.searchsorted(begins, hit, "right")
                once = np.unique(row * len(items.all) + token)  # a document counts once
                np.add.at(total, once % len(items.all), 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["token", "n"])

    return count


def _run(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """Length of the longest equal run of a and b on the diagonal through (i, j), a match of a shingle."""
    back = min(i, j)
    unlike = np.flatnonzero(a[i - back : i] != b[j - back : j])
    left = back - 1 - unlike[-1] if len(unlike) else back
    ahead = min(len(a) - i, len(b) - j)
    unlike = np.flatnonzero(a[i : i + ahead] != b[j : j + ahead])
    return int(left + (unlike[0] if len(unlike) else ahead))


def _matcher(items: Items, prefix: tuple, key: str):
    tokens, bounds, item, place = prefix

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Tokens(tokens)
        for batch in batches:
            docs, found, lengths = [], [], []
            for first, units, begins, hit, token in scanned(batch, wanted):
                best: dict[tuple[int, int], int] = {}
                rows = np.searchsorted(begins, hit, "right") - 1
                for p, row, t in zip(hit.tolist(), rows.tolist(), token.tolist()):
                    a, b = int(begins[row]), int(begins[row + 1]) - 1
                    for k in range(bounds[t], bounds[t + 1]):
                        i, q = int(item[k]), int(place[k])
                        own, need = items.texts[i], int(items.runs[i])
                        room = min(q, p - a) + min(len(own) - q, b - p)
                        held = best.get((row, i), 0)
                        if room < need or held >= min(len(own), room):
                            continue
                        length = _run(own, units[a:b], q, p - a)
                        if length >= need and length > held:
                            best[row, i] = length
                docs += [first + row for row, _ in best]
                found += [items.ids[i] for _, i in best]
                lengths += list(best.values())
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(docs, pa.int64())), pa.array(found, pa.int64()), pa.array(lengths, pa.int32())], [key, "item_id", "run"])

    return match


def leaks(documents: DataFrame, cases: DataFrame, *, key: str = "doc_id", runs: dict[str, int] | None = None, default_run: int = 50) -> DataFrame:
    """``key``, ``item_id`` and ``run``: the longest run of letters and digits the two share.

    ``documents``: key, text.  ``cases``: item_id, query, language_code; other columns are ignored.
    A pair is given, once a document row, if the run has at least the length ``runs`` names for the
    item's language (``default_run`` for others and null).

    Defined cases: null, empty and blank texts or queries leak nothing, nor do queries shorter
    than their run; null item ids are ignored; equal queries are reported each; empty tables give
    no rows; null document keys are kept.
    """
    runs = RUNS if runs is None else runs
    least = min([*runs.values(), default_run])
    if least < SHINGLE:
        raise ValueError(f"runs are at least {SHINGLE} characters")
    wanted = cases.where(F.col("item_id").isNotNull() & F.col("query").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "query", "language_code")
    blocks = -(-wanted.count() // BLOCK) or 1
    texts = documents.select(key, "text").where(F.col("text").isNotNull())
    out = None
    for b in range(blocks):
        part = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        rows = [(r["item_id"], letters(r["query"]), runs.get(r["language_code"], default_run)) for r in part.collect()]  # about BLOCK rows
        items = Items(sorted(rows))
        counted = texts.mapInArrow(_counter(items), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).toArrow()  # two numbers a shingle of the block
        counts = np.zeros(len(items.all), np.int64)
        counts[counted["token"].to_numpy()] = counted["n"].to_numpy()
        found = texts.mapInArrow(_matcher(items, items.prefix(counts), key), f"`{key}` {documents.schema[key].dataType.simpleString()}, item_id bigint, run int")
        out = found if out is None else out.unionByName(found)
    return out


def leaked_items(found: DataFrame, cases: DataFrame) -> DataFrame:
    """Every item with the number of documents it leaked into and its longest shared run (0 without leak)."""
    found = materialise(found, "leaks")
    per = found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("run").alias("run"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return cases.select("item_id", "case_id").join(per, "item_id", "left").select("item_id", "case_id", zero("documents"), zero("run"))
