"""The N best items of every group, by merging sorted runs.

Method.  Each input partition becomes sorted runs: batches are ordered by group, score, tie and item,
cut to the N best distinct items of each group, and folded together, so that a run holds at most N rows
a group however many the partition had.  The shuffle stores the runs bucketed by group; a bucket's
reader gets them one after the other, each in its order, and a loser tree merges them all.  After N
distinct items of a group every run that comes up with more of it seeks to its next group by bisection.

Scale.  The cut before the shuffle bounds a hot group to N rows a run, so no task ever sees an
unbounded group, and nothing is sorted after the shuffle.  A bucket's runs are merged whenever as many
rows have come as its merged run holds (FOLD at least), so it holds about twice its result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a run may hold before it is folded.
FOLD = 200_000


class LoserTree:
    """Merges sorted lists of comparable keys: inner nodes hold losers, node 0 the winner.

    Keys are tuples that begin with the group.  ``pop`` gives the next key's run and place,
    ``seek`` leaves a run's rows of a group behind.
    """

    def __init__(self, runs: list[list]) -> None:
        self.runs, self.k, self.at = runs, len(runs), [0] * len(runs)
        self.tree = [-1] * max(self.k, 1)
        for r in range(self.k):
            self._play(r)

    def _beats(self, a: int, b: int) -> bool:
        if self.at[b] >= len(self.runs[b]):
            return True
        if self.at[a] >= len(self.runs[a]):
            return False
        return self.runs[a][self.at[a]] <= self.runs[b][self.at[b]]

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            held = self.tree[node]
            if held < 0:
                self.tree[node] = winner
                return
            if self._beats(held, winner):
                self.tree[node], winner = winner, held
            node //= 2
        self.tree[0] = winner

    def head(self) -> tuple[int, int] | None:
        """The run and place of the least key left; None at the end."""
        w = self.tree[0]
        return (w, self.at[w]) if w >= 0 and self.at[w] < len(self.runs[w]) else None

    def pop(self) -> None:
        """Leaves the least key behind."""
        w = self.tree[0]
        self.at[w] += 1
        self._play(w)

    def seek(self, group) -> None:
        """Takes the run of the least key to its first key past a group."""
        w = self.tree[0]
        self.at[w] = bisect_right(self.runs[w], group, self.at[w], key=itemgetter(0))
        self._play(w)


ORDER = (("score", "descending"), ("tie", "ascending"), ("item", "ascending"))


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def cut(rows: pa.Table, groups: list[str], n: int) -> pa.Table:
    """``rows`` in run order, at most ``n`` distinct items a group, each at its best place."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[*((g, "ascending") for g in groups), *ORDER]))
    if not rows.num_rows:
        return rows
    group = np.zeros(rows.num_rows, np.int64)
    for g in groups:
        codes = _codes(rows[g])
        group = group * (codes.max() + 1) + codes
        _, group = np.unique(group, return_inverse=True)
    items = _codes(rows["item"])
    _, first = np.unique(group * (items.max() + 1) + items, return_index=True)
    keep = np.sort(first)
    starts = np.r_[True, np.diff(group[keep]) != 0]
    place = np.arange(len(keep)) - np.maximum.accumulate(np.where(starts, np.arange(len(keep)), 0))
    return rows.take(pa.array(keep[place < n]))


def _runs(groups: list[str], n: int, fold: int):
    def labelled(rows: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
        label = (TaskContext.get().partitionId() << 20) + number
        rows = rows.append_column("run", pa.array(np.full(rows.num_rows, label, np.int64)))
        yield from rows.combine_chunks().to_batches(max_chunksize=20_000)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        number = 0
        for batch in batches:
            held.append(cut(pa.Table.from_batches([batch]), groups, n))
            if sum(t.num_rows for t in held) > fold:
                held = [cut(pa.concat_tables(held), groups, n)]
                if held[0].num_rows > fold // 2:  # mostly small groups: close the run, memory stays bounded
                    yield from labelled(held.pop(), number)
                    number += 1
        if held:
            yield from labelled(cut(pa.concat_tables(held), groups, n), number)

    return make


def _ranks(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of the values (strings by code point)."""
    coded = column.combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy(zero_copy_only=False)]


def merged(rows: pa.Table, groups: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``n`` best distinct items of every group in order, and their positions from 1, of runs that follow each other (``run``)."""
    group = np.zeros(rows.num_rows, np.int64)
    for g in groups:
        ranks = _ranks(rows[g])
        _, group = np.unique(group * (ranks.max(initial=0) + 1) + ranks, return_inverse=True)
    score, tie, item = -rows["score"].to_numpy(), rows["tie"].to_numpy(), _ranks(rows["item"])
    keys = list(zip(group.tolist(), score.tolist(), tie.tolist(), item.tolist()))
    label = rows["run"].to_numpy()
    falls = np.zeros(max(len(label) - 1, 0), bool)  # a run ends where its order does, whatever its label
    for column in (item, tie, score, group):
        falls = (column[1:] < column[:-1]) | ((column[1:] == column[:-1]) & falls)
    starts = np.flatnonzero(np.r_[True, (np.diff(label) != 0) | falls]) if len(label) else np.empty(0, np.int64)
    bounds = [*starts.tolist(), len(keys)]
    tree = LoserTree([keys[a:b] for a, b in zip(bounds, bounds[1:])])
    place, position, current, seen = [], [], -1, set()
    while (top := tree.head()) is not None:
        run, at = top
        key = tree.runs[run][at]
        if key[0] != current:
            current, seen = key[0], set()
        elif len(seen) == n:
            tree.seek(current)
            continue
        if key[3] not in seen:
            seen.add(key[3])
            place.append(bounds[run] + at)
            position.append(len(seen))
        tree.pop()
    return np.array(place, np.int64), np.array(position, np.int32)


def _merge(groups: list[str], n: int, fold: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = full = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size > full + max(full, fold):
                rows = pa.concat_tables(held)
                rows = rows.take(pa.array(merged(rows, groups, n)[0]))
                held, size, full = [rows.set_column(rows.column_names.index("run"), "run", pa.array(np.full(rows.num_rows, -1, np.int64)))], rows.num_rows, rows.num_rows
        if not size:
            return
        rows = pa.concat_tables(held)
        place, position = merged(rows, groups, n)
        rows = rows.take(pa.array(place)).append_column("pos", pa.array(position))
        yield from rows.select([*groups, "pos", "item", "score"]).combine_chunks().to_batches(max_chunksize=20_000)

    return merge


def best_per_group(rows: DataFrame, groups: list[str], n: int) -> DataFrame:
    """The ``n`` best distinct items of every group: groups, pos (from 1), item, score.

    ``rows``: the group columns, ``item`` (string), ``score`` (double), ``tie`` (bigint); other
    columns are ignored.  Order: score descending, tie ascending, item ascending by code point;
    an item counts once, at its best place.

    Defined cases: rows whose score is null or NaN, whose item is null, or with a null in a group
    column don't count; a null tie comes after all others; negative zero equals zero; groups with
    fewer items give fewer rows; an empty table gives none.
    """
    rows = rows.select(*groups, "item", (F.col("score").cast("double") + F.lit(0.0)).alias("score"), F.coalesce(F.col("tie").cast("long"), F.lit(2**63 - 1)).alias("tie"))
    for c in (*groups, "item", "score"):
        rows = rows.where(F.col(c).isNotNull())
    rows = rows.where(~F.isnan("score"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    run_schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*groups, "item", "score", "tie")) + ", run bigint"
    runs = rows.mapInArrow(_runs(groups, n, FOLD), run_schema)
    out = ", ".join(f"`{g}` {kinds[g]}" for g in groups) + ", pos int, item string, score double"
    return runs.repartition(*groups).mapInArrow(_merge(groups, n, FOLD), out)
