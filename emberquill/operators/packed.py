"""Several values packed in one field, one row each, with their places.

The grammar (ordered choice; a rule that fails gives its place back):

    field   <- blank* (list / values) blank* END
    list    <- OPEN values CLOSE                      # [..] or 【..】 around the whole field
    values  <- value (separator value)*
    value   <- blank* (quoted / list / bare / empty) blank*
    quoted  <- '"' ('""' / !'"' .)* '"' &rest / '“' (!'”' .)* '”' &rest / '「' .. '」' &rest / '『' .. '』' &rest
    rest    <- blank* (separator / CLOSE / END)       # in fields split by blanks: a blank too
    bare    <- (!separator !CLOSE .)+                 # also what a malformed quote falls back to

Ordered choice is decided from tables of every alternative's outcome at every place (packrat), so
broken quotes and brackets of any depth cost no more than good ones.  Fields are parsed once a
distinct text and Arrow batch; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Separators, quotes and brackets.
SEPARATORS = frozenset(",，、;；|｜/／\t\n\r")
QUOTES = {'"': '"', "“": "”", "「": "」", "『": "』"}
BRACKETS = {"[": "]", "【": "】"}


class Grammar:
    """A parser of the grammar above over one field, in time and memory linear in its length.

    What an alternative at a place comes to depends on later places only, so its outcomes are
    tabulated from the end of the field to its start; then values are read off from left to right.
    Nothing recurses, and no place is tried twice, however deep or broken the nesting.
    """

    def __init__(self, text: str, blanks_separate: bool) -> None:
        self.text, self.size, self.loose = text, len(text), blanks_separate
        blank = [c.isspace() for c in text]
        self.separates = [c in SEPARATORS or (blanks_separate and b) for c, b in zip(text, blank)]
        self.solid = self._ahead([not b or (s and not blanks_separate) for b, s in zip(blank, self.separates)])
        self.quotes = {mark: self._closing(end) for mark, end in QUOTES.items() if mark in text}
        self.stops = {close: self._ahead([s or c == close for c, s in zip(text, self.separates)]) for close in (None, *BRACKETS.values()) if close is None or close in text}
        self.lists = self._tabulate()

    def _ahead(self, here: list[bool]) -> list[int]:
        """For every place the first one from it on that is marked, else the end."""
        out = [self.size] * (self.size + 1)
        for i in range(self.size - 1, -1, -1):
            out[i] = i if here[i] else out[i + 1]
        return out

    def _closing(self, mark: str) -> list[int]:
        """For every place the first closing mark from it on (a doubled one doesn't close), -1 without one."""
        text, out = self.text, [-1] * (self.size + 2)
        for i in range(self.size - 1, -1, -1):
            if text[i] != mark:
                out[i] = out[i + 1]
            else:
                out[i] = out[i + 2] if mark == '"' and text[i + 1 : i + 2] == '"' else i
        return out

    def _rest(self, at: int, close: str | None) -> bool:
        """Whether a value may end before a place: a separator, the list's close or the end is next."""
        after = self.solid[at]
        return after >= self.size or self.separates[after] or (self.loose and after > at) or self.text[after] == close

    def _quoted(self, at: int, close: str | None) -> int:
        """The place of the mark that closes a quoted value, -1 if it is malformed."""
        end = self.quotes[self.text[at]][at + 1]
        return end if end >= 0 and self._rest(end + 1, close) else -1

    def _listed(self, at: int, close: str | None) -> int:
        """The place of the bracket that closes a list, -1 if none does."""
        own = self.lists.get(BRACKETS[self.text[at]])
        end = own[at + 1] if own else -1
        return end if end >= 0 and self._rest(end + 1, close) else -1

    def _tabulate(self) -> dict[str, list[int]]:
        """For every closing bracket and place: where values that begin there meet the bracket, -1 if they don't."""
        self.lists = tables = {close: [-1] * (self.size + 1) for mark, close in BRACKETS.items() if mark in self.text and close in self.text}
        for i in range(self.size - 1, -1, -1) if tables else ():
            c = self.text[i]
            for close, table in tables.items():
                if c == close:
                    table[i] = i
                elif self.separates[i] or self.solid[i] > i:
                    table[i] = table[i + 1]
                else:
                    end = self._quoted(i, close) if c in QUOTES else self._listed(i, close) if c in BRACKETS else -1
                    table[i] = table[end + 1 if end >= 0 else self.stops[close][i + 1]]
        return tables

    def parse(self) -> list[tuple[str, str | None]]:
        """(value, error) of every value that isn't empty; error is malformed_quote or unclosed_list."""
        text, values, at = self.text, [], 0
        closes: list[str | None] = [None]
        while (at := self.solid[at]) < self.size:
            c, close, error = text[at], closes[-1], None
            if c == close:
                closes.pop()
                at += 1
                continue
            if self.separates[at]:
                at += 1
                continue
            if c in QUOTES:
                if (end := self._quoted(at, close)) >= 0:
                    if value := (text[at + 1 : end].replace('""', '"') if c == '"' else text[at + 1 : end]).strip():
                        values.append((value, None))
                    at = end + 1
                    continue
                error = "malformed_quote"
            elif c in BRACKETS:
                if self._listed(at, close) >= 0:
                    closes.append(BRACKETS[c])
                    at += 1
                    continue
                error = "unclosed_list"
            stop = self.stops[close][at + 1]
            values.append((text[at:stop].strip(), error))
            at = stop
        return values


def _split(keys: list[str], loose: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple[bool, str], list] = {}
            at, pos, val, err, count = [], [], [], [], []
            for i, (field, text) in enumerate(zip(batch.column("field").to_pylist(), batch.column("text").to_pylist())):
                if not text:
                    continue
                memo = (field in loose, text)
                if memo not in known:
                    known[memo] = Grammar(text, memo[0]).parse()
                for k, (value, error) in enumerate(known[memo], 1):
                    at.append(i)
                    pos.append(k)
                    val.append(value)
                    err.append(error)
                    count.append(len(known[memo]))
            own = [batch.column(k).take(pa.array(at, pa.int64())) for k in (*keys, "field")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(pos, pa.int32()), pa.array(val, pa.string()), pa.array(err, pa.string()), pa.array(count, pa.int32())], [*keys, "field", "pos", "val", "error", "values"])

    return run


def split_values(rows: DataFrame, keys: list[str], fields: list[str], *, blank_fields: tuple[str, ...] = ()) -> DataFrame:
    """keys, ``field``, ``pos`` (from 1), ``val``, ``error`` and ``values`` (how many the field holds).

    Values are trimmed, without enclosing quotes or brackets, doubled quotes undone.  Separators
    are comma, ideographic comma, semicolon, bar, slash (full-width ones too), tab and line break,
    and blanks only in ``blank_fields``.  A malformed quote is a bare value with an error.

    Defined cases: a bracket that no other closes is part of a bare value with an error; null, empty and blank fields give no rows; empty values take no place; repeated
    rows are split each; columns named like a result column may be in ``rows`` unless they are keys.
    """
    parts = None
    for f in fields:
        part = rows.select(*keys, F.lit(f).alias("field"), F.col(f).cast("string").alias("text")).where(F.col("text").isNotNull())
        parts = part if parts is None else parts.unionByName(part)
    kinds = {c.name: c.dataType.simpleString() for c in rows.select(*keys).schema}
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return parts.mapInArrow(_split(keys, frozenset(blank_fields)), f"{head}, field string, pos int, val string, error string, values int")
