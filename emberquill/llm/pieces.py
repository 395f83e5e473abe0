"""Cutting long texts at natural boundaries, and auditing pieces that were cut elsewhere.

Method.  A text is laid out once as arrays of offsets: where tokens start (with prefix sums of
their number) and where paragraphs, sentences, clauses and blanks end.  A piece ends at the last
boundary of the strongest kind that a binary search finds within the limit; a boundary counts if the
piece then reaches past the overlap, and only without any such boundary is it cut hard at the limit.  The next piece starts ``overlap`` characters
before that end.

Scale.  One text is one row, handled alone; no shuffle in ``split``.  ``audit`` measures pieces
row by row, then shuffles keys, flags and two ends of 80 characters, never the contents.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 500, 80

#: The kinds of boundary from the strongest to the weakest; a piece ends after a match.
BOUNDARIES = (
    re.compile(r"\n+"),
    re.compile(r"[。！？!?；;.…]+[”’」』）)\"']*\s*"),
    re.compile(r"[，,、：:]\s*"),
    re.compile(r"\s+"),
)
TOKEN = re.compile(r"[a-z0-9]+|[㐀-䶿一-鿿豈-﫿]+")


class Layout:
    """Offsets of one text: boundary ends by kind, token runs and prefix sums of their tokens.

    A run of letters and digits is one token, a run of ideographs one token for each two.
    """

    def __init__(self, text: str) -> None:
        self.text = text
        self.ends = [[m.end() for m in kind.finditer(text)] for kind in BOUNDARIES]
        self.starts, self.stops, self.wide, self.sums = [], [], [], [0]
        low = text.lower()
        for m in TOKEN.finditer(low if len(low) == len(text) else text):
            self.starts.append(m.start())
            self.stops.append(m.end())
            self.wide.append(m[0][0] > "z")
            self.sums.append(self.sums[-1] + (-(-(m.end() - m.start()) // 2) if self.wide[-1] else 1))

    def tokens(self, start: int, end: int) -> int:
        """Tokens of text[start:end]; runs cut by its ends count with what is left of them."""
        if end <= start:
            return 0
        first, last = bisect_right(self.stops, start), bisect_right(self.starts, end - 1)
        n = self.sums[last] - self.sums[first] if last > first else 0
        for run in {first, last - 1} if last > first else ():
            a, b = self.starts[run], self.stops[run]
            if self.wide[run] and (a < start or b > end):
                n += -(-(min(b, end) - max(a, start)) // 2) - -(-(b - a) // 2)
        return n

    def cuts(self, limit: int, overlap: int) -> list[tuple[int, int, str]]:
        """(start, end, kind of boundary) of the pieces: kinds 0 to 3 by strength, hard, end."""
        out, start, size = [], 0, len(self.text)
        while size - start > limit:
            end, kind = start + limit, "hard"
            for k, ends in enumerate(self.ends):
                place = bisect_right(ends, start + limit) - 1
                if place >= 0 and ends[place] > start + overlap:
                    end, kind = ends[place], str(k)
                    break
            out.append((start, end, kind))
            start = end - overlap
        out.append((start, size, "end"))
        return out


def _split(limit: int, overlap: int, key: str):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for ident, content in zip(batch.column(key).to_pylist(), batch.column("content").to_pylist()):
                layout = Layout((content or "").strip())
                if not layout.text:
                    continue
                for index, (start, end, kind) in enumerate(layout.cuts(limit, overlap)):
                    for col, value in zip(cols, (ident, index, start, end, layout.text[start:end], end - start, layout.tokens(start, end), kind)):
                        col.append(value)
                if len(cols[0]) > 20_000:
                    yield _pieces(cols, batch.schema.field(key).type, key)
                    cols = [[] for _ in range(8)]
            yield _pieces(cols, batch.schema.field(key).type, key)

    return split


def _pieces(cols: list[list], kind: pa.DataType, key: str) -> pa.RecordBatch:
    kinds = [kind, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [key, "chunk_index", "start_at", "end_at", "content", "char_count", "token_count", "boundary"])


def split(documents: DataFrame, *, key: str = "id", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every document: key, chunk_index, start_at, end_at, content, char_count, token_count, boundary.

    ``documents`` has ``key`` and ``content``; other columns are ignored.  Offsets and lengths are
    in code points of the trimmed content.  Every piece has at most ``limit`` characters and,
    after the first, starts with the last ``overlap`` characters of the one before.

    Defined cases: null, empty and blank contents give no piece; texts within the limit give one;
    a text without any boundary is cut hard; null keys are kept; repeated rows are split each.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be under the limit")
    kind = documents.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, chunk_index int, start_at int, end_at int, content string, char_count int, token_count int, boundary string"
    return documents.select(key, "content").mapInArrow(_split(limit, overlap, key), out)


def _points(column) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts of a column, and the prefix sums of their lengths."""
    raw = [(t or "").encode("utf-32-le", "surrogatepass") for t in column.to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint32), np.r_[0, np.cumsum([len(r) // 4 for r in raw])].astype(np.int64)


#: The code points that Unicode counts as white space.
BLANKS = np.array([*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


def token_sums(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Blank-separated words of each text, by prefix sums over the places where words start."""
    solid = ~np.isin(points, BLANKS)
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    starts[first] = solid[first]
    sums = np.r_[0, np.cumsum(starts)]
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _measure(limit: int, overlap: int):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                points, bounds = _points(batch.column("content"))
                n = np.diff(bounds)
                words = token_sums(*_points(batch.column("lexical_text")))
                raw = points.tobytes()
                text = lambda a, b: raw[4 * a : 4 * b].decode("utf-32-le", "surrogatepass")
                heads = [text(a, min(a + overlap, b)) for a, b in zip(bounds[:-1], bounds[1:])]
                tails = [text(max(b - overlap, a), b) for a, b in zip(bounds[:-1], bounds[1:])]
                stated = lambda c: batch.column(c).fill_null(-1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("document_id"), batch.column("chunk_index"), batch.column("chunk_no"), pa.array(n > limit), pa.array(stated("char_count") != n), pa.array(stated("token_count") != words), pa.array(heads, pa.string()), pa.array(tails, pa.string())],
                    ["id", "document_id", "chunk_index", "chunk_no", "over_limit", "char_count", "token_count", "head", "tail"],
                )

    return measure


def _planned(limit: int, overlap: int):
    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for content in batch.column("content").to_pylist():
                content = (content or "").strip()
                n.append(len(Layout(content).cuts(limit, overlap)) if content else 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int32())], ["id", "planned"])

    return plan


def audit(documents: DataFrame, pieces: DataFrame, *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The defects (document_id, defect) of stored pieces, each once a document.

    ``documents``: id, content.  ``pieces``: chunk_no, id, document_id, chunk_index, content,
    lexical_text, char_count, token_count; of pieces with one id the first chunk_no counts.
    ``uncut``: the splitter would cut the document, but it has no piece.  ``over_limit``,
    ``char_count``, ``token_count``: some piece exceeds the limit, or states another length or
    number of blank-separated words than it has.  ``gap``: the indices aren't 0 to n-1.
    ``overlap``: a piece doesn't start with the last ``overlap`` characters of the one before.

    Defined cases: null contents count as empty, null counts as wrong, null indices as a gap;
    pieces without document id are ignored; pieces of unknown documents are audited all the same.
    """
    flags = "id string, document_id string, chunk_index int, chunk_no bigint, over_limit boolean, char_count boolean, token_count boolean, head string, tail string"
    cols = ["id", "document_id", "chunk_index", "chunk_no", "content", "lexical_text", "char_count", "token_count"]
    measured = pieces.where(F.col("document_id").isNotNull()).select(*cols).mapInArrow(_measure(limit, overlap), flags)
    fields = ["document_id", "chunk_index", "over_limit", "char_count", "token_count", "head", "tail"]
    once = measured.groupBy("id").agg(F.min_by(F.struct(*fields), "chunk_no").alias("p")).select("p.*")
    per = once.groupBy("document_id").agg(
        *(F.max(c).alias(c) for c in ("over_limit", "char_count", "token_count")),
        ((F.count("*") != F.count_distinct("chunk_index")) | (F.min("chunk_index") != 0) | (F.max("chunk_index") != F.count("*") - 1) | F.min("chunk_index").isNull()).alias("gap"),
    )
    named = [F.when(F.col(c), F.lit(c)) for c in ("over_limit", "gap", "char_count", "token_count")]
    single = per.select("document_id", F.explode(F.filter(F.array(*named), lambda x: x.isNotNull())).alias("defect"))
    before = once.select("document_id", (F.col("chunk_index") + 1).alias("chunk_index"), "tail")
    after = once.select("document_id", "chunk_index", "head")
    broken = before.join(after, ["document_id", "chunk_index"]).where(~F.col("head").startswith(F.col("tail"))).select("document_id", F.lit("overlap").alias("defect")).distinct()
    planned = documents.select(F.col("id").cast("string").alias("id"), "content").mapInArrow(_planned(limit, overlap), "id string, planned int").where("planned > 1")
    uncut = planned.select(F.col("id").alias("document_id")).join(per.select("document_id"), "document_id", "left_anti").select("document_id", F.lit("uncut").alias("defect")).distinct()
    return single.unionByName(broken).unionByName(uncut)
