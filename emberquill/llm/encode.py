"""Token ids of a whole corpus by a public tokenizer, with offsets, and back to text.

Method.  The tokenizers library encodes Arrow batches; the vocabulary file is sent along with the job,
whatever machine it lies on, and each worker loads it once.
Offsets come as characters of the text.  Decoding maps every token's letters back to the bytes
they stand for and decodes all bytes together, so characters split over tokens come back whole.

Scale.  Row by row in place, no shuffle; batches are cut by characters, so long texts don't pile up.
"""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

#: Characters encoded at a time.
CHARS = 2_000_000


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of a public vocabulary file: EMBERQUILL_TOKENIZERS, the installed files, or /opt/tokenizers."""
    folder = os.environ.get("EMBERQUILL_TOKENIZERS")
    if folder is None:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


def _sent(spark: SparkSession, path: str) -> str:
    """Sends a vocabulary file to all executors; the name they find it by.  A missing file fails here."""
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no vocabulary file {path}")
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def _lists(values: list, kind: pa.DataType) -> pa.ListArray:
    flat = np.fromiter((x for v in values for x in v), np.int64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(v) for v in values])], pa.int32()), pa.array(flat, kind))


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHARS:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def encode(rows: DataFrame, *, key: str, path: str | None = None, offsets: bool = False) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row's ``text``, without special tokens.

    With ``offsets`` also ``starts`` and ``ends``: each token's place in characters of the text; a
    character split over tokens is given to each of them.

    Defined cases: null and empty texts give empty lists; blank texts are encoded like any other;
    strings that name special tokens are ordinary text; null keys and repeated rows are kept.
    """
    name = _sent(rows.sparkSession, path or vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(SparkFiles.get(name))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys = batch.column(key)
            for a, b in _slices(texts):
                done = (tokenizer.encode_batch if offsets else getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch))(texts[a:b], add_special_tokens=False)
                cols = [keys.slice(a, b - a), _lists([e.ids for e in done], pa.int32())]
                if offsets:
                    cols += [_lists([[o[k] for o in e.offsets] for e in done], pa.int32()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(cols, [key, "ids", "starts", "ends"][: len(cols)])

    extra = ", starts array<int>, ends array<int>" if offsets else ""
    return rows.select(key, "text").mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, ids array<int>{extra}")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in own}
    for k, b in enumerate(b for b in range(256) if b not in set(own)):
        table[chr(0x100 + k)] = b
    return table


def decode(rows: DataFrame, *, key: str, path: str | None = None) -> DataFrame:
    """``key`` and ``text`` of every row's ``ids``; null ids give null, bytes that form no character U+FFFD."""
    name = _sent(rows.sparkSession, path or vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, letters = _tokenizer(SparkFiles.get(name)), byte_letters()
        vocab = [b""] * tokenizer.get_vocab_size()
        for token, i in tokenizer.get_vocab().items():
            vocab[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for batch in batches:
            texts = [None if ids is None else b"".join(vocab[i] for i in ids).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], [key, "text"])

    return rows.select(key, "ids").mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, text string")
