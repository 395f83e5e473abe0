"""Embedding of chunks in batches through a pluggable encoder, and prototypes of profiles.

An encoder is a function from a list of texts to a matrix (texts x dimensions).  The default is a
deterministic feature-hashing encoder, so the engine runs without a model; a model is plugged in by
passing its own function.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberquill.functions import vectors as V
from emberquill.functions.text import fixed_windows

BATCH, DIMENSION = 64, 64
Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(texts: list[str], dimension: int = DIMENSION) -> np.ndarray:
    """Signed counts of words and character trigrams in ``dimension`` buckets, at length one; a text without any is zero."""
    out = np.zeros((len(texts), dimension))
    for i, text in enumerate(texts):
        low = text.lower()
        for part in [*re.findall(r"\w+", low), *(low[k : k + 3] for k in range(len(low) - 2))]:
            h = zlib.crc32(part.encode())
            out[i, h % dimension] += 1.0 if h & 0x80000000 else -1.0
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1)


def embed(chunks: DataFrame, *, encoder: Encoder = hashing_encoder, batch: int = BATCH, dimension: int = DIMENSION) -> DataFrame:
    """chunk_id, embedding, content_hash, status (ready or failed) and error of every chunk.

    Chunks are encoded ``batch`` at a time; if a batch fails, or gives vectors of a wrong shape,
    not finite or of length zero, its chunks are failed and the others are not touched.  A null
    content fails alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids, texts, hashes = (rows.column(c).to_pylist() for c in ("chunk_id", "content", "content_hash"))
            vectors: list = [None] * len(ids)
            errors: list = ["no content" if t is None else None for t in texts]
            usable = [i for i, t in enumerate(texts) if t is not None]
            for at in range(0, len(usable), batch):
                own = usable[at : at + batch]
                try:
                    matrix = np.asarray(encoder([texts[i] for i in own]), float)
                    if matrix.shape != (len(own), dimension) or not np.isfinite(matrix).all() or (np.linalg.norm(matrix, axis=1) == 0).any():
                        raise ValueError("vectors of a wrong shape, not finite or of length zero")
                    for i, v in zip(own, matrix):
                        vectors[i] = v.tolist()
                except Exception as e:  # the batch fails, the others go on
                    for i in own:
                        errors[i] = f"{type(e).__name__}: {e}"[:200]
            status = ["ready" if v is not None else "failed" for v in vectors]
            yield pa.RecordBatch.from_arrays([rows.column("chunk_id"), pa.array(vectors, pa.list_(pa.float64())), pa.array(hashes, pa.string()), pa.array(status), pa.array(errors, pa.string())], ["chunk_id", "embedding", "content_hash", "status", "error"])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", "content", "content_hash").mapInArrow(run, f"chunk_id {kind}, embedding array<double>, content_hash string, status string, error string")


def outcome(embedded: DataFrame) -> DataFrame:
    """One row: chunks embedded and failed, and one of the errors."""
    return embedded.agg(F.sum((F.col("status") == "ready").cast("bigint")).alias("embedded"), F.sum((F.col("status") == "failed").cast("bigint")).alias("failed"), F.max("error").alias("last_error"))


def prototypes(profiles: DataFrame, *, encoder: Encoder = hashing_encoder, width: int = 64, dimension: int = DIMENSION) -> DataFrame:
    """type and prototype: the mean of a profile's windows of ``width`` characters, weighted by their length, at length one."""
    windows = profiles.select("type", F.posexplode(fixed_windows("text", width)).alias("place", "content"))
    keyed = windows.select(F.struct("type", "place", F.length("content").alias("n")).alias("k"), F.to_json(F.struct("type", "place")).alias("chunk_id"), "content", F.lit(None).cast("string").alias("content_hash"))
    done = embed(keyed, encoder=encoder, dimension=dimension).where("status = 'ready'").select("chunk_id", "embedding")
    rows = keyed.select("chunk_id", "k.type", "k.n").join(done, "chunk_id")
    return V.mean_vectors(rows, ["type"], "embedding", F.col("n")).withColumnRenamed("embedding", "prototype")
