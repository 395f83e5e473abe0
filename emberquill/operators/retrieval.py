"""Dense and lexical top-k, rank fusion and entity aggregation, for batches of queries.

Queries are a stated set: they go to the workers in blocks of a checked size, and every block
scans the corpus once.  Scores are matrix products over slices of Arrow batches, for words over lists
of the queries that ask for each; a task keeps its k best of every query in the final order, ties
included, so the shuffle carries k rows a query and partition and no more.  A corpus table may carry
``entity_id`` (bigint): it then comes along with its chunks, and nothing is joined to find it.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from emberquill.functions.vectors import dot, norm
from emberquill.session import in_blocks

#: Queries sent to the workers at a time, scores held at a time, digits to which scores are compared, constants of fusion.
BLOCK, CELLS = 4_000, 2_000_000
DIGITS = 10
RRF_K, BRANCH, EVIDENCE = 60, 50, 3
WORD = re.compile(r"\w+")
#: Stands for a null entity inside a task.
NONE = np.iinfo(np.int64).min


def _ranked(found: DataFrame, k: int, score: str, rank: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def first_k(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of every query: score descending, then id ascending."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    starts = np.r_[True, q[1:] != q[:-1]] if len(q) else np.empty(0, bool)
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(starts, np.arange(len(q)), 0)) if len(q) else np.empty(0, np.int64)
    return order[place < k]


class Best:
    """A task's k best chunks of every query."""

    def __init__(self, q_ids: np.ndarray, k: int) -> None:
        self.q_ids, self.k, self.size, self.most = q_ids, k, 0, 2 * k * max(len(q_ids), 1) + 100_000
        self.held: list[tuple[np.ndarray, ...]] = []

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, entities: np.ndarray) -> None:
        keep = first_k(query, score, ids, self.k)
        self.held.append(tuple(c[keep] for c in (query, score, ids, entities)))
        self.size += len(keep)
        if self.size > self.most:
            self.cut()

    def matrix(self, scores: np.ndarray, ids: np.ndarray, entities: np.ndarray) -> None:
        """Scores of chunks x queries."""
        if len(scores) > self.k:  # what is under the k-th of its query in this slice can't be among its best
            edge = np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k]
            place, query = np.nonzero(scores >= edge)
        else:
            place, query = (x.ravel() for x in np.indices(scores.shape))
        self.add(query, scores[place, query], ids[place], entities[place])

    def cut(self) -> None:
        query, score, ids, entities = (np.concatenate(c) for c in zip(*self.held))
        keep = first_k(query, score, ids, self.k)
        self.held, self.size = [(query[keep], score[keep], ids[keep], entities[keep])], len(keep)

    def rows(self, kind: pa.DataType) -> Iterator[list[pa.Array]]:
        """query_id, chunk_id, score, entity_id."""
        if self.held:
            self.cut()
            query, score, ids, entities = self.held[0]
            yield [pa.array(self.q_ids[query]), pa.array(ids), pa.array(score).cast(kind), pa.array(entities, mask=entities == NONE)]


def _entities(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("entity_id").fill_null(int(NONE)).to_numpy() if "entity_id" in batch.schema.names else np.full(batch.num_rows, NONE)


def _carried(corpus: DataFrame) -> list:
    return [F.col("entity_id").cast("long").alias("entity_id")] if "entity_id" in corpus.columns else []


def _searched(corpus: DataFrame, column: str, queries: DataFrame, k: int, score: str, kind: str, worker) -> DataFrame:
    """query_id, chunk_id, the score, and entity_id if the corpus has it, of all blocks of queries; ``worker`` makes the function of a block."""
    if not 1 <= k <= 200:
        raise ValueError("k is from 1 to 200")
    rest, found = _carried(corpus), None
    rows = corpus.where(F.col(column).isNotNull() & F.col("chunk_id").isNotNull()).select("chunk_id", column, *rest)
    for block in in_blocks(queries.where(F.col(column).isNotNull()).select("query_id", column), "query_id", BLOCK):
        part = rows.mapInArrow(worker(block), f"query_id bigint, chunk_id bigint, {score} {kind}, entity_id bigint")
        found = part if found is None else found.unionByName(part)
    return found if rest else found.drop("entity_id")


def unit_rows(column: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that have this size, are finite and not zero, and these vectors at length one."""
    fits = np.flatnonzero(pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False) == size)
    v = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(fits), size)
    norms = np.linalg.norm(v, axis=1)
    good = np.isfinite(norms) & (norms > 0)
    return fits[good], v[good] / norms[good, None]


def _asked(rows: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the usable queries and their vectors at length one, side by side."""
    usable = [(r["query_id"], np.array(r["vector"], float)) for r in rows if len(r["vector"]) == size]
    usable = [(i, v) for i, v in usable if np.isfinite(v).all() and np.linalg.norm(v) > 0]
    return np.array([i for i, _ in usable], np.int64), np.array([v / np.linalg.norm(v) for _, v in usable]).reshape(len(usable), size).T


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = BRANCH, *, dimension: int | None = None) -> DataFrame:
    """query_id, chunk_id, dense_score (cosine, rounded), dense_rank from 1 to k; ties go to the smaller chunk_id.

    ``vectors``: chunk_id (bigint), vector; ``queries``: query_id (bigint), vector.  Null vectors,
    vectors of another dimension (the first query's unless given), not finite or of length zero
    have no score; an empty side gives no rows.
    """

    def worker(rows: list):
        size = dimension or next((len(r["vector"]) for r in rows if r["vector"]), 0)
        q_ids, matrix = _asked(rows, size)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, step = Best(q_ids, k), max(1, CELLS // max(len(q_ids), 1))
            for whole in batches if len(q_ids) else ():
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    place, v = unit_rows(batch.column("vector"), size)
                    if len(place):
                        best.matrix(np.round(v @ matrix, DIGITS), batch.column("chunk_id").to_numpy()[place], _entities(batch)[place])
            for cols in best.rows(pa.float64()):
                yield pa.RecordBatch.from_arrays(cols, ["query_id", "chunk_id", "dense_score", "entity_id"])

        return score

    return _ranked(_searched(vectors, "vector", queries, k, "dense_score", "double", worker), k, "dense_score", "dense_rank")


def lexical_topk(texts: DataFrame, queries: DataFrame, k: int = BRANCH, *, most_tokens: int = 32) -> DataFrame:
    """query_id, chunk_id, matches, lexical_score, lexical_rank: texts that hold any token of the query.

    ``matches`` counts the places of the text that hold one of the first ``most_tokens`` distinct
    query tokens; the score is 0.1 m / (0.1 m + 1).  ``texts``: chunk_id, text; ``queries``:
    query_id, text.  Null texts match nothing; queries without tokens have no rows.
    """

    def worker(rows: list):
        asks: dict[str, list[int]] = {}
        q_ids = np.array([r["query_id"] for r in rows], np.int64)
        for q, r in enumerate(rows):
            for t in [t for t in dict.fromkeys(WORD.findall(r["text"].lower())) if any(c.isalnum() for c in t)][:most_tokens]:
                asks.setdefault(t, []).append(q)
        places = {t: p for p, t in enumerate(asks)}
        lengths = np.array([len(qs) for qs in asks.values()], np.int64)
        begins, asking = np.cumsum(lengths) - lengths, np.array([q for qs in asks.values() for q in qs], np.int64)

        def matches(text: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """text, query and matches of occurrences, each of which counts for every query that asks for its token."""
            seen, n = np.unique(text * len(places) + token, return_counts=True)
            text, token = np.divmod(seen, len(places))
            wide = lengths[token]
            at = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
            key, where = np.unique(np.repeat(text, wide) * len(q_ids) + asking[np.repeat(begins[token], wide) + at], return_inverse=True)
            text, query = np.divmod(key, len(q_ids))
            return text, query, np.bincount(where, weights=np.repeat(n, wide), minlength=len(key))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(q_ids, k)
            for batch in batches if places else ():
                ids, entities, texts = batch.column("chunk_id").to_numpy(), _entities(batch), batch.column("text").to_pylist()
                first, text, token, wide = 0, [], [], 0
                for i in range(batch.num_rows):
                    own = [p for t in WORD.findall(texts[i].lower()) if (p := places.get(t)) is not None]
                    text += [i - first] * len(own)
                    token += own
                    wide += int(lengths[own].sum()) if own else 0
                    if wide > CELLS or i + 1 == batch.num_rows:
                        if token:
                            t, q, n = matches(np.array(text, np.int64), np.array(token, np.int64))
                            best.add(q, n, ids[first + t], entities[first + t])
                        first, text, token, wide = i + 1, [], [], 0
            for cols in best.rows(pa.int64()):
                yield pa.RecordBatch.from_arrays(cols, ["query_id", "chunk_id", "matches", "entity_id"])

        return score

    found = _ranked(_searched(texts, "text", queries, k, "matches", "bigint", worker), k, "matches", "lexical_rank")
    return found.withColumn("lexical_score", F.round(0.1 * F.col("matches") / (0.1 * F.col("matches") + 1), DIGITS))


def fuse(dense: DataFrame, lexical: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion by query and chunk: the full outer join of both branches.

    A chunk repeated in a branch counts at its best rank.  Columns: query_id, chunk_id,
    dense_rank, dense_score, lexical_rank, lexical_score, rrf_score; entity_id if both branches have
    it, and a chunk for which they name different entities fails the query.
    """
    named = "entity_id" in dense.columns and "entity_id" in lexical.columns

    def best(df: DataFrame, r: str, s: str, e: str) -> DataFrame:
        return df.groupBy("query_id", "chunk_id").agg(F.min(r).alias(r), F.min_by(s, r).alias(s), *([F.min_by("entity_id", r).alias(e)] if named else []))

    both = best(dense, "dense_rank", "dense_score", "_d").join(best(lexical, "lexical_rank", "lexical_score", "_l"), ["query_id", "chunk_id"], "full_outer")
    part = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    both = both.withColumn("rrf_score", part("dense_rank") + part("lexical_rank"))
    if not named:
        return both
    clash = F.col("dense_rank").isNotNull() & F.col("lexical_rank").isNotNull() & ~F.col("_d").eqNullSafe(F.col("_l"))
    failed = F.raise_error(F.concat(F.lit("two entities for chunk "), F.col("chunk_id").cast("string"))).cast("bigint")
    return both.withColumn("entity_id", F.when(clash, failed).otherwise(F.coalesce("_d", "_l"))).drop("_d", "_l")


def lineage_conflicts(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """Chunks for which the two branches name different entities; fusion is sound if there is none."""
    a, b = (df.select("chunk_id", F.col("entity_id").alias(n)).distinct() for df, n in ((dense, "dense_entity"), (lexical, "lexical_entity")))
    return a.join(b, "chunk_id").where(~F.col("dense_entity").eqNullSafe(F.col("lexical_entity")))


def aggregate_entities(fused: DataFrame, chunks: DataFrame | None = None, limit: int = BRANCH, evidence: int = EVIDENCE) -> DataFrame:
    """The best entities of every query, by their ``evidence`` best chunks.

    ``chunks`` gives chunk_id -> entity_id; without it ``fused`` has entity_id.  score = 0.75 best + 0.25 mean.  Columns: query_id,
    entity_id, retrieval_score, best_chunk_score, best_branch_rank, evidence (chunk ids), position.
    """
    rank = F.least("dense_rank", "lexical_rank")  # ignores nulls
    named = fused if chunks is None else fused.drop("entity_id").join(chunks.select("chunk_id", "entity_id"), "chunk_id")
    rows = named.where(F.col("entity_id").isNotNull()).withColumn("best_rank", rank)
    order = Window.partitionBy("query_id", "entity_id").orderBy(F.desc(F.round("rrf_score", 12)), "best_rank", "chunk_id")
    top = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= evidence)
    scored = top.groupBy("query_id", "entity_id").agg(
        F.round(0.75 * F.max("rrf_score") + 0.25 * F.avg("rrf_score"), DIGITS).alias("retrieval_score"),
        F.round(F.max("rrf_score"), DIGITS).alias("best_chunk_score"),
        F.min("best_rank").alias("best_branch_rank"),
        F.transform(F.sort_array(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x["chunk_id"]).alias("evidence"),  # at most ``evidence``
    )
    total = Window.partitionBy("query_id").orderBy(F.desc("retrieval_score"), F.desc("best_chunk_score"), "best_branch_rank", "entity_id")
    return scored.withColumn("position", F.row_number().over(total)).where(F.col("position") <= limit)


def hybrid(vectors: DataFrame, texts: DataFrame, entities: DataFrame | None, queries: DataFrame, *, branch: int = BRANCH, limit: int = BRANCH) -> DataFrame:
    """Dense and lexical retrieval fused and aggregated; ``queries``: query_id, text, vector.  Without ``entities`` both corpora carry entity_id."""
    dense = dense_topk(vectors, queries.select("query_id", "vector"), branch)
    lexical = lexical_topk(texts, queries.select("query_id", "text"), branch)
    return aggregate_entities(fuse(dense, lexical), entities, limit)


def unite_candidates(text: DataFrame, typed: DataFrame, evidence: int = EVIDENCE) -> DataFrame:
    """Candidates of the text branch with those of the type branch added.

    Type-only candidates have retrieval_score 0; evidence keeps the text branch's first and adds
    new chunks of the other up to ``evidence``.
    """
    t = text.select("query_id", "entity_id", F.col("retrieval_score").alias("s"), F.col("evidence").alias("a"))
    o = typed.select("query_id", "entity_id", F.col("evidence").alias("b"))
    empty = F.array().cast(T.ArrayType(T.LongType()))
    joined = t.join(o, ["query_id", "entity_id"], "full_outer")
    a, b = F.coalesce("a", empty), F.coalesce("b", empty)
    merged = F.slice(F.concat(a, F.array_except(b, a)), 1, evidence)
    return joined.select("query_id", "entity_id", F.coalesce("s", F.lit(0.0)).alias("retrieval_score"), merged.alias("evidence"))


def visible_chunks(embeddings: DataFrame, models: DataFrame, chunks: DataFrame, documents: DataFrame, entities: DataFrame, *, model_id: int, dimension: int) -> DataFrame:
    """Chunks that may be searched: every stage current, ready, active and of the same content hash."""
    model = models.where((F.col("id") == model_id) & F.col("is_active") & F.col("normalize_embeddings") & (F.col("dimensions") == dimension)).select(F.col("id").alias("model_id"))
    e = embeddings.where((F.col("status") == "ready") & F.col("embedding").isNotNull()).select("chunk_id", "model_id", "embedding", F.col("content_hash").alias("embedded_hash"))
    c = chunks.where(F.col("is_current") & (F.col("status") == "ready")).select(F.col("id").alias("chunk_id"), "document_id", "content", "content_hash")
    d = documents.where(F.col("is_current") & (F.col("status") == "ready")).select(F.col("id").alias("document_id"), "entity_id", "source_key", "document_kind", "language_code")
    a = entities.where("is_active").select(F.col("id").alias("entity_id"))
    return e.join(F.broadcast(model), "model_id").join(c, "chunk_id").where("embedded_hash = content_hash").join(d, "document_id").join(a, "entity_id")


def rotation(size: int, seed: int = 7) -> np.ndarray:
    """A fixed random rotation: it spreads a vector evenly over its places, so that few bits hold each."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))[0]


def coded(vectors: DataFrame, size: int) -> DataFrame:
    """An index for approximate search: chunk_id, ``code`` (a byte a place of the rotated unit vector), ``scale`` and vector.

    Every usable vector of ``size`` places is indexed, each by itself: nothing is trained, and rows can be added at any time.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(size)
        for batch in batches:
            place, v = unit_rows(batch.column("vector"), size)
            v = v @ turn
            scale = np.abs(v).max(axis=1, initial=0) / 127
            code = np.round(v / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
            own = batch.take(pa.array(place))
            yield pa.RecordBatch.from_arrays([own.column("chunk_id"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), own.column("vector")], ["chunk_id", "code", "scale", "vector"])

    rows = vectors.where(F.col("vector").isNotNull() & F.col("chunk_id").isNotNull()).select("chunk_id", "vector")
    return rows.mapInArrow(encode, f"chunk_id bigint, code binary, scale double, vector {vectors.schema['vector'].dataType.simpleString()}")


def coded_topk(index: DataFrame, queries: DataFrame, size: int, k: int = 10, *, over: int = 4) -> DataFrame:
    """Approximate dense top-k: ``over`` * k rows a query by their codes, scored anew by their vectors.

    All codes are scanned, an eighth of the vectors' bytes; vectors are read of those few rows only.
    """
    found = None
    for rows in in_blocks(queries.where(F.col("vector").isNotNull()).select("query_id", "vector"), "query_id", BLOCK):
        q_ids, matrix = _asked(rows, size)
        turned = (rotation(size).T @ matrix).astype(np.float32)

        def score(batches: Iterator[pa.RecordBatch], q_ids=q_ids, turned=turned) -> Iterator[pa.RecordBatch]:
            best, step = Best(q_ids, over * k), max(1, CELLS // max(len(q_ids), 1))
            for whole in batches if len(q_ids) else ():
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(batch.num_rows, size).astype(np.float32)
                    best.matrix((code @ turned) * batch.column("scale").to_numpy()[:, None], batch.column("chunk_id").to_numpy(), np.full(batch.num_rows, NONE))
            for query, chunk, value, _ in best.rows(pa.float64()):
                yield pa.RecordBatch.from_arrays([query, chunk, value], ["query_id", "chunk_id", "near"])

        part = index.select("chunk_id", "code", "scale").mapInArrow(score, "query_id bigint, chunk_id bigint, near double")
        found = part if found is None else found.unionByName(part)
    few = _ranked(found, over * k, "near", "place").select("query_id", "chunk_id")
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", F.col("vector").alias("asked"))
    exact = F.round(dot(F.col("vector"), F.col("asked")) / (norm(F.col("vector")) * norm(F.col("asked"))), DIGITS)
    scored = index.select("chunk_id", "vector").join(few, "chunk_id").join(asked, "query_id").select("query_id", "chunk_id", exact.alias("dense_score"))
    return _ranked(scored, k, "dense_score", "dense_rank")


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """query_id and the share of its exact results that were found."""
    e = exact.groupBy("query_id").agg(F.collect_set("chunk_id").alias("e"))  # k ids
    f = found.groupBy("query_id").agg(F.collect_set("chunk_id").alias("f"))
    shared = F.size(F.array_intersect("e", F.coalesce("f", F.array().cast("array<bigint>"))))
    return e.join(f, "query_id", "left").select("query_id", F.round(shared / F.size("e"), 6).alias("recall"))


def measured(search: Callable[[DataFrame], DataFrame], queries: DataFrame, exact: DataFrame, *, samples: int = 50, warm: int = 5) -> dict[str, float]:
    """Recall against the exact result, latency (mean, median, 95th percentile, in milliseconds) and throughput of a search, one query at a time.

    A benchmark: at most ``samples`` queries, the first ``warm`` asked once before.  ``search`` maps queries to query_id and chunk_id.
    """
    asked = queries.orderBy("query_id").limit(samples)
    single = [queries.sparkSession.createDataFrame([r], queries.schema) for r in asked.collect()]
    if not single:
        return {"samples": 0}
    for q in single[:warm]:
        search(q).collect()
    taken, rows = [], []
    for q in single:
        start = time.perf_counter()
        rows += [(r["query_id"], r["chunk_id"]) for r in search(q).collect()]
        taken.append(1000 * (time.perf_counter() - start))
    found = queries.sparkSession.createDataFrame(rows, "query_id bigint, chunk_id bigint")
    mean = recall(exact.join(asked.select("query_id"), "query_id", "left_semi"), found).agg(F.avg("recall")).first()[0]
    return {"samples": len(single), "recall": mean, "mean_ms": float(np.mean(taken)), "p50_ms": float(np.percentile(taken, 50)), "p95_ms": float(np.percentile(taken, 95)), "queries_per_second": 1000 * len(taken) / max(sum(taken), 1e-9)}
