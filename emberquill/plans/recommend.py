"""End-to-end recommendation for a batch of queries: two retrievals, union, affinities, blend, total order.

Everything carries ``query_id``; there is no loop over queries.  Queries and types are stated sets: both
are retrieved for in one pass over the corpus, which carries its entities along.  An entity's profile is
the mean of its vectors and the terms its texts affirm; both are summed inside every task first, so an
entity with a third of all texts is summed where its texts are, and its texts are never joined together.
Affinities are one array an entity and query, so candidates meet them by their own keys only.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberquill.functions import text as T
from emberquill.functions import vectors as V
from emberquill.operators import retrieval as R
from emberquill.operators import scoring as S
from emberquill.session import local, materialise

#: The greatest fused score: first in both branches.
BEST = 2.0 / (R.RRF_K + 1)
#: Keys a task sums before it hands them on.
HELD = 50_000


def _sums(size: int):
    """Per task: each key's number of vectors and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([s for s, _ in held.values()], pa.list_(pa.float64())), pa.array([n for _, n in held.values()], pa.int64())], ["id", "total", "n"])

        for batch in batches:
            column = batch.column("vector")
            fits = np.flatnonzero(np.array([v is not None and len(v) == size for v in column.to_pylist()], bool)) if batch.num_rows else np.empty(0, np.int64)
            ids = batch.column("id").take(pa.array(fits)).to_numpy()
            v = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(fits), size)
            keys, where = np.unique(ids, return_inverse=True)
            total = np.zeros((len(keys), size))
            np.add.at(total, where, v)
            for key, row, n in zip(keys.tolist(), total, np.bincount(where, minlength=len(keys)).tolist()):
                before, count = held.get(key, (0.0, 0))
                held[key] = before + row, count + n
            if len(held) > HELD:
                yield out()
                held.clear()
        yield out()

    return run


def mean_vectors(rows: DataFrame, size: int) -> DataFrame:
    """id (bigint) and ``vector``: the mean of each id's vectors of ``size`` places at length one, 8 digits."""
    parts = rows.where(F.col("vector").isNotNull() & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(_sums(size), "id bigint, total array<double>, n bigint")
    return V.mean_vectors(parts.select("id", F.transform("total", lambda x: x / F.col("n")).alias("mean"), "n"), ["id"], "mean", F.col("n")).withColumnRenamed("mean", "vector")


def affirmed_ids(rows: DataFrame, terms: list[str]) -> DataFrame:
    """id and ``terms``: the places in a list of canonical terms of those that a text of the id affirms, each once."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for k, t in enumerate(terms):
            machine.add_word(t, (k, t))
        machine.make_automaton()
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            at, held = [], []
            for key, text in zip(batch.column("id").to_pylist(), batch.column("low").to_pylist()):
                for k, t in dict.fromkeys(m for _, m in machine.iter(text)) if terms else ():
                    if (key, k) not in seen and T.affirms(text, t):
                        seen.add((key, k))
                        at.append(key)
                        held.append(k)
            if len(seen) > HELD:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held, pa.int32())], ["id", "term"])

    low = rows.where(F.col("text").isNotNull() & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), T.behaviour("text").alias("low"))
    return low.mapInArrow(find, "id bigint, term int").groupBy("id").agg(F.collect_set("term").alias("terms"))  # at most all terms


def profile_affinities(vectors: DataFrame, texts: DataFrame, types: list, prototypes: np.ndarray, terms: list[tuple[str, str, float]]) -> DataFrame:
    """id and ``affinity``, an array in the order of ``types``: 0.8 of the clipped cosine to each prototype plus 0.2 of the share of the type's affirmed terms.

    ``vectors``: id, vector; ``texts``: id, text; ``terms``: (type, canonical term, weight).  Ids
    without a vector have no row.
    """
    size, names = prototypes.shape[1], sorted({t for _, t, _ in terms})
    norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
    unit = prototypes / np.where(norms > 0, norms, 1)
    weights = np.zeros((len(names) + 1, len(types)))
    places, columns = {t: k for k, t in enumerate(names)}, {str(t): k for k, t in enumerate(types)}
    for kind, term, weight in terms:
        if kind in columns:
            weights[places[term], columns[kind]] += weight
    whole = weights.sum(axis=0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array(batch.column("vector").to_pylist(), float).reshape(batch.num_rows, size)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            held = np.array([weights[own].sum(axis=0) if own else weights[-1] for own in batch.column("terms").to_pylist()]).reshape(batch.num_rows, len(types))
            out = np.clip(0.8 * np.clip((v / np.where(n > 0, n, 1)) @ unit.T, 0, 1) + 0.2 * held / np.where(whole > 0, whole, 1), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(out), pa.list_(pa.float64()))], ["id", "affinity"])

    joined = mean_vectors(vectors, size).join(affirmed_ids(texts, names), "id", "left")
    return joined.select("id", "vector", "terms").mapInArrow(score, "id bigint, affinity array<double>")


def recommend(queries: DataFrame, vectors: DataFrame, texts: DataFrame, prototypes: DataFrame, vocabulary: DataFrame, *, k: int = 3, branch: int = R.BRANCH) -> DataFrame:
    """query_id, entity_id, semantic, personality, typed, total, rank: the ``k`` best entities of every query.

    ``queries``: query_id (from 0 to 2**62), text, vector, type (or null), at most FEW rows; ``vectors``:
    chunk_id, entity_id, vector; ``texts``: chunk_id, entity_id, text; ``prototypes``: type, prototype
    (an array), profile_text; ``vocabulary``: trait (a type), term, weight.  A query with a type also
    retrieves by that type's profile; what only that finds has semantic 0.
    """
    if not 1 <= k <= 10:
        raise ValueError("k is from 1 to 10")
    kinds = sorted(prototypes.limit(S.FEW + 1).collect(), key=lambda r: r["type"])
    terms = [tuple(r) for r in S.best_terms(vocabulary).select("trait", "canonical", "weight").limit(S.FEW + 1).collect()]
    if max(len(kinds), len(terms)) > S.FEW:
        raise ValueError(f"more than {S.FEW} prototypes or terms")
    queries = local(queries, S.FEW)
    types, matrix = [r["type"] for r in kinds], np.array([r["prototype"] for r in kinds], float).reshape(len(kinds), -1)
    own_kinds = queries.sparkSession.createDataFrame([(i, r["profile_text"], [float(x) for x in r["prototype"]]) for i, r in enumerate(kinds)], "kind long, text string, vector array<double>")
    place = F.lit(None).cast("int")
    for i, t in enumerate(types):
        place = F.when(F.col("type") == F.lit(t), F.lit(i)).otherwise(place)
    queries = queries.withColumn("place", place)
    doubles = F.transform("vector", lambda x: x.cast("double")).alias("vector")
    asked = queries.select((F.col("query_id") * 2).alias("query_id"), "text", doubles).unionByName(own_kinds.select((F.col("kind") * 2 + 1).alias("query_id"), "text", "vector"))
    found = materialise(R.hybrid(vectors, texts, None, asked, branch=branch), "found")
    by_text = found.where("query_id % 2 = 0").withColumn("query_id", F.shiftright("query_id", 1))
    by_kind = found.where("query_id % 2 = 1").withColumn("place", F.shiftright("query_id", 1).cast("int")).drop("query_id")
    by_type = queries.where(F.col("place").isNotNull()).select("query_id", "place").join(by_kind, "place").drop("place")
    candidates = materialise(R.unite_candidates(by_text, by_type), "candidates")

    wanted = candidates.select("entity_id").distinct()
    of_entities = lambda df, c: df.join(wanted, "entity_id", "left_semi").select(F.col("entity_id").alias("id"), c)
    own = profile_affinities(of_entities(vectors, "vector"), of_entities(texts, "text"), types, matrix, terms).select(F.col("id").alias("entity_id"), F.col("affinity").alias("own"))
    of_queries = profile_affinities(queries.select(F.col("query_id").alias("id"), doubles), queries.select(F.col("query_id").alias("id"), "text"), types, matrix, terms)
    asked = of_queries.select(F.col("id").alias("query_id"), F.col("affinity").alias("asked"))
    rows = candidates.join(queries.select("query_id", "place"), "query_id").join(asked, "query_id", "left").join(own, "entity_id", "left")
    none = F.array().cast("array<double>")
    place = F.when(F.col("own").isNotNull(), F.col("place"))
    parts = S.components(F.col("retrieval_score") / BEST, F.coalesce("asked", none), F.coalesce("own", none), place)
    scored = rows.select("query_id", "entity_id", parts.alias("c"), "evidence").select("query_id", "entity_id", "c.*", "evidence")
    return S.final_order(scored, "query_id", [F.desc("total"), F.desc("semantic"), F.desc("personality"), F.asc("entity_id")], k)
