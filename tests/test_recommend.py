"""The recommendation pipeline against a plain computation, one query at a time."""

import math
import random

import numpy as np
import pytest

from emberquill.functions import text as T
from emberquill.operators import retrieval as R
from emberquill.plans import recommend as P

WORDS = "quiet calm proud bright guard keeps river stone amber lantern feather hollow 冷靜 守護".split()
TERMS = [("0", "quiet", 2.0), ("0", "Calm", 1.0), ("1", "proud", 2.0), ("1", "ＰＲＯＵＤ", 3.0), ("2", "guard", 1.0), ("2", "守護", 2.0)]


def corpus(seed):
    rng = random.Random(seed)
    gen = np.random.default_rng(seed)
    texts = [(i, rng.choice([1, 1, 1, *range(2, 12), None]), " ".join(rng.choices([*WORDS, "not", ","], k=rng.randrange(3, 14)))) for i in range(160)]
    vectors = [(i, e, gen.normal(size=6).round(3).tolist()) for i, e, _ in texts if i % 4]
    prototypes = [(t, gen.normal(size=6).round(3).tolist(), " ".join(rng.choices(WORDS, k=3))) for t in range(3)]
    queries = [(q, " ".join(rng.choices(WORDS, k=4)) if q % 5 else None, gen.normal(size=6).round(3).tolist() if q % 3 else None, rng.choice([None, 0, 1, 2])) for q in range(12)]
    return texts, vectors, prototypes, queries


def unit(v):
    return np.array(v) / np.linalg.norm(v)


def entities(texts, vectors, text, vector, branch):
    """entity -> (score, evidence) of the best ``branch`` entities of one query."""
    dense = sorted(((-round(float(unit(v) @ unit(vector)), 10), c) for c, _, v in vectors), key=lambda x: x)[:branch] if vector is not None else []
    asked = set(list(dict.fromkeys(R.WORD.findall(text.lower())))[:32]) if text else set()
    held = [(-sum(t in asked for t in R.WORD.findall(x.lower())), c) for c, _, x in texts]
    lexical = sorted(h for h in held if h[0])[:branch]
    ranks: dict = {}
    for k, found in enumerate((dense, lexical)):
        for place, (_, chunk) in enumerate(found, 1):
            ranks.setdefault(chunk, [None, None])[k] = place
    own = {c: e for c, e, _ in texts}
    by: dict = {}
    for chunk, rs in ranks.items():
        if own[chunk] is not None:
            best = min(r for r in rs if r)
            by.setdefault(own[chunk], []).append((-round(sum(1 / (60 + r) for r in rs if r), 12), best, chunk, sum(1 / (60 + r) for r in rs if r)))
    scored = []
    for e, rows in by.items():
        top = sorted(rows)[:3]
        rrf = [r[3] for r in top]
        scored.append((-round(0.75 * max(rrf) + 0.25 * sum(rrf) / len(rrf), 10), -round(max(rrf), 10), min(r[1] for r in top), e))
    return {e: -s for s, _, _, e in sorted(scored)[: R.BRANCH]}


def affinity(vectors, texts, prototypes):
    if not vectors:
        return None
    mean = np.mean(np.array(vectors), axis=0)
    mean = np.round(mean / np.linalg.norm(mean), 8)
    best: dict = {}
    for t, term, w in TERMS:
        key = (t, T.canonical_value(term))
        best[key] = max(best.get(key, 0.0), w)
    said = [T.canonical_value(x) for x in texts if x is not None]
    out = []
    for t, p, _ in prototypes:
        weights = {term: w for (k, term), w in best.items() if k == str(t)}
        share = sum(w for term, w in weights.items() if any(T.affirms(x, term) for x in said)) / sum(weights.values())
        out.append(min(1, max(0, 0.8 * min(1, max(0, float(unit(mean) @ unit(p)))) + 0.2 * share)))
    return np.array(out)


def plainly(texts, vectors, prototypes, queries, k, branch):
    out = {}
    kinds = {t: entities(texts, vectors, w, p, branch) for t, p, w in prototypes}
    profiles = {e: affinity([v for _, x, v in vectors if x == e], [t for _, x, t in texts if x == e], prototypes) for e in {e for _, e, _ in texts if e is not None}}
    for q, text, vector, kind in queries:
        found = {**{e: 0.0 for e in (kinds[kind] if kind is not None else ())}, **entities(texts, vectors, text, vector, branch)}
        asked = affinity([vector] if vector is not None else [], [text], prototypes)
        rows = []
        for e, score in found.items():
            semantic, own = min(1, score / P.BEST), profiles[e]
            both = asked is not None and own is not None and np.linalg.norm(asked) > 0 and np.linalg.norm(own) > 0
            personality = min(1, max(0, float(unit(asked) @ unit(own)))) if both else 0.0
            total = 0.75 * semantic + 0.25 * personality if both else semantic
            typed = None if kind is None or own is None else float(own[kind])
            total = total if typed is None else 0.75 * total + 0.25 * typed
            rows.append((-round(total, 8), -round(semantic, 8), -round(personality, 8), e, typed))
        out[q] = [(r[3], -r[0], -r[1], -r[2], r[4]) for r in sorted(rows)[:k]]
    return out


@pytest.mark.parametrize("seed,branch", [(1, 50), (2, 5)])
def test_equals_a_plain_computation(spark, seed, branch):
    texts, vectors, prototypes, queries = corpus(seed)
    frame = spark.createDataFrame
    got = P.recommend(
        frame(queries, "query_id long, text string, vector array<double>, type int"), frame(vectors, "chunk_id long, entity_id long, vector array<double>").repartition(3), frame(texts, "chunk_id long, entity_id long, text string").repartition(5),
        frame(prototypes, "type int, prototype array<double>, profile_text string"), frame(TERMS, "trait string, term string, weight double"), k=4, branch=branch,
    )
    want = plainly(texts, vectors, prototypes, queries, 4, branch)
    rows: dict = {}
    for r in sorted(got.collect(), key=lambda r: (r["query_id"], r["rank"])):
        rows.setdefault(r["query_id"], []).append((r["entity_id"], r["total"], r["semantic"], r["personality"], r["typed"]))
    assert {q: [e for e, *_ in found] for q, found in rows.items()} == {q: [e for e, *_ in found] for q, found in want.items() if found}
    for q, found in rows.items():
        for a, b in zip(found, want[q]):
            assert all((x is None and y is None) or math.isclose(x, y, abs_tol=2e-7) for x, y in zip(a, b))
