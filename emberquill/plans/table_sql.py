"""DuckDB SQL for the queries of ``table_queries``."""

from __future__ import annotations

from emberquill.plans.retrieval_queries import _DENSE, _FINAL

_BLANK = r"[\s\p{Z}\x1c-\x1f\x{85}]+"
_RANKED = _DENSE.replace("dense_rank <= 50", "dense_rank <= 10")
_CASES = f"""WITH {_RANKED}, c AS (SELECT vec_id AS case_id, label FROM embeddings WHERE vec_id % 100 = 0),
j AS (SELECT case_id, e.vec_id AS item, 1 + e.vec_id % 3 AS grade FROM embeddings e JOIN c USING (label)),
n AS (SELECT query_id AS case_id, count(*) AS n FROM dn GROUP BY 1),
i AS (SELECT case_id, item, grade, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, item) AS place FROM j),
s AS (SELECT case_id, count(*) AS relevant, count(*) FILTER (grade >= 2) AS high, coalesce(sum((2.0 ** grade - 1) / log2(place + 1)) FILTER (place <= n), 0) AS ideal FROM i LEFT JOIN n USING (case_id) GROUP BY 1),
h AS (SELECT j.case_id, count(*) AS hits, count(*) FILTER (grade >= 2) AS hh, min(dense_rank) AS first, sum((2.0 ** grade - 1) / log2(dense_rank + 1)) AS dcg, count(*) FILTER (dense_rank <= 3) AS top, coalesce(sum(grade) FILTER (dense_rank <= 3), 0) AS tg FROM dn JOIN j ON j.case_id = query_id AND j.item = chunk_id GROUP BY 1),
m AS (SELECT case_id, coalesce(hits / relevant, 0) AS recall, coalesce(CASE WHEN high > 0 THEN hh / high END, 0) AS high_recall, coalesce(1.0 / first, 0) AS mrr, coalesce(CASE WHEN ideal > 0 THEN dcg / ideal END, 0) AS ndcg,
  CASE WHEN first <= 3 THEN 1.0::DOUBLE ELSE 0 END AS hit_at_3, coalesce(top / 3.0, 0) AS precision_at_3, coalesce(tg / 9.0, 0) AS weighted_precision_at_3, CASE WHEN first <= 3 THEN 1.0 / first ELSE 0 END AS mrr_at_3 FROM s LEFT JOIN h USING (case_id))"""
_NAMES = ("recall", "high_recall", "mrr", "ndcg", "hit_at_3", "precision_at_3", "weighted_precision_at_3", "mrr_at_3")
_LATEST_GRADES = "SELECT case_id, pokemon_id, annotator, arg_max(grade, (created_at, annotation_id)) AS grade FROM annotation_quality_row WHERE annotator IS NOT NULL AND grade BETWEEN 0 AND 3 GROUP BY 1, 2, 3"
_FEEDBACK = f"""WITH {_FINAL}, im AS (SELECT request_id AS impression_id, 'v' || (request_id % 3)::VARCHAR AS algorithm_version, created_at FROM recommendation_request),
it AS (SELECT request_id AS impression_id, pokemon_id AS item_id, rank FROM f WHERE rank <= 3),
fb AS (SELECT impression_id, item_id, rank + CASE WHEN item_id % 10 = 0 THEN 1 ELSE 0 END AS rank, CASE WHEN item_id % 3 = 0 THEN 'not_match' ELSE 'match' END AS verdict,
  CASE WHEN item_id % 3 <> 0 THEN 'no_reason' WHEN item_id % 2 = 0 THEN 'wrong_type' ELSE 'wrong_mood' END AS reason FROM it WHERE (impression_id + item_id) % 4 = 0)"""
_ENTITIES = f"""e AS (SELECT pokedex_number::BIGINT AS entity_id, * FROM pokedex_final WHERE pokedex_number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pokedex_number::BIGINT ORDER BY loaded_at DESC NULLS LAST, source_row DESC) = 1),
x AS (SELECT *, CASE WHEN list_position(['gen-i', 'gen-ii', 'gen-iii', 'gen-iv', 'gen-v', 'gen-vi', 'gen-vii', 'gen-viii', 'gen-ix'], lower(trim(generation))) > 0 THEN list_position(['gen-i', 'gen-ii', 'gen-iii', 'gen-iv', 'gen-v', 'gen-vi', 'gen-vii', 'gen-viii', 'gen-ix'], lower(trim(generation)))::INTEGER END AS generation_no,
  CASE lower(trim(is_legendary)) WHEN 'true' THEN true WHEN 'false' THEN false END AS legendary FROM e),
b AS (SELECT entity_id, 1 AS slot, lower(trim(type_1)) AS code FROM x WHERE trim(type_1) <> '' AND lower(trim(type_1)) <> 'unknown' UNION ALL SELECT entity_id, 2, lower(trim(type_2)) FROM x WHERE trim(type_2) <> '' AND lower(trim(type_2)) <> 'unknown')"""
_SEARCH = "SELECT * FROM x WHERE (contains(lower(name_zh), 'or') OR contains(lower(name_en), 'or')) AND legendary = false"
_SENTENCES = f"""list_filter(list_transform(flatten(list_transform(regexp_split_to_array(text, '\\n+'), lambda p: regexp_extract_all(p, '[^。！？!?；;.]*[。！？!?；;.]|[^。！？!?；;.]+'))), lambda s: regexp_replace(s, '^{_BLANK}|{_BLANK}$', '', 'g')), lambda s: s <> '')"""
_CURRENT = "c AS (SELECT * FROM pokemon_knowledge_chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY chunk_no DESC) = 1)"
_PICK = ", ".join(f"CASE WHEN s.pokedex_number IS NULL THEN t.{c} ELSE s.{c} END AS {c}" for c in ("name_zh", "name_en", "type_zh", "habitat", "capture_rate"))
_DIFF = " OR ".join(f"t.{c} IS DISTINCT FROM s.{c}" for c in ("name_zh", "name_en", "type_zh", "habitat", "capture_rate"))


def _slice(kind: str, value: str) -> str:
    return f"SELECT '{kind}' AS slice, {value} AS value, case_id, pokemon_id, annotator, grade, final_grade FROM annotation_quality_row"


SQL = {
    "eval_cases": f"{_CASES} SELECT case_id, {', '.join(f'round({n}, 6) AS {n}' for n in _NAMES)} FROM m",
    "eval_metrics": f"{_CASES} SELECT count(*) AS cases, {', '.join(f'round(avg({n}), 6) AS {n}' for n in _NAMES)} FROM m",
    "rerank_gate": f"{_CASES}, a AS (SELECT avg(ndcg) AS n0, quantile_cont((case_id % 300)::DOUBLE, 0.95) AS l0, avg(ndcg) FILTER (case_id % 200 = 0) AS n1, quantile_cont((case_id % 300)::DOUBLE, 0.95) FILTER (case_id % 200 = 0) AS l1 FROM m) SELECT round(n1 - n0, 6) + 0 AS gain, round(l1 - l0, 4) + 0 AS added_p95_ms, round(n1 - n0, 6) >= 0.001 AND round(l1 - l0, 4) <= 250 AS accepted FROM a",
    "annotation_quality": f"""WITH s AS ({_slice('overall', "'all'")} UNION ALL {_slice('segment', "coalesce(segment, '')")} UNION ALL {_slice('query_length', "CASE WHEN query_length < 40 THEN 'short' WHEN query_length < 80 THEN 'medium' WHEN query_length IS NOT NULL THEN 'long' ELSE '' END")}),
i AS (SELECT slice, value, case_id, pokemon_id, count(DISTINCT annotator) FILTER (grade IS NOT NULL) AS p, count(DISTINCT grade) FILTER (annotator IS NOT NULL) AS g, max((final_grade IS NOT NULL)::INT) AS f FROM s GROUP BY 1, 2, 3, 4)
SELECT slice, value, count(DISTINCT case_id) AS case_count, count(*) AS candidate_count, round(count(*) FILTER (p >= 2) / count(*), 6) AS double_annotation_coverage,
  CASE WHEN count(*) FILTER (p >= 2) > 0 THEN round(count(*) FILTER (p >= 2 AND g > 1) / count(*) FILTER (p >= 2), 6) ELSE 0 END AS conflict_rate, round(sum(f) / count(*), 6) AS adjudication_coverage FROM i GROUP BY 1, 2""",
    "weighted_kappa": f"""WITH g AS ({_LATEST_GRADES}), p AS (SELECT a.annotator AS annotator_a, b.annotator AS annotator_b, a.grade AS ga, b.grade AS gb FROM g a JOIN g b ON a.case_id = b.case_id AND a.pokemon_id = b.pokemon_id AND a.annotator < b.annotator),
o AS (SELECT annotator_a, annotator_b, count(*) AS n, avg((ga - gb) ** 2 / 9.0) AS seen FROM p GROUP BY 1, 2),
l AS (SELECT annotator_a, annotator_b, ga, count(*) AS n FROM p GROUP BY 1, 2, 3), r AS (SELECT annotator_a, annotator_b, gb, count(*) AS n FROM p GROUP BY 1, 2, 3),
x AS (SELECT annotator_a, annotator_b, sum((ga - gb) ** 2 / 9.0 * l.n * r.n) AS e FROM l JOIN r USING (annotator_a, annotator_b) GROUP BY 1, 2)
SELECT annotator_a, annotator_b, n AS common_judgment_count, round(CASE WHEN e = 0 THEN CASE WHEN seen = 0 THEN 1.0 ELSE 0 END ELSE 1 - seen / (e / (n * n)) END, 6) + 0 AS quadratic_weighted_kappa FROM o JOIN x USING (annotator_a, annotator_b)""",
    "ready_cases": "WITH i AS (SELECT case_id, pokemon_id, count(DISTINCT annotator) FILTER (grade IS NOT NULL) AS p, max(final_grade) AS f FROM annotation_quality_row GROUP BY 1, 2) SELECT case_id, bool_and(p >= 2 AND f IS NOT NULL) AND coalesce(bool_or(f > 0), false) AS ready FROM i GROUP BY 1",
    "exported_cases": "WITH g AS (SELECT case_id, pokemon_id, max(final_grade) AS grade FROM annotation_quality_row WHERE final_grade > 0 GROUP BY 1, 2) SELECT case_id, query, (row_number() OVER (PARTITION BY case_id ORDER BY pokemon_id) - 1)::INTEGER AS place, pokemon_id, grade FROM evaluation_cases JOIN g USING (case_id)",
    "quality_rows": """WITH c AS (SELECT case_id, pokemon_id, max(final_grade) AS final_grade FROM annotation_quality_row GROUP BY 1, 2)
SELECT case_id, segment, query_length, pokemon_id, a.annotator, a.grade, final_grade FROM evaluation_cases e JOIN c USING (case_id) LEFT JOIN (SELECT case_id, pokemon_id, annotator, grade FROM annotation_quality_row WHERE grade BETWEEN 0 AND 3 AND annotator IS NOT NULL) a USING (case_id, pokemon_id)""",
    "percentile_summary": "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(max(value), 4) AS max FROM events WHERE value IS NOT NULL GROUP BY 1",
    "feedback_summary": f"{_FEEDBACK} SELECT (SELECT count(*) FROM im) AS total_impressions, count(DISTINCT impression_id) AS rated_impressions, round(count(DISTINCT impression_id) / (SELECT count(*) FROM im), 6) AS response_rate, count(*) AS total_feedback, round(count(*) FILTER (verdict = 'match') / count(*), 6) AS match_rate FROM fb",
    "feedback_by": f"""{_FEEDBACK}, j AS (SELECT fb.verdict, fb.reason, it.rank, im.algorithm_version FROM fb JOIN it USING (impression_id, item_id) LEFT JOIN im USING (impression_id)),
l AS (SELECT verdict, 'rank' AS dimension, rank::VARCHAR AS value FROM j UNION ALL SELECT verdict, 'reason', reason FROM j UNION ALL SELECT verdict, 'algorithm', algorithm_version FROM j)
SELECT dimension, value, count(*) AS feedback_count, round(count(*) FILTER (verdict = 'match') / count(*), 6) AS match_rate FROM l WHERE value IS NOT NULL GROUP BY 1, 2""",
    "feedback_checked": f"{_FEEDBACK} SELECT fb.impression_id, fb.item_id, fb.rank, CASE WHEN it.rank IS NULL THEN 'unknown_item' WHEN it.rank <> fb.rank THEN 'rank' END AS problem FROM fb LEFT JOIN it USING (impression_id, item_id)",
    "retention_purge": f"{_FEEDBACK}, k AS (SELECT * FROM im WHERE created_at >= TIMESTAMPTZ '2025-12-31 00:00:00+00' - INTERVAL 180 DAY) SELECT 'impressions' AS kept, count(*) AS n FROM k UNION ALL SELECT 'items', count(*) FROM it WHERE impression_id IN (SELECT impression_id FROM k) UNION ALL SELECT 'feedback', count(*) FROM fb WHERE impression_id IN (SELECT impression_id FROM k)",
    "catalog_page": f"WITH {_ENTITIES} SELECT entity_id, name_zh, name_en, generation_no FROM ({_SEARCH}) ORDER BY entity_id LIMIT 20 OFFSET 20",
    "catalog_total": f"WITH {_ENTITIES} SELECT count(*) AS total, ceil(count(*) / 20)::BIGINT AS pages FROM ({_SEARCH})",
    "catalog_escaped_search": f"WITH {_ENTITIES} SELECT entity_id, abilities FROM x WHERE contains(lower(abilities), '_gleam') OR contains(lower(egg_groups), '_gleam')",
    "catalog_type_exists": f"WITH {_ENTITIES} SELECT entity_id, name_en FROM x WHERE entity_id IN (SELECT entity_id FROM b JOIN type_definitions USING (code) WHERE lower(code) = 'water' OR lower(type_definitions.name_en) = 'water' OR type_definitions.name_zh = 'WATER')",
    "entity_detail": f"""WITH {_ENTITIES}, d AS (SELECT pokemon_id AS entity_id, count(*) AS documents, array_to_string(list_sort(list(DISTINCT source_key)), ',') AS sources FROM pokemon_knowledge_documents WHERE is_current GROUP BY 1)
SELECT entity_id, name_zh, CASE WHEN trim(habitat) = '' OR lower(trim(habitat)) = 'unknown' OR habitat IS NULL THEN 'Unknown' ELSE trim(habitat) END AS habitat, hp::BIGINT + attack::BIGINT + defense::BIGINT + sp_attack::BIGINT + sp_defense::BIGINT + speed::BIGINT AS total,
  (SELECT max(code) FROM b WHERE b.entity_id = x.entity_id AND slot = 1) AS type_a, (SELECT max(code) FROM b WHERE b.entity_id = x.entity_id AND slot = 2) AS type_b, coalesce(documents, 0) AS documents, sources FROM x LEFT JOIN d USING (entity_id)""",
    "type_children": f"WITH {_ENTITIES} SELECT entity_id, string_agg(slot || ':' || code || ':' || t.name_zh, '|' ORDER BY slot) AS types FROM b JOIN type_definitions t USING (code) GROUP BY 1",
    "ability_terms": rf"""WITH {_ENTITIES}, n AS (SELECT entity_id, hidden_ability, unnest(string_split_regex(coalesce(abilities, ''), '[|,]')) AS raw, generate_subscripts(string_split_regex(coalesce(abilities, ''), '[|,]'), 1) AS i FROM x),
k AS (SELECT entity_id, i, replace(lower(trim(regexp_replace(raw, '^{_BLANK}|{_BLANK}$', '', 'g'))), '_', '-') AS code FROM n), f AS (SELECT entity_id, code, min(i) AS i FROM k WHERE code <> '' GROUP BY 1, 2),
h AS (SELECT entity_id, replace(lower(trim(hidden_ability)), '_', '-') AS code FROM x WHERE trim(coalesce(hidden_ability, '')) <> ''),
u AS (SELECT * FROM f UNION ALL SELECT entity_id, code, 100000 FROM h WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.entity_id = h.entity_id AND f.code = h.code))
SELECT entity_id, (row_number() OVER (PARTITION BY entity_id ORDER BY i) - 1)::INTEGER AS place, code, EXISTS (SELECT 1 FROM h WHERE h.entity_id = u.entity_id AND h.code = u.code) AS is_hidden FROM u""",
    "localised_types": f"""WITH {_ENTITIES}, r AS (SELECT entity_id, 1 AS i, trim(type_1) AS raw FROM x UNION ALL SELECT entity_id, 2, trim(type_2) FROM x), k AS (SELECT entity_id, replace(lower(raw), '_', '-') AS code, min(i) AS i, arg_min(raw, i) AS raw FROM r WHERE raw <> '' GROUP BY 1, 2)
SELECT entity_id, (row_number() OVER (PARTITION BY entity_id ORDER BY i) - 1)::INTEGER AS place, CASE WHEN t.name_zh IS NULL THEN k.raw ELSE k.code END AS code, coalesce(t.name_zh, '未收錄') AS name_zh FROM k LEFT JOIN type_definitions t ON t.code = k.code""",
    "hash_sample": "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 50",
    "even_sample": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id FROM r WHERE i IN (SELECT floor(k * (n - 1) / 10 + 0.5) FROM range(0, 11) t(k), (SELECT count(*) AS n FROM documents))",
    "entities_with_evidence": "SELECT count(DISTINCT pokemon_id) AS entities, count(DISTINCT evidence_id) AS evidence FROM evidence_response WHERE document_id IN (SELECT id FROM pokemon_knowledge_documents WHERE is_current AND status = 'ready')",
    "content_hashes": f"SELECT id, sha256(regexp_replace(content, '^{_BLANK}|{_BLANK}$', '', 'g')) AS computed, sha256(regexp_replace(content, '^{_BLANK}|{_BLANK}$', '', 'g')) = content_hash AS as_stored FROM pokemon_knowledge_documents",
    "fixed_windows": "SELECT doc_id, place::INTEGER AS place, substr(text, place * 64 + 1, 64) AS window_text FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 63) // 64)) AS place FROM documents WHERE length(text) > 0)",
    "sentence_counts": f"SELECT doc_id, len({_SENTENCES})::INTEGER AS sentences FROM documents WHERE text IS NOT NULL",
    "query_tokens": r"""WITH t AS (SELECT item_id, list_filter(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+'), lambda t: regexp_matches(t, '[\p{L}\p{N}]')) AS ts FROM evaluation_cases),
f AS (SELECT item_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS i FROM t), k AS (SELECT item_id, token, min(i) AS i FROM f GROUP BY 1, 2)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY i) - 1)::INTEGER AS place, token FROM k QUALIFY place < 32""",
    "typed_fields": rf"""SELECT source_row, CASE WHEN regexp_full_match(trim(base_stat_total), '[+-]?[0-9]{{1,18}}([.]0*)?') THEN try_cast(regexp_replace(trim(base_stat_total), '^[+]|[.]0*$', '', 'g') AS BIGINT) END AS total, CASE WHEN isfinite(try_cast(trim(height_m) AS DOUBLE)) THEN try_cast(trim(height_m) AS DOUBLE) END AS height,
  CASE lower(trim(is_mythical)) WHEN 'true' THEN true WHEN 'false' THEN false END AS mythical, nullif(list_position(['gen-i', 'gen-ii', 'gen-iii', 'gen-iv', 'gen-v', 'gen-vi', 'gen-vii', 'gen-viii', 'gen-ix'], lower(trim(generation))), 0)::INTEGER AS generation,
  CASE WHEN trim(habitat) <> '' AND lower(trim(habitat)) <> 'unknown' THEN trim(habitat) END AS habitat, coalesce(regexp_full_match(image_url, 'https?://[^/?#\s@]+(/[^?#\s]*)?'), false) AS web, format('https://art.example.invalid/{{:04d}}.png', pokedex_number::INTEGER) AS artwork, regexp_replace(trim(genus), '[<>:"/\\|?*\x00-\x1f]', '_', 'g') AS file_stem FROM pokedex_final""",
    "length_buckets": "SELECT CASE WHEN query_length < 40 THEN 'short' WHEN query_length < 80 THEN 'medium' WHEN query_length IS NOT NULL THEN 'long' END AS bucket, count(*) AS n FROM evaluation_cases GROUP BY 1",
    "upsert_merge": f"""WITH t AS (SELECT * FROM pokedex_final WHERE source_row % 2 = 0 QUALIFY row_number() OVER (PARTITION BY pokedex_number ORDER BY loaded_at DESC NULLS LAST, source_row DESC) = 1), s AS (SELECT * FROM pokedex_final WHERE source_row % 2 = 1 QUALIFY row_number() OVER (PARTITION BY pokedex_number ORDER BY loaded_at DESC NULLS LAST, source_row DESC) = 1)
SELECT coalesce(s.pokedex_number, t.pokedex_number) AS pokedex_number, {_PICK}, CASE WHEN t.pokedex_number IS NULL THEN 'insert' WHEN s.pokedex_number IS NULL THEN 'untouched' WHEN {_DIFF} THEN 'update' ELSE 'keep' END AS action FROM t FULL JOIN s ON t.pokedex_number = s.pokedex_number""",
    "child_sync": """WITH t AS (SELECT DISTINCT pokemon_id, source_key FROM pokemon_knowledge_documents WHERE version = 1), w AS (SELECT DISTINCT pokemon_id, source_key FROM pokemon_knowledge_documents WHERE is_current)
SELECT *, 'keep' AS action FROM (SELECT * FROM t INTERSECT SELECT * FROM w) UNION ALL SELECT *, 'delete' FROM (SELECT * FROM t EXCEPT SELECT * FROM w) UNION ALL SELECT *, 'insert' FROM (SELECT * FROM w EXCEPT SELECT * FROM t)""",
    "scd2_versions": f"""WITH d AS (SELECT *, sha256(regexp_replace(content, '^{_BLANK}|{_BLANK}$', '', 'g')) AS h FROM pokemon_knowledge_documents), i AS (SELECT pokemon_id, source_key, sha256(regexp_replace(max(content), '^{_BLANK}|{_BLANK}$', '', 'g')) AS h FROM pokemon_knowledge_documents WHERE version = 1 GROUP BY 1, 2),
c AS (SELECT pokemon_id, source_key, arg_max(h, version) AS held, max(version) AS hv FROM d WHERE is_current GROUP BY 1, 2), m AS (SELECT pokemon_id, source_key, max(version) AS top FROM d GROUP BY 1, 2)
SELECT pokemon_id, source_key, i.h AS content_hash, (CASE WHEN held = i.h THEN hv ELSE coalesce(top, 0) + 1 END)::INTEGER AS version, CASE WHEN held = i.h THEN 'keep' WHEN held IS NULL THEN 'first' ELSE 'replace' END AS action FROM i LEFT JOIN c USING (pokemon_id, source_key) LEFT JOIN m USING (pokemon_id, source_key)""",
    "retired_sources": "SELECT id, source_key FROM pokemon_knowledge_documents a WHERE is_current AND source_key <> 'profile' AND NOT EXISTS (SELECT 1 FROM pokemon_knowledge_documents b WHERE b.source_description_id IS NOT NULL AND b.pokemon_id = a.pokemon_id AND b.source_key = a.source_key)",
    "pending_work": f"""WITH {_CURRENT}, e AS (SELECT id, CASE WHEN chunk_no % 7 = 0 THEN 'failed' ELSE 'ready' END AS status, chunk_no % 11 <> 0 AS has_vector, CASE WHEN chunk_no % 13 = 0 THEN 'old' ELSE content_hash END AS h FROM c WHERE chunk_no % 5 <> 0),
r AS (SELECT c.id AS chunk_id, CASE WHEN e.id IS NULL THEN 'missing' WHEN e.status <> 'ready' THEN 'not_ready' WHEN NOT has_vector THEN 'empty' WHEN h <> content_hash THEN 'changed' END AS reason FROM c LEFT JOIN e USING (id)) SELECT * FROM r WHERE reason IS NOT NULL""",
    "index_states": f"""WITH {_CURRENT}, p AS (SELECT document_id, count(*) AS total, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'failed') AS failed FROM c GROUP BY 1)
SELECT d.id AS document_id, coalesce(total, 0) AS total, coalesce(ready, 0) AS ready, coalesce(failed, 0) AS failed, CASE WHEN is_current AND total > 0 AND ready = total THEN 'ready' WHEN d.status = 'failed' OR failed > 0 THEN 'failed' WHEN total > 0 THEN 'stale' ELSE 'unindexed' END AS state FROM pokemon_knowledge_documents d LEFT JOIN p ON p.document_id = d.id""",
    "constraint_violations": """SELECT chunk_no::VARCHAR AS key, 'not_blank' AS "constraint" FROM pokemon_knowledge_chunks WHERE trim(content) = '' UNION ALL SELECT chunk_no::VARCHAR, 'char_count' FROM pokemon_knowledge_chunks WHERE char_count <> length(content) UNION ALL SELECT chunk_no::VARCHAR, 'status' FROM pokemon_knowledge_chunks WHERE status NOT IN ('ready', 'stale', 'failed')
UNION ALL SELECT l_orderkey || ':' || l_linenumber, 'discount' FROM lineitem WHERE l_discount NOT BETWEEN 0 AND 0.1 UNION ALL SELECT l_orderkey || ':' || l_linenumber, 'quantity' FROM lineitem WHERE l_quantity NOT BETWEEN 1 AND 49
UNION ALL SELECT id, 'unique_id' FROM pokemon_knowledge_chunks GROUP BY id HAVING count(*) > 1 UNION ALL SELECT DISTINCT evidence_id, 'evidence_chunk' FROM evidence_response WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT id FROM pokemon_knowledge_chunks)""",
    "nested_values": """WITH t AS (SELECT *, [x for x in [type_1, type_2] if trim(coalesce(x, '')) <> '' AND lower(trim(x)) <> 'unknown'] AS g FROM pokedex_final)
SELECT source_row, pokedex_number::BIGINT AS number, nullif(list_position(['gen-i', 'gen-ii', 'gen-iii', 'gen-iv', 'gen-v', 'gen-vi', 'gen-vii', 'gen-viii', 'gen-ix'], lower(trim(generation))), 0)::INTEGER AS generation, height_m::DECIMAL(6, 2) AS height_m, base_stat_total::DOUBLE::BIGINT AS base_stat_total,
  array_to_string([lower(trim(x)) for x in g], ',') AS types, ((trim(coalesce(description_zh, '')) NOT IN ('', 'unknown'))::INT + (trim(coalesce(flavor_text_en, '')) NOT IN ('', 'unknown'))::INT + (trim(coalesce(analysis_text, '')) NOT IN ('', 'unknown'))::INT)::INTEGER AS descriptions,
  (coalesce(regexp_full_match(image_url, 'https?://[^/?#\\s@]+(/[^?#\\s]*)?'), false)::INT + coalesce(regexp_full_match(sprite_url, 'https?://[^/?#\\s@]+(/[^?#\\s]*)?'), false)::INT)::INTEGER AS images FROM t""",
    "case_view": f"""WITH g AS ({_LATEST_GRADES}), f AS (SELECT case_id, pokemon_id, max(final_grade) AS final_grade FROM annotation_quality_row GROUP BY 1, 2), l AS (SELECT case_id, pokemon_id, string_agg(annotator || '=' || grade, '|' ORDER BY annotator) AS grades FROM g GROUP BY 1, 2)
SELECT case_id, pokemon_id, grades, final_grade FROM evaluation_cases JOIN l USING (case_id) LEFT JOIN f USING (case_id, pokemon_id)""",
    "public_descriptions": "SELECT id, pokemon_id FROM pokemon_knowledge_documents WHERE lower(trim(language_code)) = 'zh-hant' AND lower(trim(document_kind)) = 'description'",
    "evidence_order": "SELECT DISTINCT evidence_id, language_code, rrf_score FROM evidence_response WHERE rrf_score IS NOT NULL AND NOT isnan(rrf_score) ORDER BY CASE WHEN lower(language_code) LIKE 'zh%' THEN 0 ELSE 1 END, rrf_score DESC, evidence_id LIMIT 10",
    "embedded_chunks": rf"SELECT CASE WHEN text IS NULL THEN 'failed' ELSE 'ready' END AS status, count(*) AS n FROM documents WHERE text IS NULL OR regexp_replace(text, '^{_BLANK}|{_BLANK}$', '', 'g') <> '' GROUP BY 1",
    "stable_ids": """WITH h AS (SELECT id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat_ws(':', 'document', pokemon_id::VARCHAR, source_key, version::VARCHAR))) AS x FROM pokemon_knowledge_documents)
SELECT id, concat_ws('-', substr(x, 1, 8), substr(x, 9, 4), '5' || substr(x, 14, 3), substr('89ab', (('0x' || substr(x, 17, 1))::INTEGER % 4) + 1, 1) || substr(x, 18, 3), substr(x, 21, 12)) AS stable_id FROM h""",
}

# windows: every step takes the sentences that end within 500 of the window's begin, or 500 letters of a longer one
SQL["chunk_documents"] = f"""
WITH RECURSIVE s AS (SELECT id, sents, array_to_string(sents, ' ') AS j FROM (SELECT id, {_SENTENCES.replace('text', 'content')} AS sents FROM pokemon_knowledge_documents) WHERE len(sents) > 0),
e AS (SELECT id, list(e ORDER BY k) AS ends FROM (SELECT id, k, (sum(n) OVER (PARTITION BY id ORDER BY k) + k - 1)::BIGINT AS e FROM (SELECT id, unnest(range(1, len(sents) + 1)) AS k, length(unnest(sents)) AS n FROM s)) GROUP BY 1),
d AS (SELECT s.id, s.j, e.ends, len(e.ends) AS n FROM s JOIN e USING (id)),
c AS (SELECT id, -1 AS idx, 0::BIGINT AS b, 0::BIGINT AS z, 0::BIGINT AS taken, 0::BIGINT AS nb FROM d
  UNION ALL SELECT id, idx + 1, nb, CASE WHEN fit > taken THEN ends[fit] ELSE nb + 500 END, CASE WHEN fit > taken THEN fit ELSE taken END, CASE WHEN fit > taken THEN greatest(nb, ends[fit] - 80) ELSE nb + 420 END
  FROM (SELECT c.*, d.ends, len(list_filter(d.ends, lambda x: x <= c.nb + 500)) AS fit FROM c JOIN d USING (id) WHERE c.taken < d.n)),
w AS (SELECT c.id, c.idx::INTEGER AS chunk_index, substr(d.j, c.b + 1, c.z - c.b) AS content FROM c JOIN d USING (id) WHERE idx >= 0),
h AS (SELECT *, sha256(regexp_replace(content, '^{_BLANK}|{_BLANK}$', '', 'g')) AS content_hash FROM w),
u AS (SELECT *, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat_ws(':', 'chunk', id, chunk_index::VARCHAR, content_hash))) AS x FROM h)
SELECT id, chunk_index, length(content)::INTEGER AS char_count, content_hash,
  substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' || substr('89ab', ((strpos('0123456789abcdef', substr(x, 17, 1)) - 1) % 4 + 1)::BIGINT, 1) || substr(x, 18, 3) || '-' || substr(x, 21, 12) AS chunk_id FROM u
"""

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
SQL["canonical_names"] = f"""WITH n AS (SELECT request_id, lower(trim(regexp_replace(translate(mbti, '{_WIDE}', '{_NARROW}'), '{_BLANK}', ' ', 'g'))) AS mbti FROM recommendation_request)
SELECT request_id, mbti, CASE WHEN regexp_full_match(upper(mbti), '[EI][SN][TF][JP](-[AT])?') THEN substr(upper(mbti), 1, 4) END AS code FROM n"""


_BEHAVIOUR, _APPEARANCE = ("[" + ", ".join(f"'{w}'" for w in words) + "]" for words in (
    ["性格", "夥伴", "群居", "合作", "信任", "忠誠", "守護", "保護", "照顧", "支持", "溫柔", "熱情", "冷靜", "勇敢", "交流", "聯絡", "心情", "寂寞", "獨處", "喜歡", "好奇", "智慧", "聰明", "舞蹈"],
    ["全身", "身體", "外形", "外觀", "顏色", "毛髮", "羽毛", "眼睛", "鼻子", "尾巴", "翅膀", "四肢", "足部", "頭部"],
))
_AROUND = r"[ \[\]【】()（）,，:：-]+"
SQL["chinese_summaries"] = rf"""
WITH t AS (SELECT source_row, description_zh, trim(regexp_replace(description_zh, '{_BLANK}', ' ', 'g')) AS t FROM pokedex_final),
s AS (SELECT source_row, unnest(range(1, len(ps) + 1)) AS i, regexp_replace(regexp_replace(unnest(ps), '^{_AROUND}|{_AROUND}$', '', 'g'), '^(?:中文圖鑑描述|英文 flavor text) *[:：] *', '') AS s
  FROM (SELECT source_row, flatten(list_transform(regexp_split_to_array(t, '[|｜]+'), lambda p: regexp_extract_all(p, '[^。！？；]*[。！？；]|[^。！？；]+'))) AS ps FROM t)),
b AS (SELECT source_row, s FROM (SELECT *, 3 * len(list_filter({_BEHAVIOUR}, lambda w: contains(s, w))) - 2 * len(list_filter({_APPEARANCE}, lambda w: contains(s, w))) AS score FROM s)
  WHERE len(regexp_extract_all(s, '[\x{{3400}}-\x{{9FFF}}]')) >= 3 QUALIFY row_number() OVER (PARTITION BY source_row ORDER BY score DESC, i) = 1),
c AS (SELECT *, substr(s, 1, 110) AS head, regexp_replace(regexp_replace(substr(s, 1, 110), '，[^，]*$', ''), '[，。！？； ]+$', '') AS clause FROM b)
SELECT t.source_row, CASE WHEN description_zh IS NULL THEN NULL WHEN s IS NULL THEN '' WHEN length(s) <= 110 THEN s WHEN clause <> '' THEN clause || '……' ELSE rtrim(head) || '……' END AS summary,
  coalesce(len(regexp_extract_all(t, '[\x{{3400}}-\x{{9FFF}}]')) >= 12 AND NOT regexp_matches(t, '([A-Za-z][A-Za-z''-]*\s+){{3}}[A-Za-z]') AND NOT regexp_matches(lower(t), 'ev_|document_id|chunk_id|檢索證據指出'), false) AS chinese FROM t LEFT JOIN c USING (source_row)
"""


def _bare(c: str) -> str:
    return f"regexp_replace({c}, '^{_BLANK}|{_BLANK}$', '', 'g')"


def _whole(c: str) -> str:
    """A whole number, maybe written with a point and zeros; null otherwise."""
    return f"CASE WHEN regexp_full_match({_bare(c)}, '[+-]?[0-9]{{1,18}}([.]0*)?') THEN try_cast(regexp_replace({_bare(c)}, '[.]0*$', '') AS BIGINT) END"


def _finite(c: str) -> str:
    return f"CASE WHEN isfinite(try_cast({_bare(c)} AS DOUBLE)) THEN try_cast({_bare(c)} AS DOUBLE) END"


_STATS = ("hp", "attack", "defense", "sp_attack", "sp_defense", "speed")
_SUM_OF_STATS = " + ".join(f"({_whole(c)})" for c in _STATS)
_SIDE = f"list_filter([{', '.join(f'CASE WHEN {_bare(c)} <> {chr(39)}{chr(39)} AND lower({_bare(c)}) <> {chr(39)}unknown{chr(39)} THEN lower({_bare(c)}) END' for c in ('type_1', 'type_2'))}], lambda x: x IS NOT NULL)"
_CHECKS = [
    *((c, f"({_whole(c)}) BETWEEN 0 AND 32767", "not a whole number in range") for c in (*_STATS, "base_stat_total")),
    *((c, f"({_finite(c)}) IS NOT NULL", "not a finite number") for c in ("scaled_hp", "scaled_attack", "scaled_defense", "scaled_sp_attack", "scaled_sp_defense", "scaled_speed", "scaled_height_m", "scaled_weight_kg")),
    ("base_stat_total", f"{_SUM_OF_STATS} = ({_whole('base_stat_total')})", "not the sum of the six stats"),
    ("generation", f"regexp_full_match(lower({_bare('generation')}), 'gen-(i|ii|iii|iv|v|vi|vii|viii|ix)')", "unknown"),
    *((c, f"lower({_bare(c)}) IN ('true', 'false')", "neither true nor false") for c in ("is_legendary", "is_mythical", "is_baby")),
    *((c, f"({_whole(c)}) IN (1, -1)", "neither 1 nor -1") for c in ("is_outlier", "lof_outlier")),
    *((c, f"({_finite(c)}) >= 0", "not a finite number from 0") for c in ("height_m", "weight_kg")),
    ("type_1", "len(given) > 0 AND len(list_filter(given, lambda g: NOT list_contains(names, g))) = 0", "unknown"),
    ("type_zh", "zh = wanted OR (len(zh) = 0 AND wanted = ['一般'])", "not the types in Chinese"),
    *((c, f"regexp_full_match({c}, 'https?://[^/?#\\s@]+(/[^?#\\s]*)?')", "no plain web address") for c in ("image_url", "sprite_url")),
    *((c, f"{_bare(c)} <> ''", "blank") for c in ("name_zh", "name_en")),
]
SQL["nested_rows"] = f"""
WITH t AS (SELECT list(lower(name_en)) AS names, map(list(lower(name_en)), list(name_zh)) AS chinese FROM type_definitions),
g AS (SELECT *, {_SIDE} AS given FROM pokedex_final, t),
n AS (SELECT *, list_transform(given, lambda x: chinese[x]) AS wanted,
  list_filter(list_transform(string_split(replace(coalesce(type_zh, ''), '，', ','), ','), lambda x: {_bare('x')}), lambda x: x <> '') AS zh FROM g)
""" + " UNION ALL ".join(f"SELECT source_row, '{field}' AS field, '{message}' AS message FROM n WHERE NOT coalesce({ok}, false)" for field, ok, message in _CHECKS)
