"""DuckDB SQL for the queries that SQL can express on whole tables."""

SQL: dict[str, str] = {}

SQL["p4_found"] = r"""
WITH p AS (SELECT * FROM pokemon_knowledge_chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY chunk_no) = 1),
per AS (SELECT document_id, count(*) n, count(DISTINCT chunk_index) k, min(chunk_index) lo, max(chunk_index) hi,
  bool_or(length(content) > 500) over_limit, bool_or(length(content) <> char_count) cc,
  bool_or(len(list_filter(regexp_split_to_array(lexical_text, '\s+'), lambda w: w <> '')) <> token_count) tc FROM p GROUP BY 1)
SELECT document_id, 'over_limit' AS defect FROM per WHERE over_limit
UNION ALL SELECT document_id, 'char_count' FROM per WHERE cc
UNION ALL SELECT document_id, 'token_count' FROM per WHERE tc
UNION ALL SELECT document_id, 'gap' FROM per WHERE n <> k OR lo <> 0 OR hi <> n - 1
UNION ALL SELECT DISTINCT a.document_id, 'overlap' FROM p a JOIN p b ON a.document_id = b.document_id AND b.chunk_index = a.chunk_index + 1
  WHERE NOT starts_with(b.content, right(a.content, 80))
UNION ALL SELECT id, 'uncut' FROM pokemon_knowledge_documents WHERE length(regexp_replace(content, '^\s+|\s+$', '', 'g')) > 500
  AND id NOT IN (SELECT document_id FROM p)
"""

_WHITE = r"[\s\p{Z}\x1c-\x1f\x{85}]"
_KINDS = (r"\n+", rf"""[。！？!?；;.…]+[”’」』）)"'']*{_WHITE}*""", rf"[，,、：:]{_WHITE}*", rf"{_WHITE}+")


_LAST = [f"list_max(list_filter(d.e{k}, lambda x: x > c.a + 80 AND x <= c.a + 500))" for k in range(4)]
_END = f"CASE WHEN d.n - c.a <= 500 THEN d.n ELSE coalesce({', '.join(_LAST)}, c.a + 500) END"
_HAN_RUN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]+"
# each kind's ends are the sums of the lengths of what stands between marks put behind its matches
SQL["p4_pieces"] = f"""
WITH RECURSIVE t AS (SELECT id, regexp_replace(content, '^{_WHITE}+|{_WHITE}+$', '', 'g') AS t FROM pokemon_knowledge_documents),
m AS (SELECT *, {", ".join(f"string_split(regexp_replace(t, '({kind})', chr(92) || '1' || chr(1), 'g'), chr(1)) AS m{k}" for k, kind in enumerate(_KINDS))} FROM t WHERE length(t) > 500),
p AS (SELECT id, k, sum(length(part)) OVER (PARTITION BY id, k ORDER BY i)::BIGINT AS e, i = n AS last FROM (
  {" UNION ALL ".join(f"SELECT id, {k} AS k, unnest(m{k}) AS part, unnest(range(1, len(m{k}) + 1)) AS i, len(m{k}) AS n FROM m" for k in range(4))})),
d AS (SELECT id, t, length(t)::BIGINT AS n, {", ".join(f"coalesce(e{k}, []) AS e{k}" for k in range(4))} FROM m LEFT JOIN (SELECT id, {", ".join(f"list(e) FILTER (k = {k}) AS e{k}" for k in range(4))} FROM p WHERE NOT last GROUP BY id) USING (id)),
c AS (SELECT id, 0 AS idx, 0::BIGINT AS a FROM d UNION ALL SELECT c.id, c.idx + 1, {_END} - 80 FROM c JOIN d USING (id) WHERE d.n - c.a > 500),
z AS (SELECT id, idx, a, {_END} AS z, CASE WHEN d.n - c.a <= 500 THEN 'end' {" ".join(f"WHEN {w} IS NOT NULL THEN '{k}'" for k, w in enumerate(_LAST))} ELSE 'hard' END AS boundary, t FROM c JOIN d USING (id)),
y AS (SELECT *, substr(t, a + 1, z - a) AS content FROM z)
SELECT id AS document_id, idx::INTEGER AS chunk_index, a::INTEGER AS start_at, z::INTEGER AS end_at, content, length(content)::INTEGER AS char_count, boundary,
  (len(regexp_extract_all(lower(content), '[a-z0-9]+')) + coalesce(list_sum(list_transform(regexp_extract_all(content, '{_HAN_RUN}'), lambda x: (length(x) + 1) // 2)), 0))::INTEGER AS token_count FROM y
"""

SQL["p5_found"] = """
WITH r AS (
  SELECT 'result' AS kind, request_id AS group_id, pokemon_id::VARCHAR AS item, max(total) AS score, min(pokemon_id) AS tie
  FROM recommendation_result WHERE total IS NOT NULL AND NOT isnan(total) GROUP BY 1, 2, 3
  UNION ALL
  SELECT 'evidence', pokemon_id, evidence_id, rrf_score, coalesce(least(dense_rank, lexical_rank), 9223372036854775807)
  FROM evidence_response WHERE rrf_score IS NOT NULL AND NOT isnan(rrf_score)
  QUALIFY row_number() OVER (PARTITION BY pokemon_id, evidence_id ORDER BY rrf_score DESC, least(dense_rank, lexical_rank) NULLS LAST) = 1)
SELECT kind, group_id, row_number() OVER (PARTITION BY kind, group_id ORDER BY score DESC, tie, item)::INTEGER AS pos, item
FROM r WHERE group_id IS NOT NULL AND item IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY kind, group_id ORDER BY score DESC, tie, item) <= 3
"""

SQL["p7_agreement"] = r"""
WITH r AS (SELECT case_id, pokemon_id, lower(regexp_replace(annotator, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS who, arg_max(grade, (created_at, annotation_id)) AS grade
  FROM annotation_quality_row WHERE grade BETWEEN 0 AND 3 AND case_id IS NOT NULL AND pokemon_id IS NOT NULL AND annotator IS NOT NULL GROUP BY 1, 2, 3),
c AS (SELECT case_id, pokemon_id, grade, count(*)::DOUBLE AS n FROM r WHERE who <> '' GROUP BY 1, 2, 3),
b AS (SELECT sum(n) AS m, sum(n * (n - 1)) AS same FROM c GROUP BY case_id, pokemon_id HAVING sum(n) > 1),
k AS (SELECT c.grade, sum(c.n) AS s FROM c JOIN (SELECT case_id, pokemon_id FROM c GROUP BY 1, 2 HAVING sum(n) > 1) USING (case_id, pokemon_id) GROUP BY 1),
t AS (SELECT count(*) AS items, sum(m)::BIGINT AS ratings, sum((m * (m - 1) - same) / (m - 1)) / sum(m) AS o FROM b),
e AS (SELECT (sum(s) * (sum(s) - 1) - sum(s * (s - 1))) / (sum(s) * (sum(s) - 1)) AS e FROM k)
SELECT items, ratings, round(o, 6) AS observed, round(e, 6) AS expected, round(1 - o / e, 6) AS alpha FROM t, e
"""

_BLANKS = r"[\s\p{Z}\x1c-\x1f\x{85}]+"
SQL["p2_found"] = rf"""
WITH r AS (SELECT 'content' AS field, chunk_no AS id, content AS t FROM pokemon_knowledge_chunks
  UNION ALL SELECT 'flavor_text_en', source_row, flavor_text_en FROM pokedex_final UNION ALL SELECT 'description_zh', source_row, description_zh FROM pokedex_final),
n AS (SELECT field, id, trim(regexp_replace(lower(t), '{_BLANKS}', ' ', 'g')) AS t FROM r WHERE t IS NOT NULL),
d AS (SELECT field, t, min(id) AS k FROM n GROUP BY 1, 2),
g AS (SELECT DISTINCT field, k, substr(t, i::BIGINT, 4) AS w FROM (SELECT field, k, t, unnest(range(1, length(t) - 2)) AS i FROM d)),
s AS (SELECT field, k, count(*) AS size FROM g GROUP BY 1, 2),
b AS (SELECT a.field, a.k AS ka, b.k AS kb, count(*) AS n_both FROM g a JOIN g b ON a.field = b.field AND a.w = b.w AND a.k < b.k GROUP BY 1, 2, 3),
l AS (SELECT b.field, ka, kb FROM b JOIN s x ON x.field = b.field AND x.k = ka JOIN s y ON y.field = b.field AND y.k = kb WHERE n_both * 10 >= 7 * (x.size + y.size - n_both)
  UNION ALL SELECT field, k, k FROM d),
m AS (SELECT n.field, n.id, d.k FROM n JOIN d ON n.field = d.field AND n.t = d.t)
SELECT l.field, least(p.id, q.id) AS row_a, greatest(p.id, q.id) AS row_b FROM l JOIN m p ON p.field = l.field AND p.k = ka JOIN m q ON q.field = l.field AND q.k = kb WHERE ka <> kb OR p.id < q.id
"""

_KANA = r"\x{30A1}-\x{30FC}"  # any sign: one or two beside an ideograph aren't a word
_HAN = r"\x{2E80}-\x{2FDF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}"
_PART = rf"[\p{{Latin}}\p{{Greek}}\p{{Cyrillic}}\x{{300}}-\x{{36F}}\x{{AD}}\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FEFF}}]*"
_EMOJI = r"[\x{203C}-\x{2E7F}\x{1F000}-\x{1FAFF}]"
SQL["p6_found"] = rf"""
WITH v AS (SELECT 'type_zh' AS field, source_row AS row_id, type_zh AS t FROM pokedex_final UNION ALL SELECT 'name_zh', source_row, name_zh FROM pokedex_final UNION ALL SELECT 'text', request_id, text FROM recommendation_request),
j AS (SELECT *, regexp_replace(t, '({_EMOJI})\x{{200D}}({_EMOJI})', '\1\2', 'g') AS u FROM v)
SELECT field, row_id FROM j WHERE regexp_matches(t, '[\x{{FF10}}-\x{{FF19}}\x{{FF21}}-\x{{FF3A}}\x{{FF41}}-\x{{FF5A}}]') OR regexp_matches(t, '[\x{{300}}-\x{{36F}}]')
  OR regexp_matches(u, '[\x{{AD}}\x{{34F}}\x{{61C}}\x{{180E}}\x{{200B}}-\x{{200D}}\x{{2060}}-\x{{2064}}\x{{FEFF}}]') OR regexp_matches(t, '[\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}]')
  OR regexp_matches(t, '[\x{{2E80}}-\x{{2FDF}}\x{{F900}}-\x{{FAFF}}\x{{2F800}}-\x{{2FA1F}}]') OR regexp_matches(t, '\p{{Latin}}{_PART}[\p{{Greek}}\p{{Cyrillic}}]|[\p{{Greek}}\p{{Cyrillic}}]{_PART}\p{{Latin}}')
  OR regexp_matches(t, '[{_HAN}][{_KANA}]{{1,2}}([^\x{{3040}}-\x{{30FF}}]|$)|(^|[^\x{{3040}}-\x{{30FF}}])[{_KANA}]{{1,2}}[{_HAN}]')
"""

SQL["p9_found"] = r"""
WITH i AS (SELECT item_id, CASE language_code WHEN 'zh-Hant' THEN 20 ELSE 50 END AS need, regexp_replace(lower(query), '[^\p{L}\p{N}]', '', 'g') AS q FROM evaluation_cases),
w AS (SELECT DISTINCT item_id, need, substr(q, k::BIGINT, need) AS g FROM (SELECT *, unnest(range(1, length(q) - need + 2)) AS k FROM i)),
d AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
n AS (SELECT unnest([20, 50]) AS need),
x AS (SELECT doc_id, need, substr(t, k::BIGINT, need) AS g FROM (SELECT *, unnest(range(1, length(t) - need + 2)) AS k FROM d, n))
SELECT DISTINCT doc_id, item_id FROM x JOIN w ON x.need = w.need AND x.g = w.g
"""

SQL["p2_groups"] = rf"""
WITH RECURSIVE {SQL["p2_found"].strip().removeprefix("WITH ").rsplit("SELECT l.field", 1)[0].rstrip()},
v AS (SELECT field, ka AS a, kb AS b FROM l WHERE ka <> kb UNION SELECT field, kb, ka FROM l WHERE ka <> kb),
t AS (SELECT field, k, k AS top FROM d UNION SELECT v.field, v.b, t.top FROM t JOIN v ON v.field = t.field AND v.a = t.k WHERE t.top < v.b),
c AS (SELECT field, k, min(top) AS top FROM t GROUP BY 1, 2),
g2 AS (SELECT m.field, m.id, c.top, (SELECT count(*) FROM v WHERE v.field = m.field AND v.a = m.k) AS links FROM m JOIN c ON c.field = m.field AND c.k = m.k)
SELECT field, id AS row_id, min(id) OVER w AS class_id, count(*) OVER w AS class_size, links FROM g2 WINDOW w AS (PARTITION BY field, top)
"""

SQL["p8_round_trip"] = "SELECT doc_id, length(coalesce(text, ''))::INTEGER AS chars, md5(coalesce(text, '')) AS md5 FROM documents"
SQL["p8_offsets"] = r"SELECT doc_id, true AS in_order, length(coalesce(text, ''))::INTEGER AS last FROM documents"

# of every item and document that leak, the longest run: the longest diagonal of shared windows, plus a window less one
SQL["p9_items"] = rf"""
WITH {SQL["p9_found"].strip().removeprefix("WITH ").rsplit("SELECT DISTINCT doc_id", 1)[0].rstrip()},
w2 AS (SELECT item_id, need, k, substr(q, k::BIGINT, need) AS g FROM (SELECT *, unnest(range(1, length(q) - need + 2)) AS k FROM i)),
x2 AS (SELECT doc_id, need, k, substr(t, k::BIGINT, need) AS g FROM (SELECT *, unnest(range(1, length(t) - need + 2)) AS k FROM d, n)),
h AS (SELECT doc_id, item_id, w2.need, w2.k AS kq, x2.k - w2.k AS diagonal FROM x2 JOIN w2 ON x2.need = w2.need AND x2.g = w2.g),
r AS (SELECT doc_id, item_id, any_value(need) + count(*) - 1 AS run FROM (SELECT *, kq - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY kq) AS island FROM h) GROUP BY doc_id, item_id, diagonal, island),
p AS (SELECT item_id, count(DISTINCT doc_id) AS documents, max(run)::INTEGER AS run FROM r GROUP BY 1)
SELECT e.item_id, e.case_id, coalesce(p.documents, 0) AS documents, coalesce(p.run, 0) AS run FROM evaluation_cases e LEFT JOIN p USING (item_id)
"""
