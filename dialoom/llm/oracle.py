"""SQL twins (DuckDB) of the pN queries that SQL can express on whole tables."""

from __future__ import annotations

from dialoom.llm.lookalikes import TWINS


def _quoted(s: str) -> str:
    return s.replace("'", "''")


# full-width forms and their plain characters, by rule
_WIDE = {chr(o): chr(o - 0xFEE0) for o in range(0xFF01, 0xFF5F)}
_FROM, _TO = _quoted("".join([*TWINS, *_WIDE])), _quoted("".join([*TWINS.values(), *_WIDE.values()]))
_NOTHING = r"[\x{00AD}\x{034F}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}\x{FE00}-\x{FE0F}]"
_SPACE = r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"


def look(x: str) -> str:
    return f"nfc_normalize(translate(regexp_replace(regexp_replace({x}, '{_NOTHING}', '', 'g'), '{_SPACE}', ' ', 'g'), '{_FROM}', '{_TO}'))"


def bare(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[\s\p{{P}}\p{{Z}}$+<=>^`|~]+', '', 'g')"


_LONG = r"length(regexp_replace(look, '[^\p{L}\p{N}]', '', 'g')) >= 40"

P2_FOUND = f"""WITH t AS (SELECT 'conversations' AS tab, msg_id AS k, content AS x FROM conversations UNION ALL SELECT 'dataset', id, description FROM dataset),
l AS (SELECT tab, k, x, {look('x')} AS look FROM t WHERE x IS NOT NULL)
SELECT a.tab, a.k AS key_a, b.k AS key_b FROM (SELECT * FROM l WHERE {_LONG}) a JOIN l b ON a.tab = b.tab AND a.look = b.look AND a.k < b.k AND a.x <> b.x"""

P2_CLASSES = f"""WITH t AS (SELECT 'conversations' AS tab, msg_id AS key, content AS x FROM conversations UNION ALL SELECT 'dataset', id, description FROM dataset)
SELECT tab, key, min(key) OVER (PARTITION BY tab, {look('x')}) AS "class" FROM t WHERE x IS NOT NULL"""

P4_FOUND = r"""WITH RECURSIVE r AS (SELECT DISTINCT try_cast(regexp_extract(id, '^\s*(.*)_[^_]*$', 1) AS BIGINT) AS i,
  try_cast(nullif(regexp_extract(lower(image), 'image[^0-9a-z/\\]*([0-9]+)[^/\\]*$', 1), '') AS BIGINT) AS p FROM train),
e AS (SELECT DISTINCT a.i AS x, b.i AS y FROM r a JOIN r b ON a.p = b.p WHERE a.i <> b.i),
reach AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x)
SELECT DISTINCT x AS item_a, y AS item_b FROM reach WHERE x < y"""

P4_GROUPS = P4_FOUND.split("\nSELECT DISTINCT x AS item_a")[0] + "\nSELECT r.i AS item, least(r.i, min(reach.y)) AS group_id FROM (SELECT DISTINCT i FROM r WHERE i IS NOT NULL) r LEFT JOIN reach ON reach.x = r.i GROUP BY r.i"
# what a split has to fulfil: quotas met to a record, no group torn
P4_SPLIT_SIZES = "SELECT split, (SELECT count(*) FROM train) AS total, true AS meets_quota, 0::BIGINT AS n_torn FROM (VALUES ('train'), ('validation'), ('test')) v(split)"

_P5_KEYS = rf"""t AS (SELECT 'conversations' AS tab, msg_id AS k, content AS x FROM conversations UNION ALL SELECT 'predictions', pred_id, ground_truth FROM predictions),
l AS (SELECT tab, k, {look('x')} AS look FROM t WHERE x IS NOT NULL),
m AS (SELECT *, regexp_extract(look, '(?s)^[\s\p{{P}}$+<=>^`|~]*?(\{{.*\}})[\s\p{{P}}$+<=>^`|~]*$', 1) AS j,
  list_filter(regexp_split_to_array(look, '\s*[;|\n\r]\s*'), lambda p: regexp_matches(p, '[\p{{L}}\p{{N}}]')) AS parts FROM l WHERE {_LONG}),
keyed AS (SELECT tab, k, CASE
  WHEN j <> '' AND coalesce(json_valid(j), false) AND json_type(j) = 'OBJECT' THEN '{{' || array_to_string(list_sort(list_transform(json_keys(j), lambda f: {bare('f')} || chr(31) || {bare("json_extract_string(j, '$.\"' || f || '\"')")})), chr(30))
  WHEN len(parts) >= 3 AND len(list_filter(parts, lambda p: regexp_matches(p, '(?s)^[^:]{{1,60}}:.*$'))) = len(parts)
  THEN ':' || array_to_string(list_sort(list_transform(parts, lambda p: {bare("split_part(p, ':', 1)")} || chr(31) || {bare("substring(p, strpos(p, ':') + 1)")})), chr(30))
  ELSE {bare('look')} END AS key FROM m)"""
P5_FOUND = f"WITH {_P5_KEYS}, g AS (SELECT *, min(k) OVER (PARTITION BY tab, key) AS keep_id FROM keyed) SELECT tab, keep_id, k AS copy_id FROM g WHERE k <> keep_id"
P5_COLLAPSED = f"WITH {_P5_KEYS} SELECT tab, min(k) AS keep_id, count(*)::BIGINT AS n_copies FROM keyed GROUP BY tab, key"

# what packings and cuts have to fulfil
COVERAGE = "SELECT doc_id, length(text)::BIGINT AS n_chars, 0::BIGINT AS n_gaps, 0::BIGINT AS n_over FROM documents WHERE length(text) > 0"
P6_OVERFULL = "SELECT 0::BIGINT AS n_overfull, 0::BIGINT AS n_split_needlessly"

ORACLE: dict[str, str] = {"p2_found": P2_FOUND, "p2_classes": P2_CLASSES, "p4_found": P4_FOUND, "p4_groups": P4_GROUPS, "p4_split_sizes": P4_SPLIT_SIZES, "p5_found": P5_FOUND, "p6_coverage": COVERAGE, "p6_overfull": P6_OVERFULL, "p8_coverage": COVERAGE, "p5_collapsed": P5_COLLAPSED}
