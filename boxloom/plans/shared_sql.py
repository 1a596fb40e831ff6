"""SQL fragments that the twins of several queries share."""

_LINE = r"\s*[^\s]+(\s+[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?){4}\s*"
LINES = r"list_filter(regexp_split_to_array({c}, '\r\n|\n|\r'), lambda l: regexp_replace(l, '\s', '', 'g') <> '')"


def lines(c: str) -> str:
    return LINES.replace("{c}", c)


def usable(c: str) -> str:
    return f"({c} IS NOT NULL AND len(list_filter({lines(c)}, lambda l: NOT regexp_full_match(l, '{_LINE}'))) = 0)"


def good_lines(c: str) -> str:
    return f"len(list_filter({lines(c)}, lambda l: regexp_full_match(l, '{_LINE}')))"


def digest(c: str) -> str:
    """A digest in plain hex from any notation, as SQL."""
    trimmed = f"regexp_replace({c}, '^[\\s' || chr(160) || ']+|[\\s' || chr(160) || ']+$', '', 'g')"
    bare = f"regexp_replace({trimmed}, '^(?i:sha-?256)\\s*[:=-]?\\s*', '')"
    hexed = f"regexp_replace(regexp_replace(lower({bare}), '^0x', ''), '[:\\-\\s]', '', 'g')"
    base = f"rtrim(translate({bare}, '-_', '+/'), '=')"
    return f"CASE WHEN regexp_full_match({hexed}, '[0-9a-f]{{16,64}}') THEN {hexed} WHEN regexp_full_match({base}, '[A-Za-z0-9+/]{{43}}') THEN lower(hex(from_base64({base} || '='))) END"


#: Truth boxes in corners, pixels.
GT = f"""
once AS (SELECT record_id, max(struct_pack(s := label_signature, w := width, h := height)) AS r FROM image_records WHERE record_id IS NOT NULL GROUP BY record_id),
good AS (SELECT CAST(record_id AS VARCHAR) AS image_id, r.s AS s, r.w AS width, r.h AS height FROM once WHERE {usable('r.s')} AND r.w BETWEEN 1 AND 12000 AND r.h BETWEEN 1 AND 12000),
gl AS (SELECT image_id, width, height, unnest({lines('s')}) AS line, generate_subscripts({lines('s')}, 1) AS box_no FROM good),
gp AS (SELECT image_id, width, height, box_no, string_split(trim(regexp_replace(line, '\\s+', ' ', 'g')), ' ') AS p FROM gl),
gn AS (SELECT image_id, box_no, width, height, CAST(CAST(p[1] AS DOUBLE) AS INT) AS cls, CAST(p[2] AS DOUBLE) AS x, CAST(p[3] AS DOUBLE) AS y, CAST(p[4] AS DOUBLE) AS w, CAST(p[5] AS DOUBLE) AS h FROM gp),
gt AS (SELECT image_id, box_no, box_no AS gt, cls, width * (x - w / 2) + 0.0 AS x1, height * (y - h / 2) + 0.0 AS y1, width * (x + w / 2) + 0.0 AS x2, height * (y + h / 2) + 0.0 AS y2, width, height FROM gn)"""

#: Predicted boxes in corners with their rank in run and image.
DET = """
dd AS (SELECT DISTINCT run_id, image_id, category_id AS cls, bbox, score FROM detections WHERE score IS NOT NULL AND image_id IS NOT NULL AND len(bbox) = 4 AND len(list_filter(bbox, lambda v: v IS NULL)) = 0),
dc AS (SELECT run_id, image_id, cls, score, bbox[1] AS x1, bbox[2] AS y1, bbox[1] + bbox[3] AS x2, bbox[2] + bbox[4] AS y2 FROM dd),
det AS (SELECT *, row_number() OVER (PARTITION BY run_id, image_id ORDER BY score DESC, cls, x1, y1, x2, y2) AS det FROM dc)"""


def inter(a: str, b: str) -> str:
    return f"(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0.0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0.0))"


def area(a: str) -> str:
    return f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1))"


def iou(a: str, b: str) -> str:
    return f"({inter(a, b)} / ({area(a)} + {area(b)} - {inter(a, b)} + 1e-7))"


#: All pairs of a run's predictions with the truth of their image.
PAIRS = f"pairs AS (SELECT d.run_id, d.image_id, d.det, g.gt, d.cls, g.cls AS gt_cls, d.score, {iou('g', 'd')} AS iou FROM det d JOIN gt g ON g.image_id = d.image_id)"
