"""Queries along tracks and over event time; positions come from the events table, one per stream, track and hour."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxloom.functions import geometry as G
from boxloom.functions import text as X
from boxloom.operators import frames as R
from boxloom.operators import tracking as T
from boxloom.operators.ranking import ordered_rank
from boxloom.plans import shared_sql as S
from boxloom.plans.detection_queries import predictions
from boxloom.plans.registry import Registry
from boxloom.runtime import read_table, settle
from boxloom.streaming import windows as W

query = Registry()
QUERIES, SQL = query.queries, query.sql

_P = """ev AS (SELECT *, CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 3600) AS BIGINT) + 1 AS frame_no FROM events),
pos AS (SELECT event_type AS stream, user_id AS track_id, frame_no, arg_max(value, event_id) AS x, CAST(arg_max(CAST(props->>'k' AS INT), event_id) AS DOUBLE) AS y, max(event_id) % 3 AS cls FROM ev GROUP BY ALL),
mv AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM pos WINDOW w AS (PARTITION BY stream, track_id ORDER BY frame_no))"""

_GATE = ((60.0, 0.0), (60.0, 100.0))
_ZONE = [(20.0, 20.0), (80.0, 20.0), (80.0, 70.0), (20.0, 70.0)]
_IN = "(x > 20 AND x < 80 AND y > 20 AND y < 70)"
_REGIONS = {"left": [(0.0, 0.0), (30.0, 0.0), (30.0, 100.0), (0.0, 100.0)], "middle": _ZONE, "far": [(200.0, 0.0), (500.0, 0.0), (500.0, 50.0), (200.0, 50.0)]}
_REGION_SQL = "SELECT *, unnest(list_filter([CASE WHEN x > 0 AND x < 30 AND y > 0 AND y < 100 THEN 'left' END, CASE WHEN x > 20 AND x < 80 AND y > 20 AND y < 70 THEN 'middle' END, CASE WHEN x > 200 AND x < 500 AND y > 0 AND y < 50 THEN 'far' END], lambda r: r IS NOT NULL)) AS region FROM pos"


def positions(spark, d):
    e = read_table(spark, d, "events")
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 3_600_000_000) + 1
    k = F.get_json_object("props", "$.k").cast("int")
    last = F.max(F.struct("event_id", "value", k.alias("k")))
    grouped = e.groupBy(F.col("event_type").alias("stream"), F.col("user_id").alias("track_id"), hour.alias("frame_no")).agg(last.alias("m"))
    return grouped.select("stream", "track_id", "frame_no", F.col("m.value").alias("x"), F.col("m.k").cast("double").alias("y"), (F.col("m.event_id") % 3).alias("cls"))


@query(f"WITH {_P} SELECT stream, track_id, frame_no, x, y, cls, px, py FROM mv")
def track_positions(spark, d):
    """Positions with the one before."""
    return R.with_previous(positions(spark, d))


@query(f"WITH {_P}, h AS (SELECT *, CASE WHEN x > px THEN 'in' ELSE 'out' END AS direction FROM mv WHERE px IS NOT NULL AND (px - 60) * (x - 60) <= 0 AND NOT (px = 60 AND x = 60 AND false) AND ((px <> x AND py + (y - py) * (60 - px) / (x - px) BETWEEN 0 AND 100) OR (px = 60 AND x = 60))), k AS (SELECT *, row_number() OVER (PARTITION BY stream, track_id ORDER BY frame_no) AS r FROM h) SELECT stream, track_id, frame_no, cls, direction FROM k WHERE r = 1")
def line_crossings(spark, d):
    """Tracks that cross a line, once each."""
    return R.count_crossings(positions(spark, d), _GATE)


@query(f"WITH {_P}, h AS (SELECT *, CASE WHEN y > py THEN 'in' ELSE 'out' END AS direction, row_number() OVER (PARTITION BY stream, track_id ORDER BY frame_no) AS r FROM mv WHERE px IS NOT NULL AND {_IN}) SELECT stream, track_id, frame_no, cls, direction FROM h WHERE r = 1")
def zone_entries(spark, d):
    """Tracks that are inside a zone, once each."""
    return R.count_entries(positions(spark, d), _ZONE)


@query(f"WITH {_P}, q AS (SELECT stream, frame_no, region, count(*) AS n FROM ({_REGION_SQL}) GROUP BY ALL), f AS (SELECT DISTINCT stream, frame_no, unnest(['left', 'middle', 'far']) AS region FROM pos) SELECT stream, frame_no, region, coalesce(last_value(n IGNORE NULLS) OVER (PARTITION BY stream, region ORDER BY frame_no ROWS UNBOUNDED PRECEDING), 0) AS n FROM f LEFT JOIN q USING (stream, frame_no, region)")
def region_counts(spark, d):
    """Counts per region and frame, kept while a region is empty."""
    return R.region_counts(positions(spark, d), _REGIONS)


@query(f"WITH {_P} SELECT stream, frame_no, count_if(px IS NOT NULL AND {_IN}) AS n FROM mv GROUP BY ALL")
def queue_lengths(spark, d):
    """Tracks waiting in a zone per frame."""
    return R.queue_lengths(positions(spark, d), _ZONE)


@query(f"WITH {_P} SELECT stream, frame_no, CAST((count_if(x BETWEEN 0 AND 30 AND y BETWEEN 0 AND 100) > 0) AS INT) + CAST((count_if(x BETWEEN 20 AND 80 AND y BETWEEN 20 AND 70) > 0) AS INT) + CAST((count_if(x BETWEEN 200 AND 500 AND y BETWEEN 0 AND 50) > 0) AS INT) AS occupied, 3 - (CAST((count_if(x BETWEEN 0 AND 30 AND y BETWEEN 0 AND 100) > 0) AS INT) + CAST((count_if(x BETWEEN 20 AND 80 AND y BETWEEN 20 AND 70) > 0) AS INT) + CAST((count_if(x BETWEEN 200 AND 500 AND y BETWEEN 0 AND 50) > 0) AS INT)) AS free FROM pos GROUP BY stream, frame_no")
def slot_occupancy(spark, d):
    """Occupied and free slots per frame, borders included."""
    return R.occupancy(positions(spark, d), _REGIONS)


@query(f"WITH {_P}, g AS (SELECT stream, CAST(floor(x / 10) AS BIGINT) AS gx, CAST(floor(y / 10) AS BIGINT) AS gy, count(*) AS k FROM pos GROUP BY ALL) SELECT stream, gx + dx AS cx, gy + dy AS cy, CAST(sum(2 * k) AS BIGINT) AS heat FROM g, range(-2, 3) a(dx), range(-2, 3) b(dy) WHERE dx * dx + dy * dy <= 4 GROUP BY ALL")
def heatmap(spark, d):
    """Heat per cell around all positions."""
    return R.heat(positions(spark, d), 2, 10)


@query(f"WITH {_P}, c AS (SELECT stream, frame_no, cls, count(*) AS n FROM pos WHERE frame_no % 30 = 0 GROUP BY ALL), r AS (SELECT *, dense_rank() OVER (PARTITION BY stream ORDER BY frame_no DESC) AS back FROM c) SELECT stream, frame_no, cls, n FROM r WHERE back <= 10")
def class_timeline(spark, d):
    """Counts per class of every 30th frame, the last ten."""
    return R.class_counts(positions(spark, d), 30, 10)


@query(f"WITH {_P}, c AS (SELECT stream, frame_no, count(*) AS n FROM pos GROUP BY ALL) SELECT stream, min(frame_no) AS frame_no FROM c WHERE n >= 5 GROUP BY stream")
def alarms(spark, d):
    """First frame with five objects."""
    return R.alarms(positions(spark, d), 5)


@query(f"WITH {_P} SELECT stream, track_id, frame_no, len(list(x) OVER w) AS length, round(list_sum(list(x) OVER w), 6) AS total FROM pos WINDOW w AS (PARTITION BY stream, track_id ORDER BY frame_no ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def track_history(spark, d):
    """The last 30 centres of a track."""
    h = R.history(positions(spark, d), 30)
    return h.select("stream", "track_id", "frame_no", "length", F.round(F.aggregate("points", F.lit(0.0), lambda a, p: a + p["x"]), 6).alias("total"))


@query(f"WITH {_P}, n AS (SELECT *, row_number() OVER (PARTITION BY stream, track_id ORDER BY frame_no) AS k FROM pos), e AS (SELECT a.stream, a.track_id, b.frame_no AS fixed_at, sqrt((b.x - a.x) ^ 2 + (b.y - a.y) ^ 2) * 0.05 / ((b.frame_no - a.frame_no) / 30.0) * 3.6 AS v FROM n a JOIN n b ON a.stream = b.stream AND a.track_id = b.track_id AND a.k = 1 AND b.k = 5) SELECT stream, track_id, fixed_at, CAST(least(floor(v), 120) AS INT) AS kmh FROM e")
def track_speeds(spark, d):
    """Speeds from the first five positions."""
    return R.speeds(positions(spark, d))


@query(f"""WITH {_P}, s AS (SELECT *, last_value(CASE WHEN x > 60 THEN 1 WHEN x < 40 THEN -1 END IGNORE NULLS) OVER (PARTITION BY stream, track_id ORDER BY frame_no ROWS UNBOUNDED PRECEDING) AS state FROM pos), t AS (SELECT *, CASE WHEN state = -1 AND lag(state) OVER (PARTITION BY stream, track_id ORDER BY frame_no) = 1 THEN 1 ELSE 0 END AS turn FROM s)
SELECT stream, track_id, frame_no, CASE state WHEN 1 THEN 'up' WHEN -1 THEN 'down' END AS state, CAST(sum(turn) OVER (PARTITION BY stream, track_id ORDER BY frame_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS count FROM t""")
def repetitions(spark, d):
    """Up and down with hysteresis, and the turns so far."""
    return R.repetitions(positions(spark, d), "x", 40.0, 60.0).select("stream", "track_id", "frame_no", "state", "count")


@query("WITH l AS (SELECT *, lag(event_type) OVER w AS pt, lag(ts) OVER w AS pts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)) SELECT event_id FROM l WHERE NOT coalesce(pt = event_type AND epoch_us(ts) - epoch_us(pts) <= 3600000000, false)")
def changed_lines(spark, d):
    """Events that don't repeat the user's last one within an hour."""
    return R.changed_lines(read_table(spark, d, "events"), ["user_id"], "event_type", "ts", 3600.0).select("event_id")


@query("WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM m) SELECT user_id, run, event_type, count(*) AS length FROM r GROUP BY ALL")
def event_runs(spark, d):
    """Runs of equal event types per user."""
    return R.runs(read_table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def latest_events(spark, d):
    """The latest event of each user."""
    return R.latest(read_table(spark, d, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"])


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, d):
    """Counts per day and type."""
    w = W.counts(read_table(spark, d, "events"), "1 day")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH s AS (SELECT *, unnest([0, 1]) AS k FROM events) SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS start, event_type, count(*) AS n FROM s GROUP BY ALL")
def sliding_counts(spark, d):
    """Counts per type in windows of twelve hours every six."""
    return W.counts(read_table(spark, d, "events"), "12 hours", "6 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def session_counts(spark, d):
    """Sessions of users that end after two hours."""
    s = W.sessions(read_table(spark, d, "events"), "2 hours")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT event_type, list_sort(list(DISTINCT CAST(props->>'k' AS INT)))[1:3] AS smallest, count(DISTINCT CAST(props->>'k' AS INT)) AS kinds FROM events GROUP BY event_type")
def json_values(spark, d):
    """Distinct values of a JSON field per type and the three smallest."""
    k = F.from_json("props", "k int").getField("k")
    return read_table(spark, d, "events").groupBy("event_type").agg(F.slice(F.array_sort(F.collect_set(k)), 1, 3).alias("smallest"), F.count_distinct(k).alias("kinds"))


@query(f"WITH {_P}, r AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM mv WINDOW w AS (PARTITION BY stream, track_id ORDER BY frame_no)), a AS (SELECT stream, track_id, frame_no, abs(degrees(atan2(ny - y, nx - x) - atan2(py - y, px - x))) AS v, CAST(floor(sqrt((x - px) ^ 2 + (y - py) ^ 2)) AS BIGINT) AS way FROM r WHERE px IS NOT NULL AND nx IS NOT NULL) SELECT stream, track_id, frame_no, round(CASE WHEN v > 180 THEN 360 - v ELSE v END, 5) AS angle, way FROM a")
def turning_angles(spark, d):
    """Angle at each position between the one before and the one after, and whole pixels moved."""
    w = Window.partitionBy("stream", "track_id").orderBy("frame_no")
    p = R.with_previous(positions(spark, d)).withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w)).filter("px is not null and nx is not null")
    at = lambda a, b: (F.col(a), F.col(b))
    way = F.floor(F.sqrt(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2)))
    return p.select("stream", "track_id", "frame_no", F.round(G.joint_angle(at("px", "py"), at("x", "y"), at("nx", "ny")), 5).alias("angle"), way.alias("way"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'int' WHEN event_type = 'click' THEN 'float' WHEN event_type = 'error' THEN 'null' WHEN event_type = 'signup' THEN 'boolean' ELSE 'string' END AS kind, regexp_replace(event_type, '[|@#!¡·$€%&()=?¿^*;:,¨´><+]', '_', 'g') AS clean FROM events")
def value_kinds(spark, d):
    """The kind of a configuration text and text without special signs."""
    t = F.when(F.col("event_type") == "view", F.col("event_id").cast("string")).when(F.col("event_type") == "click", F.format_string("%.2f", "value")).when(F.col("event_type") == "error", "None").when(F.col("event_type") == "signup", "True").otherwise(F.col("event_type"))
    return read_table(spark, d, "events").select("event_id", X.typed(t).alias("kind"), X.clean_text(F.col("event_type")).alias("clean"))


def _stream(spark, d):
    """Predictions as frames of one stream per run, in the order of the images."""
    p = predictions(spark, d)
    frames = ordered_rank(p.select("run_id", "image_id").distinct(), ["run_id"], [F.col("image_id").cast("bigint").asc(), F.col("image_id").asc()], "frame_no")
    return p.join(frames.withColumn("frame_no", F.col("frame_no") + 1), ["run_id", "image_id"]).select(F.col("run_id").alias("stream"), "frame_no", "x1", "y1", "x2", "y2", "score", "cls")


@query()
def tracked_boxes(spark, d):
    """Predictions as frames of one stream per run, tracked."""
    return T.track(_stream(spark, d))


@query(f"WITH {S.DET}, f AS (SELECT *, dense_rank() OVER (PARTITION BY run_id ORDER BY CAST(image_id AS BIGINT), image_id) AS frame_no FROM det) SELECT run_id AS stream, count_if(frame_no = 1 AND score >= 0.25) AS first_boxes, 0 AS repeated, 0 AS strangers FROM f GROUP BY run_id")
def tracked_checks(spark, d):
    """Per stream what must hold: strong boxes of the first frame are tracked at once, no track is twice in a frame, no box comes from nowhere."""
    boxes = settle(_stream(spark, d))
    tracked = settle(T.track(boxes))
    per = tracked.groupBy("stream").agg(F.count_if(F.col("frame_no") == 1).alias("first_boxes"), (F.count(F.lit(1)) - F.count_distinct("frame_no", "track_id")).alias("repeated"))
    alien = tracked.join(boxes.select("stream", "frame_no", "score", "cls").distinct(), ["stream", "frame_no", "score", "cls"], "left_anti").groupBy("stream").agg(F.count(F.lit(1)).alias("strangers"))
    out = boxes.select("stream").distinct().join(per, "stream", "left").join(alien, "stream", "left")
    return out.select("stream", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("first_boxes", "repeated", "strangers")])
