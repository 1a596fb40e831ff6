"""Queries over epoch logs: best epochs, deltas, contrasts, curves, early stopping, outliers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxloom.functions import text as X
from boxloom.operators import experiments as E
from boxloom.operators import metrics as M
from boxloom.plans.registry import Registry
from boxloom.runtime import read_table, scratch_path
from boxloom.sources import readers, writers

query = Registry()
QUERIES, SQL = query.queries, query.sql

_COLS = "elapsed_s, train_box_loss, train_cls_loss, train_dfl_loss, metric_precision, metric_recall, metric_map50, metric_map50_95, val_box_loss, val_cls_loss, val_dfl_loss"
_PACK = ", ".join(f"{c} := {c}" for c in _COLS.split(", "))
_E = f"ep AS (SELECT run_id, epoch, unnest(max(struct_pack({_PACK}))) FROM epoch_log GROUP BY run_id, epoch)"
_B = f"{_E}, bk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY metric_map50_95 DESC NULLS LAST, epoch) AS k, count(*) OVER (PARTITION BY run_id) AS n, arg_max(elapsed_s, epoch) OVER (PARTITION BY run_id) AS end_s FROM ep), best AS (SELECT run_id, n AS epochs_observed, end_s, CASE WHEN metric_map50_95 IS NOT NULL THEN epoch END AS best_epoch, metric_precision AS precision, metric_recall AS recall, metric_map50 AS map50, metric_map50_95 AS map50_95 FROM bk WHERE k = 1)"
_SEED = "CAST(regexp_extract(run_id, '(\\d+)$', 1) AS INT)"


def log(spark, d):
    return E.epochs(read_table(spark, d, "epoch_log"))


def best(spark, d):
    return E.best_epochs(log(spark, d))


def numbered(rows):
    return rows.withColumn("number", F.regexp_extract("run_id", r"(\d+)\z", 1).cast("int"))


@query(f"WITH {_E} SELECT * FROM ep")
def epochs(spark, d):
    """Each epoch of a run once."""
    return log(spark, d)


@query(f"WITH {_B} SELECT run_id, epochs_observed, end_s, best_epoch, precision, recall, map50, map50_95 FROM best")
def best_epochs(spark, d):
    """First best epoch of every run."""
    return best(spark, d)


@query(f"WITH {_B} SELECT run_id, map50_95 FROM best ORDER BY map50_95 DESC NULLS LAST, run_id LIMIT 5")
def top_runs(spark, d):
    """The five best runs, the report that a search prints."""
    return best(spark, d).select("run_id", "map50_95").orderBy(F.desc_nulls_last("map50_95"), "run_id").limit(5)


@query(f"WITH {_B}, c AS (SELECT run_id AS child, 'run_' || lpad(CAST({_SEED} - {_SEED} % 4 AS VARCHAR), 6, '0') AS parent, map50_95 AS cm, end_s AS cs FROM best), j AS (SELECT child, parent, 100 * (cm - p.map50_95) AS delta_pp, 100 * (cs / p.end_s - 1) AS cost_pct FROM c JOIN best p ON p.run_id = c.parent WHERE child <> parent) SELECT child, parent, round(delta_pp, 6) AS delta_pp, round(cost_pct, 6) AS cost_pct, CASE WHEN delta_pp >= 0.3 THEN 'accuracy' WHEN delta_pp >= -0.1 AND cost_pct IS NOT NULL AND cost_pct <= -10 THEN 'efficiency' ELSE 'threshold_not_met' END AS decision FROM j")
def child_parent_deltas(spark, d):
    """Every run beside the first of its block of four: deltas in points and a decision."""
    runs = best(spark, d)
    pairs = numbered(runs).select(F.col("run_id").alias("child"), F.format_string("run_%06d", F.col("number") - F.col("number") % 4).alias("parent")).filter("child <> parent")
    known = pairs.join(runs.select(F.col("run_id").alias("parent")), "parent", "left_semi")
    return E.child_parent(runs, known.select("child", "parent")).select("child", "parent", F.round("delta_pp", 6).alias("delta_pp"), F.round("cost_pct", 6).alias("cost_pct"), "decision")


@query(f"""WITH {_B}, c AS (SELECT {_SEED} // 4 AS seed, {_SEED} % 4 AS cell, map50_95 AS v FROM best), w AS (SELECT seed, avg(v) FILTER (cell = 0) AS base, avg(v) FILTER (cell = 1) AS a, avg(v) FILTER (cell = 2) AS b, avg(v) FILTER (cell = 3) AS ab FROM c GROUP BY seed)
SELECT seed, round(100 * (a - base), 6) AS effect_a, round(100 * (b - base), 6) AS effect_b, round(100 * (ab - base), 6) AS effect_ab, round(100 * ((ab - b) - (a - base)), 6) AS interaction FROM w WHERE base IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND ab IS NOT NULL""")
def factorial_effects(spark, d):
    """Two factors and their interaction per block of four runs."""
    cells = numbered(best(spark, d)).select(F.floor(F.col("number") / 4).cast("int").alias("seed"), F.element_at(F.array(*[F.lit(x) for x in ("base", "a", "b", "ab")]), F.col("number") % 4 + 1).alias("cell"), F.col("map50_95").alias("value"))
    return E.factorial(cells).select("seed", *[F.round(c, 6).alias(c) for c in ("effect_a", "effect_b", "effect_ab", "interaction")])


_FACT = f"{_B}, c AS (SELECT {_SEED} // 4 AS seed, {_SEED} % 4 AS cell, map50_95 AS v FROM best), w AS (SELECT seed, avg(v) FILTER (cell = 0) AS base, avg(v) FILTER (cell = 1) AS a, avg(v) FILTER (cell = 2) AS b, avg(v) FILTER (cell = 3) AS ab FROM c GROUP BY seed), i AS (SELECT seed, 100 * ((ab - b) - (a - base)) AS v FROM w WHERE base IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND ab IS NOT NULL), s AS (SELECT min(seed) AS first FROM i)"


@query(f"WITH {_FACT} SELECT round(max(v) FILTER (seed = first), 6) AS discovered, count(v) FILTER (seed <> first) AS held_out, round(avg(v) FILTER (seed <> first), 6) AS held_out_mean, round(stddev_samp(v) FILTER (seed <> first), 6) AS held_out_sd, coalesce(min(v) FILTER (seed <> first) > 0, false) AS directional, coalesce(avg(v) FILTER (seed <> first) >= 0.3, false) AS stable FROM i, s")
def interaction_replication(spark, d):
    """Whether the interaction of the first block of runs holds in the others."""
    cells = numbered(best(spark, d)).select(F.floor(F.col("number") / 4).cast("int").alias("seed"), F.element_at(F.array(*[F.lit(x) for x in ("base", "a", "b", "ab")]), F.col("number") % 4 + 1).alias("cell"), F.col("map50_95").alias("value"))
    effects = E.factorial(cells)
    first = effects.agg(F.min("seed").alias("s")).first()["s"]
    out = E.replication(effects, -1 if first is None else first)
    return out.select(F.round("discovered", 6).alias("discovered"), "held_out", F.round("held_out_mean", 6).alias("held_out_mean"), F.round("held_out_sd", 6).alias("held_out_sd"), "directional", "stable")


@query(f"WITH {_B} SELECT {_SEED} % 4 AS cell, count(map50_95) AS n, round(avg(map50_95), 6) AS mean, round(stddev_samp(map50_95), 6) AS sd, round(stddev_pop(map50_95), 6) AS sd_pop, min(map50_95) AS least, max(map50_95) AS most FROM best GROUP BY 1")
def cell_spread(spark, d):
    """Mean and both deviations per cell."""
    cells = numbered(best(spark, d)).withColumn("cell", F.col("number") % 4)
    return E.spread(cells, ["cell"], "map50_95").select("cell", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "sd_pop")], "least", "most")


@query(f"""WITH {_E}, v AS (SELECT run_id, epoch, coalesce(metric_map50_95, 0.0) AS v FROM ep), r AS (SELECT *, max(v) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM v),
h AS (SELECT *, last_value(CASE WHEN b IS NULL OR v > b OR b = 0 THEN epoch END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best_at FROM r) SELECT run_id, min(epoch) AS stop_epoch, arg_min(best_at, epoch) AS best_at FROM h WHERE epoch - best_at >= 5 GROUP BY run_id""")
def early_stopping(spark, d):
    """Where a patience of five epochs would have stopped each run."""
    return E.early_stop(log(spark, d), "metric_map50_95", 5)


@query(f"WITH {_E}, b AS (SELECT *, max(metric_map50_95) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ep) SELECT run_id, count(*) AS n, round(regr_slope(metric_map50_95, epoch), 8) AS slope, round(regr_intercept(metric_map50_95, epoch), 8) AS intercept FROM b WHERE metric_map50_95 IS NOT NULL AND (m IS NULL OR metric_map50_95 > m) GROUP BY run_id")
def rising_line(spark, d):
    """A straight line through the rising epochs of each run."""
    return E.straight_line(log(spark, d), "metric_map50_95").select("run_id", "n", F.round("slope", 8).alias("slope"), F.round("intercept", 8).alias("intercept"))


@query(f"""WITH {_E}, s AS (SELECT run_id, epoch, train_box_loss AS v, first_value(train_box_loss) OVER w AS f, last_value(train_box_loss) OVER w AS l, lag(train_box_loss, 1) OVER o AS a1, lag(train_box_loss, 2) OVER o AS a2, lead(train_box_loss, 1) OVER o AS b1, lead(train_box_loss, 2) OVER o AS b2 FROM ep WHERE train_box_loss IS NOT NULL WINDOW o AS (PARTITION BY run_id ORDER BY epoch), w AS (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT run_id, epoch, round((v + coalesce(a1, f) + coalesce(b1, l) + coalesce(a2, f) + coalesce(b2, l)) / 5, 6) AS smooth FROM s""")
def smoothed_loss(spark, d):
    """Centred mean of five epochs with padded ends."""
    return M.smoothed(log(spark, d).filter("train_box_loss is not null"), ["run_id"], "epoch", "train_box_loss", 2).select("run_id", "epoch", F.round("smooth", 6).alias("smooth"))


@query(f"WITH {_E} SELECT run_id, epoch, round((elapsed_s - lag(elapsed_s) OVER w), 6) AS step_s, round(greatest(0.0, (train_box_loss - lag(train_box_loss) OVER w) / greatest(0.1, elapsed_s - lag(elapsed_s) OVER w)), 8) AS rate FROM ep WINDOW w AS (PARTITION BY run_id ORDER BY epoch)")
def rates(spark, d):
    """Change per second from epoch to epoch, time floored at 0.1 s, never negative."""
    w = Window.partitionBy("run_id").orderBy("epoch")
    step = F.col("elapsed_s") - F.lag("elapsed_s").over(w)
    rate = F.when(step.isNotNull() & (F.col("train_box_loss") - F.lag("train_box_loss").over(w)).isNotNull(), F.greatest(F.lit(0.0), (F.col("train_box_loss") - F.lag("train_box_loss").over(w)) / F.greatest(F.lit(0.1), step))).otherwise(0.0)
    return log(spark, d).select("run_id", "epoch", F.round(step, 6).alias("step_s"), F.round(rate, 8).alias("rate"))


@query(f"WITH {_E}, p AS (SELECT run_id, epoch, metric_map50 AS y, min(epoch) OVER (PARTITION BY run_id) AS lo, max(epoch) OVER (PARTITION BY run_id) AS hi FROM ep WHERE metric_map50 IS NOT NULL), g AS (SELECT DISTINCT run_id, lo, hi, i, lo + i * ((hi - lo) / 99.0) AS x FROM p, range(0, 100) r(i) WHERE hi > lo), j AS (SELECT g.run_id, i, x, (SELECT max(struct_pack(e := epoch, y := y)) FROM p WHERE p.run_id = g.run_id AND epoch <= x + 1e-9) AS a, (SELECT min(struct_pack(e := epoch, y := y)) FROM p WHERE p.run_id = g.run_id AND epoch >= x - 1e-9) AS b FROM g) SELECT run_id, CAST(i AS INT) AS i, round(CASE WHEN a.e = b.e THEN a.y ELSE a.y + (b.y - a.y) * (x - a.e) / (b.e - a.e) END, 5) AS y FROM j")
def resampled_curves(spark, d):
    """Each run's curve at 100 even places."""
    return E.resample(log(spark, d), "epoch", "metric_map50", 100).select("run_id", "i", F.round("y", 5).alias("y"))


@query()
def clipped_step_times(spark, d):
    """Epoch times within two population deviations after at most three rounds of clipping."""
    w = Window.partitionBy("run_id").orderBy("epoch")
    steps = log(spark, d).select("run_id", "epoch", (F.col("elapsed_s") - F.lag("elapsed_s").over(w)).alias("step_s"))
    return E.clip_outliers(steps, "step_s", 2.0, 3)


@query(f"WITH {_B}, k AS (SELECT unnest(['precision', 'recall', 'map50', 'map50_95']) AS metric), l AS (SELECT run_id, metric, CASE metric WHEN 'precision' THEN precision WHEN 'recall' THEN recall WHEN 'map50' THEN map50 ELSE map50_95 END AS v FROM best CROSS JOIN k) SELECT coalesce(a.metric, b.metric) AS metric, a.v AS left_value, b.v AS right_value FROM (SELECT * FROM l WHERE run_id = 'run_000000') a FULL JOIN (SELECT * FROM l WHERE run_id = 'run_000003') b ON a.metric = b.metric WHERE a.v IS DISTINCT FROM b.v AND coalesce(a.metric, b.metric) NOT IN ('map50')")
def config_difference(spark, d):
    """Keys on which two runs differ, less an allow-list (a null-safe full outer join of exploded maps)."""
    flat = best(spark, d).select("run_id", F.explode(F.create_map(*[x for c in ("precision", "recall", "map50", "map50_95") for x in (F.lit(c), F.col(c))])).alias("metric", "v"))
    side = lambda run, n: flat.filter(F.col("run_id") == run).select("metric", F.col("v").alias(n))
    both = side("run_000000", "left_value").join(side("run_000003", "right_value"), "metric", "full")
    return both.filter(~F.col("left_value").eqNullSafe(F.col("right_value")) & ~F.col("metric").isin("map50"))


@query(f"WITH {_E} SELECT run_id, epoch, printf('%.6g', elapsed_s + 1e-9) AS elapsed, printf('%.6g', train_box_loss * 100000 + 1e-7) AS loss FROM ep WHERE elapsed_s IS NOT NULL AND train_box_loss IS NOT NULL")
def six_digit_rows(spark, d):
    """Epoch rows as the log writes them, six significant digits."""
    rows = log(spark, d).filter("elapsed_s is not null and train_box_loss is not null")
    return rows.select("run_id", "epoch", X.six_digits(F.col("elapsed_s")).alias("elapsed"), X.six_digits(F.col("train_box_loss") * 100000).alias("loss"))


@query(f"WITH {_E} SELECT * FROM ep")
def csv_round_trip(spark, d):
    """Epoch rows written as CSV with a fixed order of fields and read back with their schema."""
    target = scratch_path(spark, "epochs")
    writers.write_csv(log(spark, d), target, readers.EPOCH_LOG_FIELDS)
    return readers.read_log(spark, target)
