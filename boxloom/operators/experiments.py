"""Analysis of training runs: best epochs, deltas, contrasts, spreads, early stopping, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxloom.runtime import settle

KEYS = ["run_id"]


def epochs(log: DataFrame) -> DataFrame:
    """Each epoch of a run once; of differing repeats the greatest row."""
    rest = [c for c in log.columns if c not in ("run_id", "epoch")]
    return log.groupBy("run_id", "epoch").agg(F.max(F.struct(*rest)).alias("r")).select("run_id", "epoch", "r.*")


def best_epochs(log: DataFrame, metric: str = "metric_map50_95") -> DataFrame:
    """Per run the first epoch with the greatest metric, the number of epochs and the time at the last one."""
    first = F.max_by(F.struct("epoch", metric, "metric_precision", "metric_recall", "metric_map50"), F.struct(metric, -F.col("epoch")))
    rows = log.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("epochs_observed"), F.max_by("elapsed_s", "epoch").alias("end_s"), first.alias("b"))
    return rows.select("run_id", "epochs_observed", "end_s", F.when(F.col(f"b.{metric}").isNotNull(), F.col("b.epoch")).alias("best_epoch"), F.col("b.metric_precision").alias("precision"), F.col("b.metric_recall").alias("recall"), F.col("b.metric_map50").alias("map50"), F.col(f"b.{metric}").alias("map50_95"))


def spread(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Number, mean, sample deviation (null for one value), population deviation, least and greatest."""
    return values.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.stddev_pop(value).alias("sd_pop"), F.min(value).alias("least"), F.max(value).alias("most"))


def clip_outliers(values: DataFrame, value: str, sigmas: float = 2.0, rounds: int = 3) -> DataFrame:
    """Iterated two-sided clipping by population deviation: rows strictly within ``sigmas`` of the mean stay."""
    now = values.filter(F.col(value).isNotNull())
    for _ in range(rounds):
        m = now.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.count(F.lit(1)).alias("n")).first()
        if not m["n"] or not m["s"]:
            break
        nxt = now.filter((F.col(value) > m["m"] - sigmas * m["s"]) & (F.col(value) < m["m"] + sigmas * m["s"]))
        if nxt.count() == m["n"]:
            break
        now = settle(nxt)
    return now


def early_stop(log: DataFrame, metric: str, patience: int) -> DataFrame:
    """Per run the first epoch at which the metric has not risen above its best for ``patience`` epochs; best still 0 counts as risen."""
    w = Window.partitionBy(*KEYS).orderBy("epoch")
    value = F.coalesce(metric, F.lit(0.0))
    before = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rose = before.isNull() | (value > before) | (before == 0)
    marked = log.withColumn("rose_at", F.when(rose, F.col("epoch")))
    held = marked.withColumn("best_at", F.last("rose_at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return held.filter(F.col("epoch") - F.col("best_at") >= patience).groupBy(*KEYS).agg(F.min("epoch").alias("stop_epoch"), F.min_by("best_at", "epoch").alias("best_at"))


def decision(delta: Column, cost: Column, gain: float = 0.3, slack: float = -0.1, saving: float = -10.0) -> Column:
    """``accuracy`` if the gain in points is reached; ``efficiency`` if the loss stays within ``slack`` and the cost is
    known and lower by the saving in percent; else ``threshold_not_met``. An unknown cost can't pass."""
    return F.when(delta >= gain, "accuracy").when((delta >= slack) & cost.isNotNull() & (cost <= saving), "efficiency").otherwise("threshold_not_met")


def child_parent(runs: DataFrame, parents: DataFrame) -> DataFrame:
    """Children beside their parents: ``child, parent`` and the deltas in percentage points. A child whose parent is missing is an error."""
    a = parents.join(runs.select(F.col("run_id").alias("child"), F.col("map50_95").alias("c_map"), F.col("end_s").alias("c_s")), "child")
    b = a.join(runs.select(F.col("run_id").alias("parent"), F.col("map50_95").alias("p_map"), F.col("end_s").alias("p_s"), F.lit(True).alias("known")), "parent", "left")
    checked = b.withColumn("ok", F.when(F.col("known"), True).otherwise(F.raise_error(F.concat(F.lit("no run "), F.col("parent"))).cast("boolean")))
    delta, cost = 100 * (F.col("c_map") - F.col("p_map")), 100 * (F.col("c_s") / F.col("p_s") - 1)
    return checked.filter("ok").select("child", "parent", delta.alias("delta_pp"), cost.alias("cost_pct"), decision(delta, cost).alias("decision"))


def factorial(cells: DataFrame) -> DataFrame:
    """Per seed with all four cells (``a`` and ``b`` on or off): both effects alone, together, and their interaction, in points."""
    wide = cells.groupBy("seed").pivot("cell", ["base", "a", "b", "ab"]).agg(F.avg("value"))
    whole = wide.filter("base is not null and a is not null and b is not null and ab is not null")
    pp = lambda c: 100 * c
    return whole.select("seed", pp(F.col("a") - F.col("base")).alias("effect_a"), pp(F.col("b") - F.col("base")).alias("effect_b"), pp(F.col("ab") - F.col("base")).alias("effect_ab"), pp((F.col("ab") - F.col("b")) - (F.col("a") - F.col("base"))).alias("interaction"))


def replication(effects: DataFrame, discovery: int, value: str = "interaction", practical: float = 0.3) -> DataFrame:
    """One row: how an effect seen at one seed holds at the others. Directional if all are positive, stable if their mean reaches ``practical``."""
    held = F.when(F.col("seed") != discovery, F.col(value))
    return effects.agg(
        F.max(F.when(F.col("seed") == discovery, F.col(value))).alias("discovered"), F.count(held).alias("held_out"), F.avg(held).alias("held_out_mean"), F.stddev_samp(held).alias("held_out_sd"),
        F.coalesce(F.min(held) > 0, F.lit(False)).alias("directional"), F.coalesce(F.avg(held) >= practical, F.lit(False)).alias("stable"),
    )


def straight_line(log: DataFrame, y: str, x: str = "epoch") -> DataFrame:
    """Least squares line per run over rows where ``y`` is above all earlier ones."""
    w = Window.partitionBy(*KEYS).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    up = log.withColumn("_before", F.max(y).over(w)).filter(F.col(y).isNotNull() & (F.col("_before").isNull() | (F.col(y) > F.col("_before"))))
    return up.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def resample(log: DataFrame, x: str, y: str, points: int = 100) -> DataFrame:
    """The curve ``y`` over ``x`` of each run, linear between its points, at ``points`` even places of its range.

    Every sample looks up the segment that it falls into, found by exploding each segment's own samples.
    """
    w = Window.partitionBy(*KEYS).orderBy(x)
    both = Window.partitionBy(*KEYS)
    p = log.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select("run_id", F.col(x).cast("double").alias("x1"), F.col(y).alias("y1"))
    p = p.withColumn("x0", F.lag("x1").over(w.orderBy("x1"))).withColumn("y0", F.lag("y1").over(w.orderBy("x1"))).withColumn("lo", F.min("x1").over(both)).withColumn("hi", F.max("x1").over(both))
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    first = F.when(F.col("x0").isNull(), 0).otherwise(F.floor((F.col("x0") - F.col("lo")) / step + 1e-9) + 1)
    last = F.floor((F.col("x1") - F.col("lo")) / step + 1e-9)
    cut = p.filter("hi > lo").withColumn("a", first.cast("int")).withColumn("b", last.cast("int")).filter("a <= b")
    at = cut.withColumn("i", F.explode(F.sequence("a", "b"))).withColumn("x", F.col("lo") + F.col("i") * step)
    value = F.when(F.col("x0").isNull(), F.col("y1")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0")))
    return at.select("run_id", "i", "x", value.alias("y"))


def reject_low(values: DataFrame, value: str, sigmas: float = 3.0, rounds: int = 3) -> DataFrame:
    """Rows at or above ``sigmas`` population deviations under the mean, ``rounds`` times over; one side only."""
    now = values
    for _ in range(rounds):
        floor = now.agg((F.avg(value) - sigmas * F.stddev_pop(value)).alias("f")).first()["f"]
        if floor is None:
            break
        now = now.filter(F.col(value) >= floor)
    return now
