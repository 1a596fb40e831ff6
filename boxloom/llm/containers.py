"""Filling containers with texts: dominance reduction, then best fit decreasing, over size histograms.

Sizes are whole tokens up to the capacity, so an instance with any number of texts is a histogram with at most
``capacity`` rows. The reduction goes through sizes from large to small and fixes a set of up to three sizes for
good where it provably dominates every other set with the same largest item: whatever a packing puts beside that
item can change places with the set's other items. What is left is packed best fit decreasing. The plan goes back
as runs per size, and every text finds its container from its rank among texts of its size.

Defined results: a text above the capacity is cut into full pieces and one rest, no other text is cut. Null and
empty texts have no tokens and take no place. Equal sizes are ranked by document. A kind whose capacity is null or
below 1 is an error. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.tokens import VOCABULARY, token_count
from boxloom.operators.packing import Run, best_fit_decreasing
from boxloom.operators.ranking import ordered_rank
from boxloom.runtime import settle


def dominance_reduction(sizes: dict[int, int], capacity: int) -> tuple[list[Run], dict[int, int], dict[int, int], int]:
    """(runs of fixed sets, what is left of ``sizes``, items already placed per size, containers fixed).

    For the largest item j left, with room r beside it and k the largest other item that fits:
    nothing fits, {j} is fixed; k = r, {j, k} is fixed, as k stands for anything else that fits into r; at most one
    more item fits, or no two that fit have a sum above k and no three fit at all, {j, k} is fixed; at most two more
    fit and l, the largest beside j and k, is no smaller than the smaller one of any two that fit, {j, k, l} is fixed.
    """
    left = [0] * (capacity + 1)
    for size, n in sizes.items():
        left[size] += n
    placed: dict[int, int] = {}
    runs, opened = [], 0

    def fix(items: list[int], times: int) -> None:
        nonlocal opened
        for size in set(items):
            each, lo = items.count(size), placed.get(size, 0)
            runs.append(Run(size, lo, lo + each * times, opened, each))
            placed[size] = lo + each * times
            left[size] -= each * times
        opened += times

    def largest(most: int, *held: int) -> int:
        """The largest size up to ``most`` with an item left besides those ``held``."""
        for size in range(min(most, capacity), 0, -1):
            if left[size] > held.count(size):
                return size
        return 0

    def smallest(n: int, *held: int) -> list[int]:
        out: list[int] = []
        for size in range(1, capacity + 1):
            out += [size] * min(n - len(out), max(0, left[size] - held.count(size)))
            if len(out) == n:
                break
        return out

    def best_pair(room: int, *held: int) -> int:
        """The greatest sum up to ``room`` of two items left besides those ``held``; 0 if no two fit."""
        stock = [(s, left[s] - held.count(s)) for s in range(1, room) if left[s] > held.count(s)]
        lo, hi, best = 0, len(stock) - 1, 0
        while lo <= hi:
            if lo == hi and stock[lo][1] < 2:
                break
            total = stock[lo][0] + stock[hi][0]
            if total <= room:
                best = max(best, total)
                lo += 1
            else:
                hi -= 1
        return best

    for j in range(capacity, 0, -1):
        while left[j]:
            room = capacity - j
            k = largest(room, j)
            if not k:
                fix([j], left[j] if 2 * j > capacity else 1)
                continue
            times = left[j] // 2 if j == k else min(left[j], left[k])
            if k == room:
                fix([j, k], times)
                continue
            few = smallest(3, j)
            if len(few) < 2 or few[0] + few[1] > room:
                fix([j, k], times)
                continue
            if len(few) == 3 and sum(few) <= room:
                break
            if best_pair(room, j) <= k:
                fix([j, k], times)
                continue
            beside = largest(room - k, j, k)
            smaller = largest(room // 2, j)
            if beside and smaller <= beside:
                same = [j, k, beside]
                fix(same, min(left[s] // same.count(s) for s in same))
                continue
            break
    return runs, {s: n for s, n in enumerate(left) if n}, placed, opened


def fill(sizes: dict[int, int], capacity: int) -> tuple[list[Run], int, int]:
    """(runs, containers, containers fixed by dominance) for items with the given sizes."""
    runs, left, placed, fixed = dominance_reduction(sizes, capacity)
    rest, opened = best_fit_decreasing(left, capacity, placed, fixed)
    return runs + rest, opened, fixed


def pieces(documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``container_kind, capacity, doc_id, piece_no, first_token, n_tokens``: what has to be placed."""
    kinds = [(r["container_kind"], r["capacity_tokens"]) for r in containers.select("container_kind", "capacity_tokens").distinct().collect()]
    if any(not c or c < 1 for _, c in kinds):
        raise ValueError("capacity_tokens must be at least 1")
    sized = settle(documents.select("doc_id", token_count(F.col("text"), vocabulary).alias("all_tokens")).filter("all_tokens > 0"))
    offered = F.explode(F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(int(c)).alias("capacity")) for k, c in kinds])).alias("k")
    wide = sized.select("doc_id", "all_tokens", offered).select("doc_id", "all_tokens", "k.*")
    cut = wide.withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.expr("cast((all_tokens - 1) div capacity as int)"))))
    first = F.col("piece_no").cast("bigint") * F.col("capacity")
    return cut.select("container_kind", "capacity", "doc_id", "piece_no", first.alias("first_token"), F.least(F.col("capacity").cast("bigint"), F.col("all_tokens") - first).cast("int").alias("n_tokens"))


def pack(documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(pieces with ``container_id``, report per kind).

    The driver gets one histogram row per kind and size, at most the sum of the capacities, and sends back a plan of
    that order; both are independent of the number of texts.
    """
    spark = documents.sparkSession
    if not containers.head(1):
        schema = "container_kind string, capacity int, doc_id bigint, piece_no int, first_token bigint, n_tokens int, container_id bigint"
        return spark.createDataFrame([], schema), spark.createDataFrame([], "container_kind string, capacity int, containers bigint, fixed bigint, least bigint, tokens bigint, fill double")
    cut = settle(pieces(documents, containers, vocabulary))
    histogram: dict[tuple[str, int], dict[int, int]] = {}
    for r in cut.groupBy("container_kind", "capacity", "n_tokens").agg(F.count(F.lit(1)).alias("n")).collect():
        histogram.setdefault((r["container_kind"], r["capacity"]), {})[r["n_tokens"]] = r["n"]
    plan, report = [], []
    for (kind, capacity), sizes in sorted(histogram.items()):
        runs, opened, fixed = fill(sizes, capacity)
        by_size: dict[int, list] = {}
        for run in runs:
            by_size.setdefault(run.size, []).append((run.lo, run.hi, run.first_bin, run.per_bin))
        plan += [(kind, size, rows) for size, rows in by_size.items()]
        tokens = sum(s * n for s, n in sizes.items())
        report.append((kind, capacity, opened, fixed, -(-tokens // capacity), tokens, tokens / (opened * capacity)))
    runs = spark.createDataFrame(plan, "container_kind string, n_tokens int, _runs array<struct<lo:bigint,hi:bigint,first_bin:bigint,per_bin:bigint>>")
    ranked = ordered_rank(cut, ["container_kind", "n_tokens"], [F.col("doc_id"), F.col("piece_no")], "_rank")
    run = F.element_at(F.filter("_runs", lambda x: (x["lo"] <= F.col("_rank")) & (F.col("_rank") < x["hi"])), 1)
    placed = ranked.join(F.broadcast(runs), ["container_kind", "n_tokens"]).withColumn("_run", run)
    packed = placed.select("container_kind", "capacity", "doc_id", "piece_no", "first_token", "n_tokens", F.expr("_run.first_bin + (_rank - _run.lo) div _run.per_bin").alias("container_id"))
    return packed, spark.createDataFrame(report, "container_kind string, capacity int, containers bigint, fixed bigint, least bigint, tokens bigint, fill double")
