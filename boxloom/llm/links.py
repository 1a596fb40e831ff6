"""Splits that keep tied records together: spanning forest by Borůvka contraction, then systematic dealing.

Two records are tied if they name the same source or the same capture group, and ties pass on. The graph has one
vertex per name, not per record: a source seen with several groups ties these groups, every other source hangs on
its one group. So hot groups are one vertex each, and the edges left are those that really bridge groups.

Defined results: a record that names nothing is tied to itself only. Rows delivered again count once. Rows without
``record_id`` still tie names but are not assigned. An empty table gives empty results. Further columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.names import plain_name, source_name, usable_split
from boxloom.operators.ranking import lookup, ordered_rank
from boxloom.runtime import settle


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels ``node, root``, forest ``a, b, weight, round``) of the undirected ``edges`` ``a, b, weight``.

    Each round every component picks its least edge by (weight, a, b), picks form trees with one mutual pair each,
    pointer doubling brings every vertex to the smaller end of that pair, and edges are contracted onto the roots.
    The order of edges is total, so picks close no cycles; components at least halve each round. All steps are
    grouped minima and equi-joins; nothing but a row count reaches the driver.
    """
    a, b = F.least("a", "b"), F.greatest("a", "b")
    live = settle(edges.select(a.alias("a"), b.alias("b"), "weight").filter("a <> b").groupBy("a", "b").agg(F.min("weight").alias("weight")).select("a", "b", F.struct("weight", F.col("a").alias("oa"), F.col("b").alias("ob")).alias("e")))
    labels = settle(live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    picked: list[DataFrame] = []
    while not live.isEmpty():
        ends = live.select(F.col("a").alias("u"), F.col("b").alias("v"), "e").unionByName(live.select(F.col("b").alias("u"), F.col("a").alias("v"), "e"))
        pick = settle(ends.groupBy("u").agg(F.min(F.struct("e", "v")).alias("m")).select("u", "m.v", "m.e"))
        picked.append(pick.select(F.col("e.oa").alias("a"), F.col("e.ob").alias("b"), F.col("e.weight").alias("weight")).distinct().withColumn("round", F.lit(len(picked) + 1)))
        back = pick.select(F.col("u").alias("v"), F.col("v").alias("v_to"))
        up = settle(pick.join(back, "v").select("u", F.when((F.col("v_to") == F.col("u")) & (F.col("u") < F.col("v")), F.col("u")).otherwise(F.col("v")).alias("p")))
        while True:
            above = up.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            nxt = settle(up.join(above, "p").select("u", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            up = nxt.select("u", "p")
            if nxt.filter("moved").isEmpty():
                break
        root_of = lambda name: up.select(F.col("u").alias(name), F.col("p").alias(f"{name}_root"))
        labels = settle(labels.join(root_of("root"), "root", "left").select("node", F.coalesce("root_root", "root").alias("root")))
        moved = live.join(root_of("a"), "a").join(root_of("b"), "b").filter("a_root <> b_root")
        live = settle(moved.groupBy(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).agg(F.min("e").alias("e")))
    empty = edges.select("a", "b", "weight").limit(0).withColumn("round", F.lit(0))
    return labels, settle(reduce(DataFrame.unionByName, picked, empty))


def named_records(records: DataFrame) -> DataFrame:
    """``record_id, split, s, g``: each record once, with its usable split and the names it carries."""
    return records.select("record_id", usable_split(F.col("old_split")).alias("split"), source_name(F.col("source_id")).alias("s"), plain_name(F.col("capture_group")).alias("g")).distinct()


def _edges(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``s, g0``: the group each source hangs on; edges ``a, b, weight`` between groups that a source ties)."""
    anchor = pairs.groupBy("s").agg(F.min("g").alias("g0"), F.max("g").alias("g1"))
    bridges = pairs.join(anchor.filter("g0 <> g1"), "s").filter("g <> g0")
    return anchor.select("s", "g0"), bridges.groupBy(F.col("g0").alias("a"), F.col("g").alias("b")).agg((-F.count(F.lit(1))).alias("weight"))


def tied(records: DataFrame, known: str | None = None, keep: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(``record_id, split, component`` per record, the spanning forest over group names).

    ``keep`` names a folder in which the forest and the group of each source are left; ``known`` names one that an
    earlier call left, whose ties then hold too. So records of a new day join the components of all days before, at the
    cost of the new records and the forest.
    """
    spark = records.sparkSession
    named = settle(named_records(records))
    pairs = named.filter("s is not null and g is not null").select("s", "g").distinct()
    if known:
        pairs = pairs.unionByName(spark.read.parquet(f"{known}/anchors").select("s", F.col("g0").alias("g"))).distinct()
    anchor, edges = _edges(pairs)
    if known:
        edges = edges.unionByName(spark.read.parquet(f"{known}/forest").select("a", "b", "weight"))
    labels, forest = spanning_forest(edges)
    if keep:
        anchor.write.parquet(f"{keep}/anchors")
        forest.write.parquet(f"{keep}/forest")
    loose = lookup(named.filter("g is null and s is not null"), anchor, "s").withColumn("g", F.col("g0")).drop("g0")
    with_group = named.filter("g is not null").unionByName(loose.select(*named.columns))
    rooted = lookup(with_group, labels.select(F.col("node").alias("g"), "root"), "g")
    name = F.coalesce(F.concat(F.lit("g/"), F.coalesce("root", "g")), F.concat(F.lit("s/"), F.col("s")))
    alone = named.filter("g is null and s is null").select("record_id", "split", F.concat(F.lit("r/"), F.col("record_id").cast("string")).alias("component"))
    return settle(rooted.select("record_id", "split", name.alias("component")).unionByName(alone)), forest


def torn(ties: DataFrame) -> DataFrame:
    """``record_id`` of every record whose component lies in more than one usable split."""
    spread = ties.groupBy("component").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).filter("lo <> hi").select("component")
    return lookup(ties, spread, "component", "inner").filter("record_id is not null").select("record_id").distinct()


def _band(size: Column) -> Column:
    """Sizes up to 16 have a band each, above that a band spans a quarter of a doubling."""
    return F.when(size <= 16, size).otherwise(16 + F.floor(4 * F.log2(size / 16))).cast("int")


def quotas(n: int, room: dict[str, float]) -> dict[str, int]:
    """``n`` whole components for the splits in proportion to the room left, the rest to the largest remainders."""
    open_ = {name: max(0.0, x) for name, x in room.items()}
    total = sum(open_.values())
    exact = {name: n * x / total if total else n / len(room) for name, x in open_.items()}
    out = {name: int(x) for name, x in exact.items()}
    for name in sorted(exact, key=lambda x: (out[x] - exact[x], -open_[x], x))[: n - sum(out.values())]:
        out[name] += 1
    return out


def _dealt(names: list[str]) -> Column:
    """The split of the ``rank``-th of ``n`` components of a band whose ``quota``s are spread evenly over the ranks.

    The first split takes the ranks at which ``rank * quota div n`` steps up, the next one deals with the ranks left.
    """
    at, n, rows = F.col("rank").cast("bigint"), F.col("_n").cast("bigint"), []
    for i, name in enumerate(names[:-1]):
        quota = F.get("quota", F.lit(i))
        upto = lambda r: F.floor(r * quota / F.greatest(n, F.lit(1)) + 1e-9)  # noqa: B023, E731
        rows.append((upto(at + 1) > upto(at), name))
        at, n = at - upto(at), n - quota
    out = F.lit(names[-1])
    for hit, name in reversed(rows):
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def deal(ties: DataFrame, targets: DataFrame) -> DataFrame:
    """``record_id, component, component_size, size_band, new_split``.

    Components are stratified into narrow bands of size. From large bands to small ones, each band is shared out in the
    proportions of the room that the bands before left in the splits, and dealt systematically over a pseudo-random
    order. So what a few huge components take too much or too little of is carried on and made up for by the many small
    ones. The driver sees one row per band, about 200 at most, whatever the number of components.
    """
    wanted = sorted(((r["split_name"], float(r["share"] or 0)) for r in targets.select("split_name", "share").collect() if r["split_name"]), key=lambda x: (-x[1], x[0]))
    scale = sum(share for _, share in wanted)
    if scale <= 0:
        raise ValueError("split_targets must hold a positive share")
    mine = ties.filter("record_id is not null")
    sizes = settle(mine.groupBy("component").agg(F.count(F.lit(1)).alias("component_size")).withColumn("size_band", _band(F.col("component_size"))))
    bands = sizes.groupBy("size_band").agg(F.count(F.lit(1)).alias("n"), F.sum("component_size").alias("rows")).orderBy(F.desc("size_band")).collect()
    total = sum(r["rows"] for r in bands)
    room, plan = {name: share / scale * total for name, share in wanted}, []
    for r in bands:
        given = quotas(r["n"], room)
        for name, n in given.items():
            room[name] -= n * r["rows"] / r["n"]
        plan.append((r["size_band"], r["n"], [given[name] for name, _ in wanted]))
    plan = ties.sparkSession.createDataFrame(plan, "_band int, _n bigint, quota array<bigint>")
    ranked = ordered_rank(sizes.withColumn("_order", F.xxhash64("component")), ["size_band"], [F.col("_order"), F.col("component")])
    dealt = ranked.join(F.broadcast(plan), F.col("size_band") == F.col("_band")).select("component", "component_size", "size_band", _dealt([name for name, _ in wanted]).alias("new_split"))
    return lookup(mine.select("record_id", "component"), dealt, "component", "inner").select("record_id", "component", "component_size", "size_band", "new_split")
