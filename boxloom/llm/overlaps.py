"""Same and almost same images across splits: a weighted cosine join over inverted lists.

An image is the vector of its thumbnail: the 64 cells are dealt over 12 blocks of 5 or 6 neighbouring cells, each
block with its content is a term, and its weight is the root of its share of the cells. So all vectors have norm 1,
the dot product of two vectors is the share of cells in equal blocks, and the exact dot product over single cells
decides in the end: 56 of 64 cells or more.

Pruning loses nothing. Two images that differ in at most 8 cells spoil at most 8 blocks, so at least 4 blocks of 5
cells agree and the dot product is 20/64 or more. A term that no vector of the other side has weighs 0 there, so it is
left out, and vectors that can't reach 20/64 with the terms left go. The others list their terms from rare to frequent
(one order for all) and index them until what is left has a squared norm, and so a greatest possible product, below
20/64; the rarest term that a qualifying pair shares is then indexed by both. A list that is long on both sides is
split by the next shared term in the same way, with what the first one leaves to be reached.
A term also carries what the labels tell: boxes that pair off within 0.01 have equal counts and mean centres within
0.01, so lists are split by the count and a grid of mean centres; a look-up tries every cell that it can touch.

Defined results: a signature that is null or unreadable, or a thumbnail that isn't 64 hex digits, takes no part in
the near join; a digest that can't be read takes no part in the exact one. Classes of boxes don't matter. Copies
share one vector and are joined as one. Records without a usable split take no part. Empty tables give no rows.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from boxloom.functions.labels import boxes_of
from boxloom.functions.names import source_name, usable_split
from boxloom.llm.audits import audit_records, with_whole_digest
from boxloom.operators.ranking import meet
from boxloom.runtime import settle

CELLS = 64
MOST_DIFFERENT = 8
TOLERANCE = 0.01
_SLACK = 1e-9
#: Cells per block; a pair that qualifies shares at least len(BLOCKS) - MOST_DIFFERENT of them.
BLOCKS = (6, 5, 5, 6, 5, 5, 6, 5, 5, 6, 5, 5)
LEAST_DOT = sum(sorted(BLOCKS)[: len(BLOCKS) - MOST_DIFFERENT])
#: Term frequencies per side are kept in a sketch of so many counters, whatever the number of terms.
SKETCH = 1 << 12
#: Counters of the sketch that tells long lists.
LISTS = 1 << 18
GRID = 0.1


def split_records(audit: DataFrame, with_source: bool = False) -> DataFrame:
    """``record_id, digest, split, thumb, boxes`` (and ``source``) of records with a usable split; digest and thumbnail as bytes."""
    thumb = F.when(F.col("r.thumb_sig").rlike(r"^[0-9A-Fa-f]{64}\z"), F.unhex("r.thumb_sig"))
    fields = {"split": usable_split(F.col("r.old_split")), "thumb": thumb, "label": F.col("r.label_signature")} | ({"source": F.col("r.source_id")} if with_source else {})
    rows = with_whole_digest(audit_records(audit, ["old_split", "thumb_sig", "label_signature", *(["source_id"] if with_source else [])], fields).filter("split is not null"), audit)
    boxes = F.transform(boxes_of(F.col("label")), lambda b: F.struct(b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h")))
    # half the bytes of the hex form; the length keeps digests that were cut apart from whole ones
    digest = F.unhex(F.concat(F.lpad(F.col("digest"), 64, "0"), F.lpad(F.hex(F.length("digest")), 2, "0")))
    return rows.select("record_id", digest.alias("digest"), "split", "thumb", F.array_sort(boxes).alias("boxes"), *(["source"] if with_source else []))


def _halves() -> list[Column]:
    """The thumbnail as four signed 64-bit numbers."""
    return [F.conv(F.substring("cells", 16 * i + 1, 16), 16, -10).cast("bigint").alias(f"q{i}") for i in range(4)]


def different_cells(a: str, b: str) -> Column:
    """In how many of 64 cells the numbers ``<a>.q0..3`` and ``<b>.q0..3`` differ."""
    ones = F.lit(0x1111111111111111)
    out = F.lit(0)
    for i in range(4):
        x = F.col(f"{a}.q{i}").bitwiseXOR(F.col(f"{b}.q{i}"))
        folded = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        out = out + F.bit_count(folded.bitwiseAND(ones))
    return out


def vectors(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct vectors with ``vid``, their least record; membership ``record_id, vid, split``)."""
    usable = records.filter("thumb is not null and boxes is not null")
    # two independent 64-bit hashes stand for the content; the payload travels once per vector
    key = [F.xxhash64("thumb", F.col("boxes").cast("string")).alias("k1"), F.xxhash64(F.col("boxes").cast("string"), F.lit(1), "thumb").alias("k2")]
    keyed = usable.select("record_id", "split", "thumb", "boxes", *key)
    of_key = keyed.groupBy("k1", "k2").agg(F.min("record_id").alias("vid"), F.bool_or(F.col("split") == "train").alias("in_train"), F.bool_or(F.col("split") != "train").alias("in_eval"))
    members = keyed.select("record_id", "split", "k1", "k2").join(of_key, ["k1", "k2"]).select("record_id", "vid", "split", "in_train", "in_eval")
    members = settle(members)
    first = members.filter("record_id = vid").select("vid", "in_train", "in_eval")
    payload = usable.select(F.col("record_id").alias("vid"), "thumb", "boxes").join(first, "vid")
    return settle(payload.withColumn("cells", F.hex("thumb")).drop("thumb")), members


def _terms() -> Column:
    """All terms of a thumbnail as ``array<bigint>``: a hash of block and content with the number of cells in its low bits."""
    out, at = [], 1
    for i, n in enumerate(BLOCKS):
        out.append(_with_cells(F.xxhash64(F.lit(i), F.substring("cells", at, n)), F.lit(n)))
        at += n
    return F.array(*out)


def _with_cells(hashed: Column, cells: Column) -> Column:
    return F.shiftleft(hashed, 3).bitwiseOR((cells - min(BLOCKS)).cast("bigint"))


def cells_of(term: Column) -> Column:
    """How many cells the block of a term has."""
    return (F.pmod(term, F.lit(8)) + min(BLOCKS)).cast("int")


def _prefix(terms: Column, need: Column) -> Column:
    """The leading ``terms`` (rare ones first) that are needed: as long as the cells from one on reach ``need``."""
    whole = F.aggregate(terms, F.lit(0), lambda n, t: n + cells_of(t))
    kept = F.aggregate(
        terms,
        F.struct(whole.alias("left"), F.lit(0).alias("n")),
        lambda a, t: F.when(a["left"] >= need, F.struct((a["left"] - cells_of(t)).alias("left"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(-1).alias("left"), a["n"].alias("n"))),
    )
    return F.slice(terms, F.lit(1), kept["n"])


def _weighed(vecs: DataFrame) -> DataFrame:
    """``vecs`` with ``terms``: those that vectors of the other side may share, rare ones first.

    The greatest weight that a term has on the other side is 0 if no vector there has it; then it can add nothing to a
    dot product and is left out, and a vector whose other terms can't reach the least dot product is left out with all
    of them. Counts per side come from a sketch of a fixed number of counters, so what the driver holds and sends back
    does not grow; a counter shared by several terms can only keep more.
    """
    with_terms = vecs.withColumn("terms", _terms())
    slot = lambda t: F.pmod(t, F.lit(SKETCH)).cast("int")
    each = with_terms.select("in_train", "in_eval", F.explode("terms").alias("term"))
    counted = each.groupBy(slot(F.col("term")).alias("slot")).agg(F.count_if("in_train").alias("t"), F.count_if("in_eval").alias("e")).collect()
    train, held = [0] * SKETCH, [0] * SKETCH
    for r in counted:
        train[r["slot"]], held[r["slot"]] = r["t"], r["e"]
    sketch = lambda counts: F.from_json(F.lit(json.dumps(counts)), "array<bigint>")
    of_train, of_held = sketch(train), sketch(held)
    known = F.transform("terms", lambda t: F.struct(F.get(of_train, slot(t)).alias("t"), F.get(of_held, slot(t)).alias("e"), t.alias("term")))
    met = F.filter(known, lambda k: (F.col("in_train") & (k["e"] > 0)) | (F.col("in_eval") & (k["t"] > 0)))
    ranked = F.transform(F.array_sort(F.transform(met, lambda k: F.struct((k["t"] + k["e"]).alias("df"), k["term"].alias("term")))), lambda k: k["term"])
    reach = F.aggregate("terms", F.lit(0), lambda n, t: n + cells_of(t))
    return with_terms.withColumn("terms", ranked).filter(reach >= LEAST_DOT)


def _grid_cells(mean: Column, reach: float) -> Column:
    lo, hi = F.floor((mean - reach) / GRID), F.floor((mean + reach) / GRID)
    return F.sequence(lo, hi)


def pair_off(x: list, y: list) -> bool:
    """Whether two box lists pair off one to one within the tolerance (augmenting paths)."""
    if len(x) != len(y):
        return False
    near = [[j for j, q in enumerate(y) if all(abs(p[k] - q[k]) <= TOLERANCE + _SLACK for k in ("x", "y", "w", "h"))] for p in x]
    owner: dict[int, int] = {}
    holds: dict[int, int] = {}
    for i in range(len(x)):
        came: dict[int, int] = {}
        open_, free = [i], None
        while open_ and free is None:
            p = open_.pop()
            for j in near[p]:
                if j not in came:
                    came[j] = p
                    if j not in owner:
                        free = j
                        break
                    open_.append(owner[j])
        if free is None:
            return False
        # along the path every box moves on to the place found for it
        while True:
            p = came[free]
            before = holds.get(p)
            owner[free], holds[p] = p, free
            if p == i:
                break
            free = before
    return True


def _pairs_off(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([pair_off(list(x), list(y)) for x, y in zip(a, b)], dtype="bool")


def _alike(p: Column, q: Column) -> Column:
    return reduce(lambda a, b: a & b, [F.abs(p[k] - q[k]) <= TOLERANCE + _SLACK for k in ("x", "y", "w", "h")])


def boxes_agree(pairs: DataFrame) -> DataFrame:
    """The ``pairs`` whose ``boxes_a`` and ``boxes_b`` (sorted) pair off one to one.

    Boxes that agree in their sorted order do, and lists in which some box has no counterpart don't; only what is left,
    crowded images as a rule, takes the search for a pairing in the workers.
    """
    in_order = F.forall(F.zip_with("boxes_a", "boxes_b", lambda p, q: F.coalesce(_alike(p, q), F.lit(False))), lambda x: x)
    met = lambda a, b: F.forall(a, lambda p: F.exists(b, lambda q: _alike(p, q)))
    same = F.size("boxes_a") == F.size("boxes_b")
    told = F.when(~same, 0).when(in_order, 1).when(F.size("boxes_a") < 2, 0).when(met("boxes_a", "boxes_b") & met("boxes_b", "boxes_a"), 2).otherwise(0)
    marked = settle(pairs.withColumn("_told", told).filter("_told > 0"))
    agrees = F.pandas_udf(_pairs_off, BooleanType())
    return marked.filter("_told = 1").unionByName(marked.filter("_told = 2").filter(agrees("boxes_a", "boxes_b"))).drop("_told", "boxes_a", "boxes_b")


def _long_lists(lists: DataFrame, long_list: int) -> DataFrame:
    """``slot`` of lists with many vectors of both sides, by a sketch of ``LISTS`` counters in which most hold usual lists."""
    loads = settle(lists.groupBy(_list_slot().alias("slot")).agg(F.count_if("train").alias("t"), F.count_if(~F.col("train")).alias("e")))
    usual = loads.agg(F.percentile_approx("t", F.lit(0.5)).alias("t"), F.percentile_approx("e", F.lit(0.5)).alias("e")).first()
    return loads.filter((F.col("t") > 2 * (usual["t"] or 0) + long_list) & (F.col("e") > 2 * (usual["e"] or 0) + long_list)).select("slot")


def _list_slot() -> Column:
    return F.pmod(F.shiftright("list", 3), F.lit(LISTS)).cast("int")


def candidates(ready: DataFrame, long_list: int = 1000) -> DataFrame:
    """``vid_train, vid_eval``: vectors that meet in a list.

    A list holds the vectors with one term, count of boxes and cell of the grid of mean centres. Where many vectors of
    both sides have a term, its list is split by the next shared term: of the terms after it so many are taken that the
    rest can't make up the least dot product, and so on until the terms of a list alone reach it. Only then a long list
    is met portion by portion.
    """
    reach = TOLERANCE + 1e-6
    place = lambda c: F.floor(F.col(c) / GRID)
    begin = ["vid", F.lit(LEAST_DOT).alias("need"), F.lit(0).alias("used"), "terms", F.xxhash64("boxes_n", "gx", "gy").alias("list")]
    train = ready.filter("in_train").withColumn("gx", place("mx")).withColumn("gy", place("my")).select(F.lit(True).alias("train"), *begin)
    held = ready.filter("in_eval").withColumn("gx", F.explode(_grid_cells(F.col("mx"), reach))).withColumn("gy", F.explode(_grid_cells(F.col("my"), reach))).select(F.lit(False).alias("train"), *begin)
    side = lambda df, train, name: df.filter(F.col("train") == train).select("list", F.col("vid").alias(name))
    todo, found = train.unionByName(held), []
    while True:
        rest = F.slice("terms", F.col("used") + 1, F.greatest(F.size("terms") - F.col("used"), F.lit(0)))
        keyed = F.transform(_prefix(rest, F.col("need")), lambda t: _with_cells(F.xxhash64("list", t), cells_of(t)))
        kept = settle(todo.select("train", "vid", "need", "used", keyed.alias("lists")))
        each = kept.select("train", "vid", "need", "used", F.posexplode("lists").alias("i", "list"))
        lists = each.select("train", "vid", (F.col("need") - cells_of(F.col("list"))).alias("need"), (F.col("used") + F.col("i") + 1).alias("used"), "list")
        long_ = settle(_long_lists(lists, long_list))
        if long_.isEmpty():
            found.append(side(lists, True, "vid_train").join(side(lists, False, "vid_eval"), "list").select("vid_train", "vid_eval"))
            break
        # at most one counter in so many as a long list has vectors
        is_long = _list_slot() == F.col("slot")
        short, hot = lists.join(F.broadcast(long_), is_long, "left_anti"), lists.join(F.broadcast(long_), is_long, "left_semi")
        found.append(side(short, True, "vid_train").join(side(short, False, "vid_eval"), "list").select("vid_train", "vid_eval"))
        # lists whose terms alone reach the least dot product can't be split any further, so there are four rounds at most
        whole = hot.filter("need <= 0")
        found.append(meet(side(whole, True, "vid_train"), side(whole, False, "vid_eval"), "list", 10_000).select("vid_train", "vid_eval"))
        todo = hot.filter("need > 0").join(ready.select("vid", "terms"), "vid")
    return reduce(DataFrame.unionByName, found).distinct()


def near_vectors(vecs: DataFrame) -> DataFrame:
    """``vid_train, vid_eval, dot``: pairs of vectors across splits that qualify, exactly verified."""
    n = F.size("boxes")
    mean = lambda c: F.coalesce(F.aggregate("boxes", F.lit(0.0), lambda s, b: s + b[c]) / F.nullif(n, F.lit(0)), F.lit(0.0))
    ready = settle(_weighed(vecs).select("vid", "in_train", "in_eval", "terms", *_halves(), "boxes", n.alias("boxes_n"), mean("x").alias("mx"), mean("y").alias("my")))
    load = ready.select("vid", "q0", "q1", "q2", "q3", "boxes")
    left = load.select(F.col("vid").alias("vid_train"), F.struct("q0", "q1", "q2", "q3").alias("a"), F.col("boxes").alias("boxes_a"))
    right = load.select(F.col("vid").alias("vid_eval"), F.struct("q0", "q1", "q2", "q3").alias("b"), F.col("boxes").alias("boxes_b"))
    close = candidates(ready).join(left, "vid_train").join(right, "vid_eval").withColumn("dot", (F.lit(CELLS) - different_cells("a", "b")) / CELLS)
    close = close.filter(F.col("dot") >= (CELLS - MOST_DIFFERENT) / CELLS).select("vid_train", "vid_eval", "dot", "boxes_a", "boxes_b")
    return settle(boxes_agree(close))


def overlap_pairs(audit: DataFrame) -> DataFrame:
    """``record_id_a < record_id_b``: every pair of a train and an evaluation record of the same or almost the same image."""
    records = settle(split_records(audit))
    vecs, members = vectors(records)
    close = near_vectors(vecs)
    at = records.select("record_id", "digest", (F.col("split") == "train").alias("is_train")).filter("digest is not null")
    # copies of one file or one vector may be many on both sides
    same = meet(at.filter("is_train").select("digest", F.col("record_id").alias("t")), at.filter("not is_train").select("digest", F.col("record_id").alias("e")), "digest").select("t", "e")
    near = meet(close, members.filter("split = 'train'").select(F.col("vid").alias("vid_train"), F.col("record_id").alias("t")), "vid_train")
    near = meet(near, members.filter("split <> 'train'").select(F.col("vid").alias("vid_eval"), F.col("record_id").alias("e")), "vid_eval").select("t", "e")
    return same.unionByName(near).distinct().select(F.least("t", "e").alias("record_id_a"), F.greatest("t", "e").alias("record_id_b"))


def overlap_report(audit: DataFrame) -> DataFrame:
    """Per evaluation split and source: records, records that train also holds, of these as the same file and as a near one.

    Counted per record by semi-joins; groups of copies are never expanded into pairs. Source null counts as a source.
    """
    records = settle(split_records(audit, with_source=True))
    vecs, members = vectors(records)
    close = near_vectors(vecs)
    exact = records.filter("split = 'train' and digest is not null").select("digest").distinct().withColumn("same_file", F.lit(True))
    near = members.join(close.select(F.col("vid_eval").alias("vid")).distinct(), "vid").filter("split <> 'train'").select("record_id", F.lit(True).alias("near"))
    held = records.filter("split <> 'train'").select("record_id", "digest", "split", source_name(F.col("source")).alias("source"))
    marked = held.join(exact, "digest", "left").join(near, "record_id", "left")
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return marked.groupBy("split", "source").agg(F.count(F.lit(1)).alias("records"), yes(F.col("same_file") | F.coalesce("near", F.lit(False))).alias("overlapping"), yes(F.col("same_file")).alias("same_file"), yes(F.col("near")).alias("near"))
