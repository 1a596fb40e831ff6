"""Exact vector search by normalised inner product over an index that is built once and kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors per block; a task multiplies one block of queries with one block of the index.
BLOCK = 4_000


def packed(vectors: DataFrame, key: str, vector: str, rows_per_block: int = BLOCK) -> DataFrame:
    """``block, ids, rows``: vectors of unit length in blocks of about ``rows_per_block``, as one row each. Null vectors are left out.

    A zero vector stays zero, so it scores 0 with everything.
    """
    named = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null and id is not null")
    blocks = max(1, -(-named.count() // rows_per_block))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = named.withColumn("_l", length).select("id", F.transform("v", lambda x: F.coalesce(F.try_divide(x, F.col("_l")), F.lit(0.0))).alias("v"))
    held = unit.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("r"))
    return held.select("block", F.col("r.id").alias("ids"), F.col("r.v").alias("rows"))


def kept_index(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The index kept at ``path``; where there is none yet it is built, written and read back."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def nearest(queries: DataFrame, index: DataFrame, key: str, vector: str, k: int, least: float) -> DataFrame:
    """``query_id, <key>, score``: per query the ``k`` best rows of ``index``, and of these those at ``least`` or more.

    ``index`` is a table of vectors or one that ``packed`` made. Every block of queries meets every block of the index
    in one join on pairs of blocks; each meeting gives ``k`` rows per query, and the best of all are ranked afterwards.
    The limit comes before the score threshold. Scores are inner products of unit vectors in double precision. Equal
    scores go by the smaller key.
    """
    stored = index if {"block", "ids", "rows"} <= set(index.columns) else packed(index, key, vector)
    asked = packed(queries, key, vector).select(F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))
    # the numbers of blocks: one small table, as a list in every query block
    places = stored.agg(F.collect_set("block").alias("places"))
    met = asked.join(F.broadcast(places)).withColumn("block", F.explode("places")).drop("places").join(stored, "block")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q_ids, q_rows, ids, rows in zip(batch["q_ids"], batch["q_rows"], batch["ids"], batch["rows"]):
                s = np.stack(list(q_rows)) @ np.stack(list(rows)).T
                keys = np.asarray(ids)
                order = np.lexsort((np.broadcast_to(keys, s.shape), -s), axis=1)[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(np.asarray(q_ids), order.shape[1]), key: keys[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})

    out = met.select("q_ids", "q_rows", "ids", "rows").mapInPandas(score, f"query_id bigint, {key} bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return out.withColumn("r", F.row_number().over(w)).filter((F.col("r") <= k) & (F.col("score") >= least)).drop("r")
