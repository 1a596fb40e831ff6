"""Writers: fixed-order CSV, label text, JSON, write-once files, versioned caches, run-length masks."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxloom.functions.text import six_digits
from boxloom.sources.readers import exists


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that a row fits into CSV."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, fields: list[str], mode: str = "errorifexists") -> None:
    """CSV with a header and the given fields in the given order."""
    flat(df.select(*fields)).write.mode(mode).option("header", True).csv(path)


def append_epochs(df: DataFrame, path: str) -> None:
    """Epoch rows appended to a log, numbers with six significant digits."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    df.select(*[six_digits(F.col(c)).alias(c) if c in numbers else F.col(c) for c in df.columns]).write.mode("append").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def label_rows(boxes: DataFrame, with_score: bool = False) -> DataFrame:
    """``image_id, body``: one label text per image from ``cls, x, y, w, h`` (and ``score``), in the order of ``box_no``."""
    cells = ["x", "y", "w", "h", *(["score"] if with_score else [])]
    line = F.concat_ws(" ", F.col("cls").cast("string"), *[six_digits(F.col(c)) for c in cells])
    packed = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("box_no", line.alias("line")))).alias("l"))
    return packed.select("image_id", F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("body"))


def write_labels(boxes: DataFrame, path: str, with_score: bool = False) -> None:
    """Label text below one folder per image."""
    label_rows(boxes, with_score).write.partitionBy("image_id").text(path)


def _put(spark: SparkSession, path: str, text: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}._part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(place):
        fs.delete(place, False)
    if not fs.rename(part, place):
        raise OSError(f"{path} could not be written")


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, hidden ones included."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_json(spark: SparkSession, path: str, value: object) -> None:
    """A JSON file that readers see whole or not at all."""
    _put(spark, path, json.dumps(value, indent=2, sort_keys=True))


def put_once(spark: SparkSession, path: str, value: object) -> None:
    """A JSON file that may be written again only with the same content."""
    text = json.dumps(value, indent=2, sort_keys=True)
    if not exists(spark, path):
        _put(spark, path, text)
    elif read_text(spark, path) != text:
        raise ValueError(f"{path} is there with other content")


def cached(spark: SparkSession, path: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table kept below ``path`` as long as ``key`` (a version or an inventory's hash) is the one it was built with."""
    note = f"{path}/_key.json"
    if not (exists(spark, note) and json.loads(read_text(spark, note)) == key):
        build().write.mode("overwrite").parquet(f"{path}/data")
        put_json(spark, note, key)
    return spark.read.parquet(f"{path}/data")


def manifest(records: DataFrame) -> DataFrame:
    """The split manifest: fixed fields, an empty text for no capture group."""
    return records.select("new_split", F.col("image").alias("new_image"), "old_split", F.col("image").alias("old_image"), "image_sha256", "source_id", F.coalesce("capture_group", F.lit("")).alias("capture_group"), "component_id", "instances", "width", "height")


def run_lengths(mask: np.ndarray) -> list[int]:
    """Run lengths of a binary mask by columns, beginning with zeros."""
    flat_ = np.asarray(mask, bool).ravel(order="F")
    cuts = np.flatnonzero(np.diff(flat_)) + 1
    runs = np.diff(np.concatenate([[0], cuts, [flat_.size]])).tolist() if flat_.size else []
    return ([0] if flat_.size and flat_[0] else []) + runs


def run_length_text(runs: list[int]) -> str:
    """Run lengths as text: each as the difference to the one before last, in groups of five bits with a go-on bit."""
    out = []
    for i, n in enumerate(runs):
        x = n - runs[i - 2] if i > 2 else n
        more = True
        while more:
            c = x & 0x1F
            x >>= 5
            more = x != -1 if c & 0x10 else x != 0
            out.append(chr((c | (0x20 if more else 0)) + 48))
    return "".join(out)


def run_lengths_of(text: str) -> list[int]:
    """The run lengths of their text form."""
    runs: list[int] = []
    at = 0
    while at < len(text):
        x, k, more = 0, 0, True
        while more:
            c = ord(text[at]) - 48
            x |= (c & 0x1F) << 5 * k
            more = bool(c & 0x20)
            at += 1
            k += 1
            if not more and c & 0x10:
                x |= -1 << 5 * k
        runs.append(x + (runs[-2] if len(runs) > 2 else 0))
    return runs
