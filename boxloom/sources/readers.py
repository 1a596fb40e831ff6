"""Readers: image listings, label text, annotation formats, logs. A missing place gives an empty table of the schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxloom.functions.names import label_path_of, tidy_path
from boxloom.operators.ids import running_ids

#: Suffixes of image files.
IMAGE_SUFFIXES = ["bmp", "dng", "heic", "jpeg", "jpg", "mpo", "pfm", "png", "tif", "tiff", "webp"]

EPOCH_LOG = "run_id string, epoch int, elapsed_s double, train_box_loss double, train_cls_loss double, train_dfl_loss double, metric_precision double, metric_recall double, metric_map50 double, metric_map50_95 double, val_box_loss double, val_cls_loss double, val_dfl_loss double"

EPOCH_LOG_FIELDS = [f.split()[0] for f in EPOCH_LOG.split(", ")]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def list_prefix(rows: DataFrame, order: str, share: float) -> DataFrame:
    """The first ``share`` of the rows in sorted order, at least one row; a prefix, not a sample."""
    if share >= 1:
        return rows.orderBy(order)
    most = max(1, round(rows.count() * share))
    # numbered range by range, as a limit would gather the prefix in one place
    return running_ids(rows, [order], "_k").filter(F.col("_k") <= most).drop("_k")


def list_images(spark: SparkSession, path: str, share: float = 1.0) -> DataFrame:
    """``path, length, modified`` of image files below a folder, sorted, or the first ``share`` of them."""
    if not exists(spark, path):
        return spark.createDataFrame([], "path string, length bigint, modified timestamp")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    images = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]*)\z", 1)).isin(IMAGE_SUFFIXES))
    return list_prefix(images.select("path", "length", F.col("modificationTime").alias("modified")), "path", share)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``path, body`` of label text files below a folder, whole files."""
    if not exists(spark, path):
        return spark.createDataFrame([], "path string, body string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("body"))


def with_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images beside the text of their label file, null where there is none."""
    return images.withColumn("label", label_path_of(F.col("path"))).join(labels.select(tidy_path(F.col("path")).alias("label"), "body"), "label", "left")


def read_log(spark: SparkSession, path: str, schema: str = EPOCH_LOG, first: int | None = None) -> DataFrame:
    """An epoch log in CSV with a header and a stated schema; with ``first`` the first rows by epoch."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    log = spark.read.schema(schema).option("header", True).csv(path)
    return log if first is None else log.orderBy("run_id", "epoch").limit(first)


def read_any_log(spark: SparkSession, path: str) -> DataFrame:
    """A CSV log whose types are inferred from all rows."""
    return spark.read.option("header", True).option("inferSchema", True).option("samplingRatio", 1.0).csv(path)


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of a detection annotation file in JSON."""
    box = "struct<id:bigint,image_id:string,category_id:int,bbox:array<double>,iscrowd:int,area:double,tokens_positive:array<array<int>>>"
    schema = f"images array<struct<id:string,height:int,width:int,file_name:string,caption:string>>, annotations array<{box}>"
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    return whole.select(F.explode("images").alias("i")).select("i.*"), whole.select(F.explode("annotations").alias("a")).select("a.*")


def coco_to_labels(images: DataFrame, annotations: DataFrame, class_map: dict[int, int] | None = None) -> DataFrame:
    """``file_name, cls, x, y, w, h`` in shares: no crowds, no boxes without area, repeated boxes of an image once (the first by id)."""
    a = annotations.filter("coalesce(iscrowd, 0) = 0 and size(bbox) = 4 and bbox[2] > 0 and bbox[3] > 0")
    cls = F.col("category_id") - 1 if class_map is None else F.element_at(F.create_map(*[F.lit(v) for kv in class_map.items() for v in kv]), F.col("category_id"))
    once = a.groupBy("image_id", "category_id", "bbox").agg(F.min("id").alias("id"))
    both = once.join(images.select(F.col("id").alias("image_id"), "height", "width", "file_name"), "image_id")
    b = lambda i: F.get("bbox", F.lit(i))
    return both.select("file_name", "id", cls.alias("cls"), ((b(0) + b(2) / 2) / F.col("width")).alias("x"), ((b(1) + b(3) / 2) / F.col("height")).alias("y"), (b(2) / F.col("width")).alias("w"), (b(3) / F.col("height")).alias("h"))


def grounded_phrases(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """``file_name, phrase, cls, bbox``: captions cut by the token spans; ``cls`` numbers the phrases of an image in order of appearance."""
    a = annotations.filter("coalesce(iscrowd, 0) = 0 and size(bbox) = 4 and bbox[2] > 0 and bbox[3] > 0")
    both = a.withColumnRenamed("id", "ann").join(images.select(F.col("id").alias("image_id"), "file_name", "caption"), "image_id")
    spans = F.transform("tokens_positive", lambda t: F.substring("caption", F.get(t, F.lit(0)) + 1, F.get(t, F.lit(1)) - F.get(t, F.lit(0))))
    told = both.withColumn("phrase", F.lower(F.trim(F.array_join(spans, " ")))).filter("phrase <> ''")
    first = told.groupBy("file_name", "phrase").agg(F.min("ann").alias("first"))
    numbered = first.withColumn("cls", F.row_number().over(Window.partitionBy("file_name").orderBy("first")) - 1)
    return told.join(numbered.drop("first"), ["file_name", "phrase"]).select("file_name", "phrase", "cls", "bbox").distinct()


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    """``filename, width, height, name, x1, y1, x2, y2`` of annotation files in XML, one row per object."""
    obj = "struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>"
    schema = f"filename string, size struct<width:int,height:int>, object array<{obj}>"
    files = spark.read.format("xml").schema(schema).option("rowTag", "annotation").load(path)
    each = files.select("filename", "size.width", "size.height", F.explode("object").alias("o"))
    return each.select("filename", "width", "height", "o.name", *[F.col(f"o.bndbox.{a}").alias(b) for a, b in (("xmin", "x1"), ("ymin", "y1"), ("xmax", "x2"), ("ymax", "y2"))])


def repaired_voc(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid boxes, rejected ones): a far edge one pixel outside is moved onto the border, other faults reject a box."""
    fixed = objects.withColumn("x2", F.when(F.col("x2") == F.col("width") + 1, F.col("width").cast("double")).otherwise(F.col("x2"))).withColumn("y2", F.when(F.col("y2") == F.col("height") + 1, F.col("height").cast("double")).otherwise(F.col("y2")))
    fault = F.expr("coalesce(not (x1 >= 0 and y1 >= 0 and x2 > x1 and y2 > y1 and x2 <= width and y2 <= height), true)")
    return fixed.filter(~fault), fixed.filter(fault)


def read_rotated(spark: SparkSession, path: str) -> DataFrame:
    """``path, corners, name`` of label files with eight coordinates and a class name per line."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.split(F.trim("value"), r"\s+").alias("p")).filter("size(p) >= 9")
    return lines.select("path", F.transform(F.slice("p", 1, 8), lambda v: v.try_cast("double")).alias("corners"), F.element_at("p", 9).alias("name")).filter("not exists(corners, v -> v is null)")


def image_header(content: Column) -> Column:
    """``ok, kind`` of an image file from its bytes: known magic, and for JPEG the end marker."""
    kind = F.when(F.substring(content, 1, 3) == F.unhex(F.lit("FFD8FF")), "jpeg").when(F.substring(content, 1, 8) == F.unhex(F.lit("89504E470D0A1A0A")), "png").when(F.substring(content, 1, 2) == F.unhex(F.lit("424D")), "bmp")
    whole = F.when(kind == "jpeg", F.substring(content, -2, 2) == F.unhex(F.lit("FFD9"))).otherwise(kind.isNotNull())
    return F.struct(F.coalesce(whole, F.lit(False)).alias("ok"), kind.alias("kind"))


def turned_size(width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    """Width and height after the camera's orientation: 6 and 8 change sides."""
    turned = F.coalesce(orientation.isin(6, 8), F.lit(False))
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def frame_stream(spark: SparkSession, path: str, schema: str, stride: int = 1, files_per_trigger: int = 1) -> DataFrame:
    """A stream of frame rows (``frame_no`` among the columns) from growing files, every ``stride``-th frame, read at a bounded pace."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.filter(F.col("frame_no") % stride == 0)


def source_kind(source: object) -> str:
    """What a source is: ``stream``, ``folder``, ``list``, ``frame`` or ``rows``."""
    if isinstance(source, DataFrame):
        return "stream" if source.isStreaming else "rows"
    if isinstance(source, (list, tuple)):
        return "list"
    text = str(source).lower()
    if text.startswith(("rtsp://", "rtmp://", "tcp://")) or text.endswith(".streams"):
        return "stream"
    return "frame" if text.rsplit(".", 1)[-1] in IMAGE_SUFFIXES else "folder"
