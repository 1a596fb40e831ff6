"""Descriptions of datasets: where the splits lie and what the classes are called. Nothing in a description is run."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")
_ENTRY = re.compile(r"^(\s*)(?:-\s+(.*)|([^\s:#][^:]*):(?:\s+(.*))?|([^\s:#][^:]*):)$")


@dataclass(frozen=True)
class Description:
    """Folders (or lists of folders) per split, and the class names by number."""

    splits: dict[str, list[str]]
    names: dict[int, str]


def _scalar(text: str | None) -> object:
    """A value of one line: a quoted or bare text, a whole number, or a list in brackets; null where there is none."""
    text = re.sub(r"\s+#.*$", "", (text or "").strip()).strip()
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(part) for part in text[1:-1].split(",") if part.strip()]
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    return None if text in ("", "~", "null") else int(text) if re.fullmatch(r"-?\d+", text) else text


def parse(text: str) -> dict[str, object]:
    """The entries of a description: one ``key: value`` per line, lists in brackets or as dashes, and one level of keys below a key."""
    out: dict[str, object] = {}
    top = None
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        found = _ENTRY.match(line.rstrip())
        if not found:
            raise ValueError(f"can't read the line {line!r}")
        indent, item, key, value = found[1], found[2], found[3] or found[5], found[4]
        if item is not None and top is not None:
            out[top] = [*(out[top] or []), _scalar(item)]
        elif indent and top is not None:
            out[top] = {**(out[top] or {}), _scalar(key): _scalar(value)}
        else:
            top = key.strip()
            out[top] = _scalar(value)
    return out


def described(entries: dict[str, object], home: str) -> Description:
    """A checked description; relative folders lie below ``path``, which itself may be relative to ``home``.

    Train and val must be there (``validation`` counts as val), names or their number too, and both must agree; without
    names classes are called ``class_0`` and so on.
    """
    given = dict(entries)
    if not given.get("val") and given.get("validation"):
        given["val"] = given.pop("validation")
    missing = [s for s in ("train", "val") if not given.get(s)]
    if missing:
        raise ValueError(f"the description lacks {' and '.join(missing)}")
    names, count = given.get("names"), given.get("nc")
    if names is None and count is None:
        raise ValueError("the description has neither names nor their number")
    told = dict(enumerate(names)) if isinstance(names, list) else {int(k): v for k, v in names.items()} if names else {i: f"class_{i}" for i in range(int(count))}
    if count is not None and len(told) != int(count):
        raise ValueError(f"{len(told)} names but nc is {count}")
    if sorted(told) != list(range(len(told))):
        raise ValueError("class numbers must run from 0 without gaps")
    below = lambda base, part: part if re.match(r"^(/|[a-z][a-z0-9+.-]*://)", part) else f"{base.rstrip('/')}/{part.removeprefix('./')}"
    base = below(home, str(given.get("path") or "."))
    base = base.removesuffix("/.")
    each = lambda v: [below(base, str(x)) for x in (v if isinstance(v, list) else [v])]
    return Description({s: each(given[s]) for s in SPLITS if given.get(s)}, {k: str(v) for k, v in sorted(told.items())})


def read_description(spark: SparkSession, path: str) -> Description:
    """The description in the file at ``path``, with folders relative to the file's own."""
    text = spark.read.text(path, wholetext=True).first()
    if text is None:
        raise ValueError(f"{path} is empty")
    return described(parse(text[0]), path.rsplit("/", 1)[0])


def class_layout(images: DataFrame, path: str = "path") -> DataFrame:
    """``split, cls, images`` of a folder-per-class dataset (``.../<split>/<class>/<file>``); where val or test has no images the other one stands for it."""
    parts = F.split(F.col(path), "/")
    at = lambda k: F.try_element_at(parts, F.lit(k))
    counted = images.select(F.when(at(-3).isin("val", "valid", "validation"), "val").otherwise(at(-3)).alias("split"), at(-2).alias("cls")).filter(F.col("split").isin(*SPLITS)).groupBy("split", "cls").agg(F.count(F.lit(1)).alias("images"))
    have = counted.agg(F.collect_set("split").alias("have"))
    known = counted.join(F.broadcast(have))
    other = F.when(F.col("split") == "val", "test").when(F.col("split") == "test", "val")
    stands = known.filter(other.isNotNull() & ~F.array_contains("have", other)).withColumn("split", other)
    return known.unionByName(stands).select("split", "cls", "images")
