"""Column expressions over label text: one line per box, a class and four numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_LINE = rf"\s*[^\s]+\s+{_NUMBER}\s+{_NUMBER}\s+{_NUMBER}\s+{_NUMBER}\s*"


def label_lines(text: Column) -> Column:
    """The lines of a label text that hold anything."""
    return F.filter(F.split(text, r"\r\n|\n|\r"), lambda line: F.trim(F.regexp_replace(line, r"\s", " ")) != "")


def usable_signature(text: Column) -> Column:
    """True where every line has a class and four finite numbers; the empty text is usable, null is not."""
    return F.coalesce(F.forall(label_lines(text), lambda line: line.rlike(rf"^{_LINE}\z")), F.lit(False))


def boxes_of(text: Column) -> Column:
    """The boxes of a usable label text as sorted ``array<struct<cls,x,y,w,h>>``; null if not usable."""

    def box(line: Column) -> Column:
        part = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
        number = lambda i: F.element_at(part, i).try_cast("double")
        return F.struct(F.element_at(part, 1).alias("cls"), number(2).alias("x"), number(3).alias("y"), number(4).alias("w"), number(5).alias("h"))

    return F.when(usable_signature(text), F.array_sort(F.transform(label_lines(text), box)))


def good_line_count(text: Column) -> Column:
    """How many lines have a class and four finite numbers."""
    return F.size(F.filter(label_lines(F.coalesce(text, F.lit(""))), lambda line: line.rlike(rf"^{_LINE}\z")))
