"""Column expressions that bring names, splits, digests and paths to one spelling."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The full-width forms of the printable ASCII characters, and the wide blank.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + " "

# Spellings that name nothing (compared after lower-casing, hyphens as underscores).
PLACEHOLDERS = ["", "_", "__", "n/a", "na", "#n/a", "none", "null", "nil", "nan", "unknown", "undefined", "?", "??", "unassigned", "tbd", "(none)", "missing"]

# Spellings of the three usable splits.
SPLIT_WORDS = {
    "train": ["train", "training"],
    "valid": ["valid", "val", "validation"],
    "test": ["test", "testing"],
}

_BLANKS = " \t\n\x0b\f\r" + "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200C), 0x202F, 0x205F, 0x3000, 0xFEFF)))
_BLANK = f"[{_BLANKS}]"
_HYPHEN = "[-" + "".join(map(chr, (*range(0x2010, 0x2016), 0x2212))) + "]"
_WIDE_CLASS = f"[{chr(0xFF01)}-{chr(0xFF5E)}{chr(0x3000)}]"


def narrow(text: Column) -> Column:
    """Full-width ASCII forms as their usual forms."""
    return F.when(text.rlike(_WIDE_CLASS), F.translate(text, _WIDE, _NARROW)).otherwise(text)


def strip_blanks(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.trim(text, F.lit(_BLANKS))


def plain_name(text: Column) -> Column:
    """Lower case, narrow, no blanks at the ends or beside a colon, underscores for hyphens and blanks.

    Null stays null; a placeholder becomes null.
    """
    name = F.lower(strip_blanks(narrow(text)))
    name = F.regexp_replace(name, f"{_BLANK}*:{_BLANK}*", ":")
    name = F.regexp_replace(name, f"{_HYPHEN}|{_BLANK}", "_")
    name = F.when(text.rlike(r"^[a-z0-9_:]+\z"), text).otherwise(name)
    return F.when(~name.isin(PLACEHOLDERS), name)


def source_name(text: Column) -> Column:
    """``plain_name`` without what image formats and the export tool append.

    Appended are, in any number and order: ``_jpg`` ``_jpeg`` ``_png``, a file suffix, ``.rf.`` and hex digits.
    """
    name = plain_name(text)
    name = F.regexp_replace(name, r"(?:\.rf\.[0-9a-f]+|[._](?:jpe?g|png))+$", "")
    return F.when(~name.isin(PLACEHOLDERS), name)


def usable_split(text: Column) -> Column:
    """``train``, ``valid`` or ``test`` where the text names one of them, else null."""
    word = F.regexp_replace(F.lower(strip_blanks(narrow(text))), r"[/\\]+$", "")
    out = F.lit(None).cast("string")
    for split, words in SPLIT_WORDS.items():
        out = F.when(word.isin(words), F.lit(split)).otherwise(out)
    return out


def digest_hex(text: Column) -> Column:
    """A SHA-256 digest in lower-case hex from any notation; 16 to 63 digits if it was cut short, else null.

    Known notations: hex in either case, with ``0x``, ``sha256:``, ``SHA-256 =`` before it, with colons,
    hyphens or blanks between bytes, and base64 (usual or URL alphabet, padded or not).
    """
    bare = F.regexp_replace(strip_blanks(narrow(text)), r"^(?i:sha-?_?256)\s*[:=-]?\s*", "")
    hexed = F.regexp_replace(F.regexp_replace(F.lower(bare), r"^0x", ""), r"[:\-\s]", "")
    base = F.regexp_replace(F.translate(bare, "-_", "+/"), "=+$", "")
    decoded = F.lower(F.hex(F.unbase64(F.concat(base, F.lit("=")))))
    return (
        # the usual form needs no mending
        F.when(text.rlike(r"^[0-9a-f]{64}\z"), text)
        .when(hexed.rlike(r"^[0-9a-f]{16,64}\z"), hexed)
        .when(base.rlike(r"^[A-Za-z0-9+/]{43}\z"), decoded)
    )


_MARK = "[\u0300-\u036f]"


@lru_cache(maxsize=1)
def _compositions() -> tuple[str, str, str]:
    """(JSON of letter with mark -> composed letter, signs that have another usual form, these forms), from the Unicode tables."""
    marks = [chr(c) for c in range(0x300, 0x370)]
    letters = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xA8, 0x250), *range(0x386, 0x530), *range(0x1E00, 0x2000))]
    pairs = {a + m: whole for a in letters for m in marks if len(whole := unicodedata.normalize("NFC", a + m)) == 1}
    single = {chr(c): one for c in (*range(0x340, 0x390), *range(0x1F00, 0x2130), *range(0xF900, 0xFB00)) if len(one := unicodedata.normalize("NFC", chr(c))) == 1 and one != chr(c)}
    return json.dumps(pairs), "".join(single), "".join(single.values())


def composed(text: Column) -> Column:
    """Letters followed by combining marks as single letters, as in the composed normal form; other text stays as it is.

    Marks are taken up one by one from left to right. Only texts that hold a combining mark or a sign with another
    usual form are walked through.
    """
    pairs, other, usual = _compositions()
    table = F.from_json(F.lit(pairs), "map<string,string>")
    last = lambda kept: F.when(F.size(kept) > 0, F.element_at(kept, -1))

    def take(kept: Column, c: Column) -> Column:
        whole = F.when(c.rlike(_MARK), F.try_element_at(table, F.concat(last(kept), c)))
        return let(whole, lambda w: F.when(w.isNotNull(), F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(w))).otherwise(F.concat(kept, F.array(c))))

    walked = lambda t: F.array_join(F.aggregate(F.split(t, ""), F.array().cast("array<string>"), take), "")
    plain = F.when(text.rlike(f"[{other}]"), F.translate(text, other, usual)).otherwise(text)
    return let(plain, lambda t: F.when(t.rlike(_MARK), walked(t)).otherwise(t))


def tidy_path(path: Column) -> Column:
    """A relative path as the place it leads to; case is kept.

    Blanks at the ends go, percent escapes are decoded, letters with combining marks are composed, backslashes become
    slashes, repeated slashes and ``.`` steps vanish, and ``..`` takes back the step before it.
    """
    # most paths are tidy already: plain signs, no blanks at the ends, no empty or dotted steps
    return F.when(path.rlike(_TIDY), path).otherwise(let(let(strip_blanks(path), _decoded), _stepped))


_TIDY = r"^(?!\.{0,2}(?:/|\z)|.*/\.{0,2}(?:/|\z))[!-$&-\[\]-~](?:[ -$&-\[\]-~]*[!-$&-\[\]-~])?\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _decoded(text: Column) -> Column:
    # url_decode reads '+' as a blank and fails on a stray '%', so both are protected first
    guarded = F.regexp_replace(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    plain = F.when(F.instr(text, "%") > 0, F.coalesce(F.try_url_decode(guarded), text)).otherwise(text)
    return let(F.translate(plain, "\\", "/"), lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), composed(t)).otherwise(t))


def _stepped(text: Column) -> Column:
    steps = F.filter(F.split(text, "/"), lambda p: (p != "") & (p != "."))
    done = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda kept, p: F.when((p == "..") & (F.size(kept) > 0) & (F.element_at(kept, -1) != ".."), F.slice(kept, 1, F.size(kept) - 1)).otherwise(F.concat(kept, F.array(p))),
    )
    return F.array_join(done, "/")


def label_path_of(image: Column) -> Column:
    """The label file of an image: the last ``images`` folder becomes ``labels``, the suffix ``.txt``."""
    moved = F.regexp_replace(tidy_path(image), r"^(.*/|)images/", "$1labels/")
    return F.concat(F.regexp_replace(moved, r"\.[^./]*$", ""), F.lit(".txt"))
