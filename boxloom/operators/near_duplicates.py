"""Groups of near-identical images from small thumbnails: every pair within the limits meets in a block and is verified.

A thumbnail is 64 cells of four bits, written as 64 hex digits; anything else takes no part. In unary code (is the cell
at least 1, 2 .. 15?) it has 960 bits, and the gaps of two thumbnails add up to the number of bits in which they
differ. The bits are dealt over one block more than the greatest sum of gaps, so a pair within the limits has at least
one block in which no bit differs: blocking loses nothing. Thumbnails that share a block are compared in full, all
with all; copies of one thumbnail count as one and hang on their first image. Limits are tighter across sources than within one,
and numbered frames of one video are never tied for their looks alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.names import let
from boxloom.operators.audit import component_edges, components
from boxloom.operators.ranking import lookup, meet
from boxloom.runtime import settle

CELLS, LEVELS = 64, 15
#: Rows per block are estimated in so many counters, whatever the number of blocks.
SKETCH = 1 << 16
#: Rows of a block that one task compares with as many others.
PORTION = 1000
_ONES = 0x0101010101010101


def _long(bits: int) -> Column:
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("bigint")


def _and(c: Column | str, bits: int) -> Column:
    return (F.col(c) if isinstance(c, str) else c).bitwiseAND(_long(bits))


def _or(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def distinct_thumbs(images: DataFrame, key: str, thumb: str) -> tuple[DataFrame, DataFrame]:
    """(``vid, first, q0..q3``: each thumbnail once as four numbers, with its least image; edges ``a, b`` from that image to its copies)."""
    rows = images.filter(F.col(thumb).rlike(r"^[0-9A-Fa-f]{64}\z")).select(F.col(key).alias("b"), F.unhex(F.col(thumb)).alias("t"))
    once = settle(rows.groupBy("t").agg(F.min("b").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("vid", F.monotonically_increasing_id()))
    copies = lookup(rows, once.filter("n > 1").select("t", F.col("first").alias("a")), "t", "inner").filter("a <> b").select("a", "b")
    return once.select("vid", "first", *[F.conv(F.hex(F.substring("t", 8 * i + 1, 8)), 16, -10).cast("bigint").alias(f"q{i}") for i in range(4)]), copies


def _words(vecs: DataFrame) -> DataFrame:
    """``vid, first`` with ``w1..w15``, whose bits tell which cells reach that level, and ``sums``: eight sums of eight cells, a byte each."""
    low = 0x0F * _ONES
    halves = vecs.select("*", *[_and(f"q{i}", low).alias(f"e{i}") for i in range(4)], *[_and(F.shiftrightunsigned(f"q{i}", 4), low).alias(f"o{i}") for i in range(4)])

    def level(t: int) -> Column:
        # adding 16 - t carries into the bit above a cell that is t or more
        up = _long((16 - t) * _ONES)
        return _or([F.shiftleft(_and(F.shiftrightunsigned(F.col(f"e{i}") + up, 4), _ONES).bitwiseOR(_and(F.col(f"o{i}") + up, 0x10 * _ONES)), i) for i in range(4)])

    def sums(i: int) -> Column:
        s = F.col(f"e{i}") + F.col(f"o{i}")
        s = _and(s, 0x00FF00FF00FF00FF) + _and(F.shiftrightunsigned(s, 8), 0x00FF00FF00FF00FF)
        return _and(s, 0x0000FFFF0000FFFF) + _and(F.shiftrightunsigned(s, 16), 0x0000FFFF0000FFFF)

    return settle(halves.select("vid", "first", *[level(t).alias(f"w{t}") for t in range(1, LEVELS + 1)], _or([F.shiftleft(sums(i), 8 * i) for i in range(4)]).alias("sums")))


def _blocks(words: DataFrame, most_sum: int) -> DataFrame:
    """``vid, sums, block``: a row for each of ``most_sum + 1`` blocks; each bit is in one block, and no block is empty."""
    n = most_sum + 1
    if n > CELLS * LEVELS:
        raise ValueError("thumbnails can't differ by as much as the limit")
    # a block takes other cells on each level, as long as there are enough of both
    place = (lambda c, t: (c + t) % n) if n < CELLS + LEVELS else (lambda c, t: (CELLS * (t - 1) + c) % n)
    masks = [[(t, sum(1 << c for c in range(CELLS) if place(c, t) == p)) for t in range(1, LEVELS + 1)] for p in range(n)]
    blocks = [F.xxhash64(F.lit(p), _or([_and(f"w{t}", m) for t, m in of if m])) for p, of in enumerate(masks)]
    return words.select("vid", "sums", F.explode(F.array(*blocks)).alias("block"))


def candidates(words: DataFrame, most_sum: int) -> DataFrame:
    """``a < b`` (``vid``): thumbnails that share a block and whose eight sums differ by at most ``most_sum`` together.

    A block with many rows is cut into portions and these meet pair by pair, so no task compares more than about
    ``PORTION`` rows with as many.
    """
    rows = _blocks(words, most_sum)
    slot = F.pmod("block", F.lit(SKETCH)).cast("int")
    loads = settle(rows.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")))
    usual = loads.agg(F.percentile_approx("n", F.lit(0.5))).first()[0] or 0
    hot = loads.filter(F.col("n") > 2 * usual + PORTION).select("slot", F.ceil((F.col("n") - usual) / PORTION).cast("int").alias("portions"))
    cut = rows.join(F.broadcast(hot), slot == F.col("slot"), "left").withColumn("portions", F.coalesce("portions", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("vid"), "portions").cast("int"))
    met = cut.select("block", "vid", "sums", "own", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("other"))
    met = met.select(F.xxhash64("block", F.least("own", "other"), F.greatest("own", "other")).alias("meeting"), "vid", "sums")
    a, b = met.alias("a"), met.alias("b")
    byte = lambda c, i: _and(F.shiftrightunsigned(c, 8 * i), 0xFF)
    apart = sum((F.abs(byte("a.sums", i) - byte("b.sums", i)) for i in range(8)), F.lit(0))
    return a.join(b, (F.col("a.meeting") == F.col("b.meeting")) & (F.col("a.vid") < F.col("b.vid")) & (apart <= most_sum)).select(F.col("a.vid").alias("a"), F.col("b.vid").alias("b")).distinct()


@dataclass
class Gaps:
    """Greatest mean and greatest 99th percentile of the gaps between cells; the second pair holds across sources."""

    mean: float = 0.5
    p99: float = 4.0
    mean_across: float = 0.1
    p99_across: float = 2.0


def verified(pairs: DataFrame, words: DataFrame, gaps: Gaps) -> DataFrame:
    """``a, b`` (``vid``) of pairs within the limits of one source, with ``tight``: within those across sources too."""
    side = lambda n: words.select(F.col("vid").alias(n), F.array(*[f"w{t}" for t in range(1, LEVELS + 1)]).alias(f"{n}_w"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.zip_with("a_w", "b_w", lambda x, y: x.bitwiseXOR(y)).alias("d"))
    mean = F.aggregate("d", F.lit(0), lambda n, x: n + F.bit_count(x)) / CELLS
    close = both.withColumn("mean_gap", mean).filter(F.col("mean_gap") <= gaps.mean)
    # the levels in which a cell differs follow one another, so a gap of t or more has two that lie t - 1 apart
    spans = F.sequence(F.lit(1), F.lit(LEVELS))
    cells = lambda t: F.aggregate(F.sequence(F.lit(0), LEVELS - t), F.lit(0).cast("bigint"), lambda n, s: n.bitwiseOR(F.get("d", s).bitwiseAND(F.get("d", s + t - 1))))
    wide = F.transform(spans, lambda t: F.bit_count(cells(t)))
    at_least = lambda w, k: F.size(F.filter(w, lambda n: n >= k))
    # the percentile lies between the second widest and the widest of 64 gaps
    share = 0.99 * (CELLS - 1) % 1
    told = close.select("a", "b", "mean_gap", let(wide, lambda w: (1 - share) * at_least(w, 2) + share * at_least(w, 1)).alias("p99_gap"))
    tight = (F.col("mean_gap") <= min(gaps.mean, gaps.mean_across)) & (F.col("p99_gap") <= min(gaps.p99, gaps.p99_across))
    return settle(told.filter(F.col("p99_gap") <= gaps.p99).select("a", "b", tight.alias("tight")))


def _allowed(near: DataFrame, rows: DataFrame) -> DataFrame:
    """The ``near`` pairs of thumbnails that may tie their images, given ``rows`` (``vid, source, numbered``).

    Images of one source are held to the wider limits. Across sources the tight limits hold, and two numbered frames are
    different observations however alike they look.
    """
    of_vid = rows.groupBy("vid").agg(F.bool_or(~F.col("numbered") | F.col("source").isNull()).alias("free"))
    known = lookup(lookup(near, of_vid.select(F.col("vid").alias("a"), F.col("free").alias("a_free")), "a", "inner"), of_vid.select(F.col("vid").alias("b"), F.col("free").alias("b_free")), "b", "inner")
    marked = settle(known.withColumn("sure", F.col("tight") & (F.col("a_free") | F.col("b_free"))))
    # all others need a source that both have; a thumbnail meets its sources portion by portion
    named = rows.filter("source is not null").select("vid", "source").distinct()
    asked = meet(marked.filter("not sure").select("a", "b"), named.select(F.col("vid").alias("a"), F.col("source").alias("s")), "a")
    shared = asked.join(named.select(F.col("vid").alias("b"), F.col("source").alias("s")), ["b", "s"], "left_semi").select("a", "b").distinct()
    return marked.filter("sure").select("a", "b").unionByName(shared)


def groups(images: DataFrame, gaps: Gaps | None = None) -> DataFrame:
    """``node, component`` of ``images`` (``key, thumb, digest, source, numbered``) tied by equal digests, equal thumbnails and verified pairs.

    Images that are tied to none are not listed. Any column but ``key`` may be null; a null digest, thumbnail or source
    ties nothing.
    """
    gaps = gaps or Gaps()
    vecs, copies = distinct_thumbs(images, "key", "thumb")
    words = _words(vecs)
    near = verified(candidates(words, int(gaps.mean * CELLS)), words, gaps)
    # sources are looked up for thumbnails in some pair only
    paired = near.select(F.explode(F.array("a", "b")).alias("vid")).distinct().join(vecs, "vid")
    named = settle(paired.select(F.lower(F.concat(*[F.lpad(F.hex(f"q{i}"), 16, "0") for i in range(4)])).alias("t"), "vid"))
    rows = settle(images.select(F.lower("thumb").alias("t"), "source", "numbered").join(named, "t").select("vid", "source", "numbered").distinct())
    tied = _allowed(near, rows)
    first = vecs.select("vid", "first")
    pairs = tied.join(first.select(F.col("vid").alias("a"), F.col("first").alias("fa")), "a").join(first.select(F.col("vid").alias("b"), F.col("first").alias("fb")), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    files = component_edges(images.select("key", "digest"), "key", ["digest"])
    # an image delivered with several thumbnails may be first in each of them
    return components(settle(copies.unionByName(pairs).unionByName(files).filter("a <> b")))
