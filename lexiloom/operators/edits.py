"""Text edits as intervals: conflicts between them, dropping nested ones, applying and rolling back.

Edits: file, id, start, end (half-open), replacement. Overlaps are found by binning: an interval is listed in every bin it
touches, pairs meet in the first bin they share, so that a file with very many edits is spread over its bins and no file is
compared as a whole. Bins of a fixed width keep the number of pairs tested near the number of pairs reported.

Empty and reversed ranges (end <= start) take part with their start's bin only. Rows with nulls are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BIN = 64
# Characters of a file whose edits are ordered together.
BLOCK = 4096


def _binned(edits: DataFrame, bin_width: int, suffix: str) -> DataFrame:
    lo = F.floor(F.col("start") / bin_width).cast("long")
    hi = F.greatest(lo, F.floor((F.col("end") - 1) / bin_width).cast("long"))
    named = [F.col(c).alias(c + suffix) for c in ("id", "start", "end")]
    return edits.where("start is not null and end is not null").select("file", *named, lo.alias("lo" + suffix), F.explode(F.sequence(lo, hi)).alias("bin"))


def _pairs(edits: DataFrame, bin_width: int) -> DataFrame:
    a, b = _binned(edits, bin_width, "_a"), _binned(edits, bin_width, "_b")
    meet = F.col("bin") == F.greatest("lo_a", "lo_b")
    return a.join(b, ["file", "bin"]).where(meet & (F.col("id_a") < F.col("id_b")))


def _inside(inner: str, outer: str) -> Column:
    return (F.col(f"start_{inner}") >= F.col(f"start_{outer}")) & (F.col(f"end_{inner}") <= F.col(f"end_{outer}"))


def conflicts(edits: DataFrame, bin_width: int = BIN) -> DataFrame:
    """file, id_a, id_b, kind (duplicate, containment, overlap) of each unordered pair that conflicts."""
    same = (F.col("start_a") == F.col("start_b")) & (F.col("end_a") == F.col("end_b"))
    overlap = (F.col("start_a") < F.col("end_b")) & (F.col("start_b") < F.col("end_a"))
    kind = F.when(same, "duplicate").when(_inside("a", "b") | _inside("b", "a"), "containment").when(overlap, "overlap")
    return _pairs(edits, bin_width).withColumn("kind", kind).where("kind is not null").select("file", "id_a", "id_b", "kind")


def planned(edits: DataFrame, block: int = BLOCK) -> DataFrame:
    """The edits that aren't strictly contained in another one of their file; equal ranges are kept.

    In order of start, and of the longer one among equal starts, a range is contained just where a range before it ends no
    earlier. The greatest end so far is a running maximum inside blocks of a file, to which the greatest end of the blocks
    before is carried; so no pairs are made, and a file of very many edits is spread over its blocks.
    """
    ranges = edits.where("start is not null and end is not null").select("file", "start", "end").distinct().withColumn("block", F.floor(F.col("start") / block).cast("long"))
    before = Window.unboundedPreceding, -1
    tops = ranges.groupBy("file", "block").agg(F.max("end").alias("top"))
    carried = tops.select("file", "block", F.max("top").over(Window.partitionBy("file").orderBy("block").rowsBetween(*before)).alias("carried"))
    own = F.max("end").over(Window.partitionBy("file", "block").orderBy("start", F.desc("end")).rowsBetween(*before))
    inner = ranges.withColumn("own", own).join(carried, ["file", "block"]).where(F.greatest("own", "carried") >= F.col("end"))
    return edits.join(inner.select("file", "start", "end"), ["file", "start", "end"], "left_anti").select(*edits.columns)


def rollback_offsets(edits: DataFrame, block: int = BLOCK) -> DataFrame:
    """file, id, offset: how far each edit's start has moved once all edits before it are applied.

    A running sum inside blocks of a file, to which the sums of the blocks before are added.
    """
    delta = F.length("replacement") - (F.col("end") - F.col("start"))
    rows = edits.select("file", "id", "start", delta.alias("delta"), F.floor(F.col("start") / block).cast("long").alias("block"))
    before = Window.unboundedPreceding, -1
    sums = rows.groupBy("file", "block").agg(F.sum("delta").alias("total"))
    carried = sums.select("file", "block", F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("block").rowsBetween(*before)), F.lit(0)).alias("carried"))
    own = F.coalesce(F.sum("delta").over(Window.partitionBy("file", "block").orderBy("start", "id").rowsBetween(*before)), F.lit(0))
    return rows.withColumn("own", own).join(carried, ["file", "block"]).select("file", "id", (F.col("own") + F.col("carried")).cast("long").alias("offset"))


def applied(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """file, text with its edits spliced in from the end; edits must not overlap. A file's edits are bounded by its text."""
    per = edits.groupBy("file").agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "replacement")), asc=False).alias("es"))
    splice = lambda t, e: F.concat(t.substr(F.lit(1), e["start"].cast("int")), e["replacement"], t.substr((e["end"] + 1).cast("int"), F.length(t)))
    return texts.join(per, "file", "left").select("file", F.when(F.col("es").isNull(), F.col("text")).otherwise(F.aggregate("es", F.col("text"), splice)).alias("text"))
