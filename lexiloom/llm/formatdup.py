"""Problem 6: records that are the same but for formatting, collapsed by a range-partitioned external sort.

Each record gets a canonical key (JVM expressions only). The canonical records are range-partitioned by a digest of the key
and the id, sorted inside their partitions by digest and key (Spark's external sort, which spills), and one scan over each
sorted partition compares neighbouring full keys. As the id is part of the range key, a group that holds a third of all rows is spread over
several partitions; the runs at partition borders are stitched with one summary per partition, whose number is known
and bounded, so no group is ever gathered in one task.

Canonical form: letter case, white space and punctuation are dropped; a text made of two or more `label: value` parts
has its parts sorted, each value staying with its label. In keys every separator is dropped. Symbols other than
punctuation, raised figures, accents and digits are kept. A text without letters, digits or symbols is compared by its
own characters without white space.

Defined results
* rows with a null in a compared field belong to no group: they aren't in `copies`, and `representatives` leaves them out.
* rows equal throughout are copies. Empty texts compare as equal when the other fields do.
* the representative is the row with the smallest id; ties can't occur since ids are unique.
* an empty table gives empty results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.storage import materialize

SEPARATORS = r"[;|/•,]"
DROPPED = r"(?U)[\p{P}\p{Z}\p{Cc}\s|`´^¨=<>~]++"


def _folded(c: Column) -> Column:
    # The one letter whose capital form is two letters in ordinary typing.
    return F.replace(F.lower(F.upper(c)), F.lit("ß"), F.lit("ss"))


def canonical_key(c: Column) -> Column:
    bare = F.regexp_replace(_folded(c), DROPPED, "")
    return F.when(bare == "", F.regexp_replace(c, r"(?U)\s++", "")).otherwise(bare)


def _sorted_parts(parts: Column) -> Column:
    """The canonical form of `label: value` parts, or null when the parts aren't all such."""
    full = F.filter(parts, lambda x: x.rlike(r"(?U)\w"))
    labelled = F.forall(full, lambda x: x.rlike(r"(?U)^[^:：]*\w[^:：]*[:：]"))
    bare = lambda x: F.regexp_replace(x, DROPPED, "")
    one = lambda x: F.concat(bare(F.regexp_extract(x, r"^([^:：]*)[:：]", 1)), F.lit("\x1f"), bare(F.regexp_replace(x, r"^[^:：]*[:：]", "")))
    return F.when((F.size(full) > 1) & labelled, F.array_join(F.array_sort(F.transform(full, one)), "\x1e"))


def canonical_text(c: Column) -> Column:
    folded = _folded(c)
    by_sign, by_line = F.split(folded, SEPARATORS), F.split(folded, r"[\r\n]+")
    labels = F.size(F.regexp_extract_all(folded, F.lit(r"[:：]"), F.lit(0)))
    return F.when(labels > 1, F.coalesce(_sorted_parts(by_sign), _sorted_parts(by_line), canonical_key(c))).otherwise(canonical_key(c))


def canonical_records(rows: DataFrame, tab: str, id_col: str, *, exact: list[str], keys: list[str], texts: list[str]) -> DataFrame:
    """tab_name, id, canon (all compared fields in one string) of the rows without nulls in these fields."""
    fields = [*exact, *keys, *texts]
    canon = F.concat_ws("\x1d", *[F.col(c) for c in exact], *[canonical_key(F.col(c)) for c in keys], *[canonical_text(F.col(c)) for c in texts])
    return rows.select(id_col, *fields).dropna(subset=fields).select(F.lit(tab).alias("tab_name"), F.col(id_col).cast("long").alias("id"), canon.alias("canon"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours in one sorted partition.

    One row per record: its id, the head of its run, and whether the run is the partition's first (it may go on from
    the partition before). One more row holds the partition's first and last key for the stitching.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = ["tab_name", "id", "head", "part", "leading", "first_key", "last_key"]
    last, first, head, leading = None, None, None, True
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        tab, ids, canon = b.column("tab_name"), b.column("id"), b.column("canon")
        full = pc.binary_join_element_wise(tab, canon, pa.scalar("\x1c", tab.type))
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(full.slice(1), full.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = last is None or full[0].as_py() != last
        if first is None:
            first = full[0].as_py()
        at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        numbers = ids.to_numpy()
        heads = np.where(at >= 0, numbers[np.maximum(at, 0)], head if head is not None else 0)
        # Only the run that opens the partition is leading.
        opening = np.cumsum(new) == (1 if head is None else 0)
        leads = opening if leading else np.zeros(n, bool)
        head, leading, last = int(heads[-1]), bool(leads[-1]), full[n - 1].as_py()
        yield pa.RecordBatch.from_arrays([tab, ids, pa.array(heads), pa.array(np.full(n, part, np.int32)), pa.array(leads), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=names)
    if first is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([head], pa.int64()), pa.array([part], pa.int32()), pa.array([leading], pa.bool_()), pa.array([first], pa.string()), pa.array([last], pa.string())],
            names=names,
        )


RUNS = "tab_name string, id long, head long, part int, leading boolean, first_key string, last_key string"


def members(records: DataFrame) -> DataFrame:
    """tab_name, id, head: each canonical record with the smallest id of its group."""
    # Records are made canonical once; what the driver sees of them are sampled bounds of a fixed size.
    keyed = materialize(records.withColumn("digest", F.unhex(F.md5(F.concat_ws("\x1c", "tab_name", "canon")))), "format-records")
    ranged = keyed.repartitionByRange("digest", "id").sortWithinPartitions("digest", "tab_name", "canon", "id").select("tab_name", "id", "canon")
    runs = materialize(ranged.mapInArrow(_scan, RUNS), "format-runs")
    borders = runs.where("tab_name is null").select("part", "head", "leading", F.sha2("first_key", 256).alias("first_key"), F.sha2("last_key", 256).alias("last_key"))
    # One row per partition of the sort: bounded by the number of shuffle partitions, whatever the data.
    carried, held, held_key = [], None, None
    for b in sorted(borders.collect(), key=lambda r: r.part):
        goes_on = held_key is not None and b.first_key == held_key
        if goes_on:
            carried.append((b.part, held))
        held = held if goes_on and b.leading else b.head
        held_key = b.last_key
    rows = runs.where("tab_name is not null")
    if not carried:
        return rows.select("tab_name", "id", "head")
    carry = records.sparkSession.createDataFrame(carried, "part int, from_before long")
    return rows.join(F.broadcast(carry), "part", "left").select("tab_name", "id", F.when(F.col("leading"), F.coalesce("from_before", "head")).otherwise(F.col("head")).alias("head"))


def copies(records: DataFrame) -> DataFrame:
    """tab_name, id_a, id_b: one row per redundant copy, id_a being the smallest id of its group."""
    return members(records).where("id <> head").select("tab_name", F.col("head").alias("id_a"), F.col("id").alias("id_b"))


def representatives(records: DataFrame) -> DataFrame:
    """tab_name, id, n_copies: one row per group with the exact number of its records."""
    return members(records).groupBy("tab_name", F.col("head").alias("id")).agg(F.count("*").alias("n_copies"))


def csv_records(rows: DataFrame) -> DataFrame:
    return canonical_records(rows, "csv_rows", "row_id", exact=["target_locale"], keys=["key"], texts=["source_value"])


def candidate_records(rows: DataFrame) -> DataFrame:
    return canonical_records(rows, "scan_candidates", "cand_id", exact=[], keys=["suggested_key"], texts=["text"])
