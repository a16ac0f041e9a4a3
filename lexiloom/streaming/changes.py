"""Incremental work: fingerprints of files, debounced change events, the circuit breaker, in batch and streaming form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.session import broadcast_if_small
from lexiloom.storage import materialize

GAP = "10 minutes"
FAILURES = 3


def incremental(listing: DataFrame, cached: DataFrame, header_matches: bool = True) -> DataFrame:
    """file_path, action: reuse, parse (new or changed fingerprint) or drop, by joining the listing with the cached state.

    Both have file_path and fingerprint. A header that doesn't match makes every listed file be parsed.
    """
    old = cached.select("file_path", F.col("fingerprint").alias("old"))
    joined = listing.select("file_path", F.col("fingerprint").alias("new")).join(old, "file_path", "full_outer")
    action = F.when(F.col("new").isNull(), "drop").when(F.lit(header_matches) & (F.col("old") == F.col("new")), "reuse").otherwise("parse")
    return joined.select("file_path", action.alias("action"))


def file_fingerprints(refs: DataFrame) -> DataFrame:
    """file_path, fingerprint of the references of each file: order-free sums, so a popular file is pre-aggregated."""
    row = F.conv(F.substring(F.md5(F.concat_ws("|", "key", "line", "col_no")), 1, 10), 16, 10).cast("long")
    return refs.groupBy("file_path").agg(F.concat_ws(":", F.count("*").cast("string"), F.sum(F.pmod(row, F.lit(1 << 40))).cast("string")).alias("fingerprint"))


def debounced(events: DataFrame, gap: str = GAP) -> DataFrame:
    """trigger, started, ended, n_events: changes of one trigger that follow each other within the gap fire once.

    The same expression works on a stream with a watermark; session windows merge partial sessions before the shuffle.
    """
    grouped = events.groupBy("trigger", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"))
    return grouped.select("trigger", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events")


def debounced_stream(events: DataFrame, gap: str = GAP, late: str = "1 day") -> DataFrame:
    """Streaming form of `debounced` in append mode: a session fires once its gap and the watermark have passed."""
    return debounced(events.withWatermark("ts", late), gap)


def breaker(outcomes: DataFrame, failures: int = FAILURES) -> DataFrame:
    """stream, n_openings: how often a stream's breaker opens, i.e. how many runs of failures reach the limit.

    Outcomes: stream, ts, ord, failed. Gaps and islands over each stream; a stream is one worker's log.
    """
    w = Window.partitionBy("stream").orderBy("ts", "ord")
    islands = outcomes.withColumn("island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w))
    runs = islands.where("failed").groupBy("stream", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("stream").agg(F.count_if(F.col("n") >= failures).alias("n_openings"))


def breaker_stream(outcomes: DataFrame, failures: int = FAILURES) -> DataFrame:
    """Streaming form: stream, open, n_failures after each micro-batch, with the count of failures kept as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (count,) = state.get if state.exists else (0,)
        for pdf in batches:
            for failed in pdf.sort_values(["ts", "ord"])["failed"]:
                count = count + 1 if failed else 0
        state.update((count,))
        yield pd.DataFrame({"stream": [key[0]], "open": [count >= failures], "n_failures": [count]})

    return outcomes.groupBy("stream").applyInPandasWithState(step, "stream string, open boolean, n_failures long", "count long", "update", "NoTimeout")


def text_fingerprints(texts: DataFrame) -> DataFrame:
    """file_path, fingerprint of the texts of each file: order-free sums over digests, so a large file is pre-aggregated."""
    row = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("cand_id").cast("string"), "text")), 1, 10), 16, 10).cast("long")
    return texts.groupBy("file_path").agg(F.concat_ws(":", F.count("*").cast("string"), F.sum(row).cast("string")).alias("fingerprint"))


def refreshed(texts: DataFrame, cached_rows: DataFrame, cached_prints: DataFrame, extract: Callable[[DataFrame], DataFrame], header_matches: bool = True) -> DataFrame:
    """What `extract` finds in `texts` (file_path and more), computed for new and changed files only.

    Rows of files that haven't changed come from the cache, rows of files that are gone are dropped. Both sides are chosen
    by semi-joins with the list of files; texts of unchanged files are read for their fingerprint alone.
    """
    actions = materialize(incremental(text_fingerprints(texts), cached_prints, header_matches).where("file_path is not null"), "actions")
    listed = broadcast_if_small(actions)
    of = lambda action: listed.where(F.col("action") == action).select("file_path")
    fresh = extract(texts.join(of("parse"), "file_path", "left_semi"))
    return cached_rows.join(of("reuse"), "file_path", "left_semi").select(*fresh.columns).unionByName(fresh)
