"""Session construction and size-checked broadcasting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS = 10_000
MAX_BROADCAST_BYTES = 64 << 20


def build_session(app: str = "lexiloom", master: str | None = None, cores: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive execution; `conf` keys use `__` for dots."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def bounded_rows(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> list | None:
    """Rows of a table that is meant to be small, or None when it exceeds `limit`.

    At most `limit + 1` rows ever reach the driver, so a caller can take another way.
    """
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row holds: its texts as they are, nested values as JSON, anything else as 16."""
    out = F.lit(0)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            size = F.octet_length(c)
        elif isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            size = F.octet_length(F.to_json(c))
        else:
            size = F.lit(16)
        out = out + F.coalesce(size, F.lit(0))
    return out


def broadcast_if_small(df: DataFrame, limit: int = MAX_BROADCAST_ROWS, most: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Marks `df` for broadcasting only if it has at most `limit` rows of `most` bytes together; otherwise returns it as it is."""
    n, size = df.limit(limit + 1).agg(F.count("*"), F.sum(row_bytes(df))).first()
    return F.broadcast(df) if n <= limit and (size or 0) <= most else df


def spread(df: DataFrame) -> DataFrame:
    """`df` over at least as many partitions as there are cores, for costly row-wise work on a scan.

    Only an input of fewer splits than cores, hence a small one, is shuffled; larger ones stay where they are read.
    `df` must be a scan with projections and filters, for which the number of splits is known without running anything.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
