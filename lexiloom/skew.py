"""Joins of rows with aggregates of their own groups, where a group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT_ROWS = 20_000


def attach(rows: DataFrame, groups: DataFrame, on: list[str], spread_by: str, n: str = "n", salt_rows: int = SALT_ROWS) -> DataFrame:
    """`rows` joined with `groups` (one row for each value of `on`, with the number `n` of its rows).

    Groups of more than a thousandth of all rows, and of `salt_rows`, are a thousand at most: these alone are broadcast, to
    spread their rows over salts by `spread_by`. The column `n` isn't passed on. Nulls in `on` never match.
    """
    most = max(salt_rows, (groups.agg(F.sum(n)).first()[0] or 0) // 1000)
    salts = F.greatest(F.ceil(F.col(n) / most).cast("int"), F.lit(1))
    hot = F.broadcast(groups.where(F.col(n) > most).select(*on, salts.alias("salts")))
    salted = rows.join(hot, on, "left").withColumn("salt", F.pmod(F.xxhash64(spread_by), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    every = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop(n)
    return salted.join(every, [*on, "salt"]).drop("salt")
