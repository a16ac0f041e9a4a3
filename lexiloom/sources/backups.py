"""Backups of catalogs: snapshots as tables with a manifest row, listed newest first, old ones pruned."""

from __future__ import annotations

import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, created timestamp, command string, n_locales long, n_keys long"
KEPT = 5


def create(catalog: DataFrame, folder: str, command: str = "", now: datetime.datetime | None = None) -> str | None:
    """Writes a snapshot and then its manifest; the snapshot's name. An empty catalog isn't backed up."""
    spark = catalog.sparkSession
    sizes = catalog.agg(F.countDistinct("locale").alias("l"), F.count("*").alias("k")).first()
    if not sizes.k:
        return None
    now = now or datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
    name = now.strftime("%Y%m%dT%H%M%S%f")
    catalog.select("locale", "key", "value", "ord").write.parquet(f"{folder}/snapshots/{name}")
    # Only a snapshot that was written to its end gets a manifest, so that broken ones are never listed.
    spark.createDataFrame([(name, now, command, sizes.l, sizes.k)], MANIFEST).write.json(f"{folder}/manifests/{name}")
    return name


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """name, created, command, n_locales, n_keys of the backups, newest first; no row without any."""
    try:
        return spark.read.schema(MANIFEST).json(f"{folder}/manifests/*").where("name is not null").orderBy(F.desc("name"))
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)


def restored(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame:
    """The catalog of a backup, by default of the newest one."""
    if name is None:
        newest = listed(spark, folder).first()
        if newest is None:
            raise ValueError("no backup to restore")
        name = newest.name
    return spark.read.parquet(f"{folder}/snapshots/{name}")


def prune(spark: SparkSession, folder: str, keep: int = KEPT) -> list[str]:
    """Deletes all but the `keep` newest backups; the names of those deleted. Manifests go first."""
    old = [r.name for r in listed(spark, folder).select("name").collect()[keep:]]
    for name in old:
        for part in ("manifests", "snapshots"):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}/{name}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return old
