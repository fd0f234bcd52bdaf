"""The article store: Parquet partitioned by day of publication, so that scans, updates and expiry touch their days only.

A row without a date lies in the partition of null days, which windows pass over and expiry deletes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslake.operators.checkpoints import reliable
from newslake.sources import files
from newslake.sources.sinks import updated

DAY = "published_day"
_NO_DAY = f"{DAY}=__HIVE_DEFAULT_PARTITION__"


def _write(rows: DataFrame, path: str, mode: str) -> None:
    # rebalancing splits a busy day over tasks and joins the small ones
    rows = rows.withColumn(DAY, F.to_date("published_at")).hint("rebalance", DAY)
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
    rows.sparkSession.catalog.refreshByPath(path)


def append(articles: DataFrame, path: str) -> None:
    _write(articles, path, "append")


def window(spark: SparkSession, path: str, as_of: Column, hours: int) -> DataFrame:
    """The articles of the last `hours`; only their days are read."""
    since = as_of - F.make_interval(hours=F.lit(hours))
    return spark.read.parquet(path).where((F.col(DAY) >= F.to_date(since)) & (F.col("published_at") >= since))


def _on(days: list) -> Column:
    known = [d for d in days if d is not None]
    hit = F.col(DAY).isin(known) if known else F.lit(False)
    return hit | F.col(DAY).isNull() if None in days else hit


def update(spark: SparkSession, path: str, changes: DataFrame, key: str, columns: list[str]) -> list:
    """Takes columns from changes (key, columns ...) where they have the key, and returns the days that were written: those
    that hold such a key. The other days keep their files.

    The new rows are checkpointed before their days are replaced, one after the other; a run that is stopped between days
    is mended by running it again. Days and dates themselves are not updated.
    """
    if {DAY, "published_at"} & set(columns):
        raise ValueError("a change of date moves a row: delete and append it")
    stored = spark.read.parquet(path)
    days = [r[0] for r in stored.select(key, DAY).join(changes.select(key).distinct(), key, "left_semi").select(DAY).distinct().collect()]
    if days:
        rows = reliable(updated(stored.where(_on(days)), changes, key, columns))
        _write(rows.drop(DAY), path, "overwrite")
    return sorted(days, key=str)


def expire(spark: SparkSession, path: str, cutoff: Column) -> int:
    """Deletes the articles before the cutoff and those without a date, and returns their number. Whole days are dropped
    as folders; only the cutoff's own day is written again."""
    at, day = spark.range(1).select(cutoff, F.to_date(cutoff)).first()
    stored = spark.read.parquet(path)
    gone = stored.where((F.col(DAY) <= F.lit(day)) & (F.col("published_at") < F.lit(at)) | F.col(DAY).isNull()).count()
    kept = reliable(stored.where((F.col(DAY) == F.lit(day)) & (F.col("published_at") >= F.lit(at))))
    if not kept.isEmpty():
        _write(kept.drop(DAY), path, "overwrite")
    for name in files.names(spark, path):
        old = name.startswith(f"{DAY}=") and (name < f"{DAY}={day}" or name == f"{DAY}={day}" and kept.isEmpty())
        if old or name == _NO_DAY:
            files.delete(spark, f"{path}/{name}")
    spark.catalog.refreshByPath(path)
    return gone
