"""Writing tables: appending what is new, updating columns by snapshot, daily feeds, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from newslake.operators.dedupe import new_rows


def append_new(batch: DataFrame, store: DataFrame | None, path: str, keys=("source_url", "fingerprint"), id_col: str = "article_id") -> dict[str, int]:
    """Appends the rows whose keys neither the store nor a row of a smaller id in the batch has (null keys equal none), and
    returns how many were added and how many were duplicates."""
    seen = Observation()
    new_rows(batch, store, keys, id_col).observe(seen, F.count(F.lit(1)).alias("added")).write.mode("append").parquet(path)
    added = seen.get["added"]
    return {"added": added, "duplicates": batch.count() - added}


def updated(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """table with columns taken from changes where they have the key; to be written as the next snapshot. Of repeated keys
    one change counts, the least."""
    new = changes.groupBy(F.col(key)).agg(F.min(F.struct(*columns)).alias("_new"))
    out = table.join(new, key, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)))
    return out.drop("_new").select(*table.columns)


def write_daily_feed(top: DataFrame, day: Column, path: str) -> None:
    top.withColumn("feed_date", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feed_date").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def expire(table: DataFrame, cutoff: Column, column: str = "published_at") -> DataFrame:
    return table.where(F.col(column) >= cutoff)
