"""Landed files as incremental input: a run reads what is new since the last, and sets what it can't parse aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslake.sources import landing

#: A payload's text where it isn't JSON of the schema.
BAD = "_corrupt_record"


def news(spark: SparkSession, path: str, name: str, author: bool = True) -> DataFrame:
    """The stream of news payloads (one JSON object a line) of a folder, as landing.news_json reads them; a payload that
    can't be parsed is one row with BAD alone."""
    rows = spark.readStream.schema(f"{landing.NEWS}, {BAD} string").option("columnNameOfCorruptRecord", BAD).json(path)
    return landing.news_rows(rows, name, author, BAD)


def items(spark: SparkSession, path: str) -> DataFrame:
    """The stream of link-aggregator items (one JSON object a line), as landing.link_items reads them."""
    return landing.item_rows(spark.readStream.schema(landing.ITEM).json(path))


def append_new_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends the rows of files landed since the last run, each file once; rows with BAD go to path-bad."""

    def write(batch: DataFrame, number: int) -> None:
        # a folder a batch, so that a batch that is run again takes its own place
        good = batch.where(F.col(BAD).isNull()).drop(BAD) if BAD in batch.columns else batch
        good.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if BAD in batch.columns:
            batch.where(F.col(BAD).isNotNull()).select(BAD).write.mode("overwrite").parquet(f"{path}-bad/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
