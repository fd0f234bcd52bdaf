"""Ingest dedupe of a stream over URL, content and title together, whose state is what was accepted before.

Each micro-batch is judged as a batch is (dedupe.verdicts) against the accepted rows of the batches before it, within the
horizon. Under the folder, verdicts/batch=<n> and accepted/batch=<n> hold a batch's results; a batch that is run again reads
only those before it and writes the same folders again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.operators import dedupe
from newslake.operators.checkpoints import reliable
from newslake.sources import files


def ingest_available(stream: DataFrame, path: str, checkpoint: str, as_of: Column, days: int = 7) -> None:
    """Judges what is there since the last run of the stream (article_id, title, content, source_url, published_at), in
    order of article_id within a micro-batch, and stops. Accepted rows older than the horizon shadow nothing."""
    spark = stream.sparkSession
    since = as_of - F.make_interval(days=F.lit(days))

    def judge(batch: DataFrame, number: int) -> None:
        new = reliable(batch.select("article_id", "title", "content", "source_url", "published_at"))
        keys = reliable(dedupe.keyed(new).join(new.select("article_id", "published_at"), "article_id"))
        before = [n for n in files.names(spark, f"{path}/accepted") if n.startswith("batch=") and int(n[6:]) < number]
        paths = [f"{path}/accepted/{n}" for n in before]
        seen = spark.read.schema(keys.schema).parquet(*paths).where(F.col("published_at") >= since) if paths else None
        found = reliable(dedupe.verdicts(keys, seen))
        found.write.mode("overwrite").parquet(f"{path}/verdicts/batch={number}")
        keys.join(found.where("match_type = 'none'"), "article_id", "left_semi").write.mode("overwrite").parquet(f"{path}/accepted/batch={number}")

    stream.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
