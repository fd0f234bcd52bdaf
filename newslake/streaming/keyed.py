"""Keyed tables of update streams: each micro-batch adds one small delta, reads merge, compaction folds deltas in.

Under a table's folder, delta/<batch>/_bucket=<b> holds a micro-batch's rows and base/<batch>/_bucket=<b> a bucket as of a
batch; buckets are of the key's hash. manifest/<n> names the live folders of both; the greatest n counts. A delta is
written before the manifest names it, and a batch that is run again writes the same folder again, so a stop at any point
loses nothing and counts nothing twice.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslake.sources import files


class KeyedTable:
    """The latest row of each key. every: deltas after which the buckets that they touch are compacted. schema: of the
    rows, in Spark's terms; keys, buckets and schema must stay the same over a table's life."""

    def __init__(self, spark: SparkSession, path: str, schema, keys: list[str], buckets: int = 16, every: int = 8):
        self.spark, self.path, self.schema, self.keys, self.buckets, self.every = spark, path, schema, keys, buckets, every

    def manifest(self) -> dict:
        """base: the batch as of which each bucket is compacted; deltas: the buckets of each batch since."""
        numbers = [int(n) for n in files.names(self.spark, f"{self.path}/manifest") if n.isdigit()]
        return json.loads(files.read_text(self.spark, f"{self.path}/manifest/{max(numbers)}")) if numbers else {"n": -1, "last": -1, "base": {}, "deltas": {}}

    def _commit(self, state: dict) -> None:
        state["n"] += 1
        files.write_text(self.spark, f"{self.path}/manifest/{state['n']}", json.dumps(state))

    def _stored(self, folder: str, name: int, rows: DataFrame) -> list[str]:
        """Writes rows by bucket and returns the buckets' names."""
        to = f"{self.path}/{folder}/{name}"
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows.withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(to)
        return [n.removeprefix("_bucket=") for n in files.names(self.spark, to) if n.startswith("_bucket=")]

    def write(self, batch: DataFrame, number: int) -> None:
        """Adds a micro-batch, which has a key once. A batch that is no newer than the last one compacted is left out: it
        is in the table."""
        state = self.manifest()
        if number <= max([-1, *state["base"].values()]) or number < state["last"]:
            return
        touched = self._stored("delta", number, batch)
        state["deltas"][str(number)], state["last"] = touched, number
        self._commit(state)
        if len(state["deltas"]) >= self.every:
            self.compact()

    def _part(self, folders: list[tuple[str, int, list[str]]]) -> DataFrame | None:
        """Rows of folders (kind, batch, buckets), with _batch."""
        out = None
        for kind, number, buckets in folders:
            paths = [f"{self.path}/{kind}/{number}/_bucket={b}" for b in buckets]
            if paths:
                rows = self.spark.read.schema(self.schema).parquet(*paths).withColumn("_batch", F.lit(number).cast("long"))
                out = rows if out is None else out.union(rows)
        return out

    def _merged(self, state: dict, buckets: set[str] | None = None) -> DataFrame:
        """The latest row of each key, of the given buckets or of all."""
        by: dict[int, list[str]] = {}
        for b, n in state["base"].items():
            by.setdefault(n, []).append(b)
        live = [("base", n, bs) for n, bs in by.items()] + [("delta", int(n), bs) for n, bs in state["deltas"].items()]
        rows = self._part([(kind, n, [b for b in bs if buckets is None or b in buckets]) for kind, n, bs in live])
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        columns = [c for c in rows.columns if c != "_batch"]
        latest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*columns), "_batch").alias("_row"))
        return latest.select("_row.*")

    def read(self) -> DataFrame:
        return self._merged(self.manifest())

    def compact(self) -> None:
        """Writes the buckets that have deltas anew, and drops the folders that no manifest but the one before names."""
        state = self.manifest()
        touched = {b for bs in state["deltas"].values() for b in bs}
        if not touched:
            return
        before, upto = json.loads(json.dumps(state)), state["last"]
        self._stored("base", upto, self._merged(state, touched))
        state["base"] |= dict.fromkeys(touched, upto)
        state["deltas"] = {}
        self._commit(state)
        for kind, live in (("base", {str(n) for s in (before, state) for n in s["base"].values()}), ("delta", set(before["deltas"]))):
            for name in files.names(self.spark, f"{self.path}/{kind}"):
                if name not in live:
                    files.delete(self.spark, f"{self.path}/{kind}/{name}")
        for name in files.names(self.spark, f"{self.path}/manifest"):
            if not name.isdigit() or int(name) < before["n"]:
                files.delete(self.spark, f"{self.path}/manifest/{name}")


def upsert_available(stream: DataFrame, path: str, keys: list[str], checkpoint: str, buckets: int = 16, every: int = 8) -> KeyedTable:
    """Reads what is there since the last run of an update-mode stream into the table, and stops. The rows of a micro-batch
    take the place of those with their keys; what is written follows the batch, and the table's size only at compaction."""
    table = KeyedTable(stream.sparkSession, path, stream.schema, keys, buckets, every)
    query = stream.writeStream.outputMode("update").foreachBatch(table.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return table
