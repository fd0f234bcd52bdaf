"""Run logs, quotas, retention and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stage_metrics(log: DataFrame) -> DataFrame:
    ok = F.col("success")
    return log.groupBy("stage").agg(F.count("*").alias("runs"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), F.avg("duration").alias("avg_duration"))


def stage_overall(log: DataFrame) -> DataFrame:
    """stage_metrics with a row for all stages (stage null). A run whose failure was thrown counts, but not in the mean."""
    ok = F.col("success")
    mean = F.avg(F.when(~F.col("thrown"), F.col("duration")))
    return log.rollup("stage").agg(F.count("*").alias("runs"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), F.coalesce(mean, F.lit(0.0)).alias("avg_duration"))


def run_summary(log: DataFrame) -> DataFrame:
    """By run: stages, successes, failures, items of the successful stages (0 without an items column) and status."""
    ok = F.col("success")
    items = F.sum(F.when(ok, F.col("items"))) if "items" in log.columns else F.lit(0)
    counts = log.groupBy("run_id").agg(F.count("*").alias("stages"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.coalesce(items, F.lit(0)).cast("long").alias("items"))
    status = F.when(F.col("succeeded") == F.col("stages"), "completed").when(F.col("succeeded") == 0, "failed").otherwise("partial")
    return counts.withColumn("status", status)


def run_history(log: DataFrame, limit: int = 20, most: int = 100) -> DataFrame:
    """The newest runs."""
    last = log.groupBy("run_id").agg(F.max("started_at").alias("started_at"))
    return last.orderBy(F.desc("started_at"), F.desc("run_id")).limit(min(limit, most))


def last_days(df: DataFrame, as_of: Column, days: int, column: str) -> DataFrame:
    return df.where(F.col(column) >= as_of - F.make_interval(days=F.lit(days)))


def failure_streak(log: DataFrame) -> DataFrame:
    """Failures by stage since its last success; healthy below three. Two aggregations, no window."""
    last_ok = log.where("success").groupBy("stage").agg(F.max("event_id").alias("last_ok"))
    after = log.join(last_ok, "stage", "left").where("last_ok is null or event_id > last_ok")
    n = after.groupBy("stage").agg(F.count("*").alias("streak"))
    out = log.select("stage").distinct().join(n, "stage", "left").withColumn("streak", F.coalesce("streak", F.lit(0)))
    return out.withColumn("healthy", F.col("streak") < 3)


def running_mean(log: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """log with mean_duration: the mean of its stage's durations up to each event.

    The log is cut into ranges of about `rows` events by event_id; a range's sums come first, so a stage is no single task.
    """
    bounds = log.agg(F.min("event_id").alias("low"), F.max("event_id").alias("high"), F.count("*").alias("n")).first()
    span = max(1, -(-((bounds["high"] or 0) - (bounds["low"] or 0) + 1) // max(1, -(-bounds["n"] // rows))))
    part = F.floor((F.col("event_id") - (bounds["low"] or 0)) / span)
    log = log.withColumn("_part", part)
    before = Window.partitionBy("stage").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = log.groupBy("stage", "_part").agg(F.sum("duration").alias("_s"), F.count("duration").alias("_n"))
    sums = sums.select("stage", "_part", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    w = Window.partitionBy("stage", "_part").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    mean = (F.col("_s0") + F.coalesce(F.sum("duration").over(w), F.lit(0.0))) / F.nullif(F.col("_n0") + F.count("duration").over(w), F.lit(0))
    return log.join(sums, ["stage", "_part"]).withColumn("mean_duration", mean).drop("_part", "_s0", "_n0")


def quota(requests: DataFrame, most: int, width: str = "15 minutes") -> DataFrame:
    n = requests.groupBy("user_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"))
    return n.select("user_id", F.col("w.start").alias("window_start"), "n", (F.col("n") > most).alias("blocked"))


def trailing_rate(requests: DataFrame, seconds: int = 60, span: int = 86_400) -> DataFrame:
    """requests with rate: the user's requests of the last `seconds`, itself included. Time is cut into spans, and rows
    near a span's end are also read by the next, so a busy user is no single task."""
    span = max(span, seconds + 1)
    at = F.unix_timestamp("ts")
    both = F.array_distinct(F.array(F.floor(at / span), F.floor((at + seconds) / span)))
    rows = requests.withColumn("_at", at).withColumn("_span", F.explode(both))
    w = Window.partitionBy("user_id", "_span").orderBy("_at").rangeBetween(-seconds, 0)
    return rows.withColumn("rate", F.count("*").over(w)).where(F.col("_span") == F.floor(F.col("_at") / span)).drop("_at", "_span")


def daily(requests: DataFrame) -> DataFrame:
    return requests.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def retained(df: DataFrame, cutoff: Column, column: str = "published_at") -> DataFrame:
    return df.where(F.col(column) >= cutoff)


def ai_usage(rows: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """rows (tokens): how many, their tokens, and the cost at the mean of both prices per thousand."""
    tokens = F.coalesce(F.sum("tokens"), F.lit(0))
    return rows.agg(F.count("*").alias("articles"), tokens.alias("tokens"), (tokens * ((price_in + price_out) / 2) / 1000).alias("cost"))


def ingest_totals(rows: DataFrame) -> DataFrame:
    """Fetched, new and duplicate rows by source and overall (source null)."""
    return rows.rollup("source_name").agg(F.count("*").alias("fetched"), F.count_if(F.col("match_type") == "none").alias("added"), F.count_if(F.col("match_type") != "none").alias("duplicates"))
