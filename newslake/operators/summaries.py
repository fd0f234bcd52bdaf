"""Extractive summaries: which articles need one, the rows to store, and the run's counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake import config
from newslake.functions import text


def needs_summary(articles: DataFrame, limit: int | None = 50) -> DataFrame:
    """Articles with content and without a summary of the model's (ai_summary struct<summary, ...>), the newest first."""
    rows = articles.where("ai_summary is null or coalesce(ai_summary.summary, '') = ''").where("content <> ''")
    return rows.orderBy(F.desc("published_at"), "article_id").limit(limit) if limit else rows


def backfill(articles: DataFrame, as_of: Column) -> DataFrame:
    """(article_id, valid, reason, ai_summary, summary) of articles that need a summary: what is stored for the valid ones."""
    check, content = text.summarizable(F.col("content")), F.coalesce("content", F.lit(""))
    summary = text.extractive_summary(content)
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(content, r"\s+", " "), r"\[.*?\]", ""), r"https?://\S+", ""))
    ai = F.struct(text.summary_title(F.col("title")).alias("title"), summary.alias("summary"), text.why_it_matters(clean).alias("why_it_matters"), as_of.alias("generated_at"), F.lit(0).cast("long").alias("tokens_used"))
    return articles.select("article_id", check["valid"].alias("valid"), check["reason"].alias("reason"), F.when(check["valid"], ai).alias("ai_summary"), F.when(check["valid"], summary).alias("summary"))


def stored(articles: DataFrame, new: DataFrame) -> DataFrame:
    """articles with the ai_summary and summary of new where it is valid; to be written as the next snapshot."""
    have = articles.select("article_id", F.col("ai_summary.title").alias("t"), F.col("ai_summary.summary").alias("s"), F.col("ai_summary.why_it_matters").alias("w"), F.col("ai_summary").isNotNull().alias("had"))
    done = new.where("valid").select("article_id", F.col("ai_summary").alias("_ai"), F.col("summary").alias("_summary"))
    out = articles.join(have, "article_id").join(done, "article_id", "left")
    ai = F.when(F.col("_ai").isNotNull(), F.struct(F.col("_ai.title").alias("title"), F.col("_ai.summary").alias("summary"), F.col("_ai.why_it_matters").alias("why_it_matters")))
    ai = ai.when(F.col("had"), F.struct(F.col("t").alias("title"), F.col("s").alias("summary"), F.col("w").alias("why_it_matters")))
    return out.withColumns({"ai_summary": ai, "summary": F.coalesce("_summary", "summary")}).drop("t", "s", "w", "had", "_ai", "_summary")


def backfill_counts(new: DataFrame) -> DataFrame:
    return new.agg(F.count("*").alias("total"), F.count_if("valid").alias("successful"), F.count_if(~F.col("valid")).alias("skipped"))


def model_costs(usage: DataFrame) -> DataFrame:
    """usage (model, input_tokens, output_tokens) -> (model, calls, input_tokens, output_tokens, cost); unknown models cost null."""
    rows = [(m, a, b) for m, (a, b) in config.MODEL_PRICES.items()]
    prices = F.broadcast(usage.sparkSession.createDataFrame(rows, "model string, price_in double, price_out double"))
    sums = usage.groupBy("model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return sums.join(prices, "model", "left").select("model", "calls", "input_tokens", "output_tokens", (F.col("input_tokens") * F.col("price_in") + F.col("output_tokens") * F.col("price_out")).alias("cost"))


def prompt_inputs(articles: DataFrame, most: int = 8000) -> DataFrame:
    """(article_id, prompt, tokens): the input of a summarising model, cut at `most` characters."""
    prompt = text.prompt_text(F.coalesce("content", F.lit("")), most)
    return articles.select("article_id", prompt.alias("prompt")).withColumn("tokens", text.token_estimate(F.col("prompt")))
