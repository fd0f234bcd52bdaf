"""Multi-signal ranking: raw signals, their normalised scores, the weighted final score, top-N and the featured flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslake.config import Ranking
from newslake.functions.text import half_up, keyword_hits, weighted_hits
from newslake.operators.checkpoints import reliable


def lookup(key: Column, values: dict[str, float], default: float) -> Column:
    """A small dictionary as a conditional: no join, no shuffle."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, float(v)).otherwise(out)
    return out


def window_scan(articles: DataFrame, as_of: Column, hours: int = 72) -> DataFrame:
    return articles.where(F.col("published_at") >= as_of - F.make_interval(hours=F.lit(hours)))


def source_score(n: Column) -> Column:
    return F.when(n <= 1, 0.2).when(n == 2, 0.5).otherwise(F.least(F.lit(1.0), 0.5 + F.log10(n.cast("double")) * 0.5))


def keyword_score(weight: Column) -> Column:
    return F.when(weight == 0, 0.1).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1 / (1 + F.exp(-0.3 * (weight - 5))))))


def recency_score(age_hours: Column, c: Ranking) -> Column:
    return F.when(age_hours > c.max_age_hours, 0.01).otherwise(F.greatest(F.lit(0.01), F.pow(F.lit(0.5), age_hours / c.half_life_hours)))


def engagement_score(hn: Column, views: Column, bookmarks: Column) -> Column:
    part = lambda x, most, k: F.least(F.lit(most), F.log10(x + F.lit(1.0)) * k)
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), part(hn, 0.6, 0.2) + part(views, 0.25, 0.1) + part(bookmarks, 0.15, 0.1)))


def authority_score(a: Column) -> Column:
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), a / 100))


def signals(articles: DataFrame, as_of: Column, config: Ranking = Ranking()) -> DataFrame:
    """articles with raw_* columns, raw_keywords the matched ones in the dictionary's order. Optional input columns: tags, hn_score, related_count."""
    have = set(articles.columns)
    tags = F.array_join("tags", " ") if "tags" in have else F.lit(None)
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.substring(F.coalesce("content", F.lit("")), 1, 2000), tags))
    age = (F.unix_timestamp(as_of) - F.unix_timestamp("published_at")) / 3600
    return articles.withColumns({
        "raw_source_count": F.coalesce("related_count", F.lit(1)) if "related_count" in have else F.lit(1),
        "raw_hn_score": F.coalesce("hn_score", F.lit(0)) if "hn_score" in have else F.lit(0),
        "raw_age_hours": age,
        "raw_keyword_weight": weighted_hits(text, config.keywords),
        "raw_keywords": keyword_hits(text, config.keywords),
        "raw_authority": lookup(F.col("source_name"), config.authorities, 50.0),
        "raw_boost": lookup(F.col("category_slug"), config.boosts, 1.0),
    })


def rank_scores(articles: DataFrame, as_of: Column, config: Ranking = Ranking()) -> DataFrame:
    """signals plus norm_*, comp_* and final_score."""
    df = signals(articles, as_of, config).withColumns({
        "norm_source": source_score(F.col("raw_source_count")),
        "norm_keyword": keyword_score(F.col("raw_keyword_weight")),
        "norm_recency": recency_score(F.col("raw_age_hours"), config),
        "norm_engagement": engagement_score(F.col("raw_hn_score"), F.coalesce("view_count", F.lit(0)), F.coalesce("bookmark_count", F.lit(0))),
        "norm_authority": authority_score(F.col("raw_authority")),
    })
    names = ("source", "keyword", "recency", "engagement", "authority")
    df = df.withColumns({f"comp_{n}": F.col(f"norm_{n}") * getattr(config, n) for n in names})
    total = F.col("comp_source") + F.col("comp_keyword") + F.col("comp_recency") + F.col("comp_engagement") + F.col("comp_authority")
    return df.withColumn("final_score", half_up(total * F.col("raw_boost"), 4))


def top_ranked(scored: DataFrame, n: int = 10) -> DataFrame:
    """The n best with their rank; the limit comes first, so that the window sees n rows."""
    best = scored.orderBy(F.desc("final_score"), "article_id").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("final_score"), "article_id")))


def legacy_score(articles: DataFrame, as_of: Column, config: Ranking = Ranking()) -> DataFrame:
    """The older single score: the title plays no part; times 100."""
    scored = rank_scores(articles.withColumn("title", F.lit("")), as_of, config)
    return scored.select("article_id", half_up(F.col("final_score") * 100).alias("score"))


def cluster_sizes(articles: DataFrame) -> DataFrame:
    """articles with related_count: members of their cluster, 1 without one. Aggregated first, so no cluster is one task."""
    n = articles.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n"))
    return articles.join(n, "cluster_id", "left").withColumn("related_count", F.coalesce("n", F.lit(1))).drop("n")


def featured(articles: DataFrame, top_id, as_of: Column, exclusive: bool = False) -> DataFrame:
    """is_featured cleared for the last 24 hours (or everywhere), set for top_id."""
    recent = F.lit(True) if exclusive else F.col("published_at") >= as_of - F.expr("INTERVAL 24 HOURS")
    flag = F.col("article_id") == top_id
    return articles.withColumn("is_featured", F.when(recent, flag).otherwise(F.coalesce("is_featured", F.lit(False)) | flag))


def ranking_job(articles: DataFrame, as_of: Column, config: Ranking = Ranking()) -> DataFrame:
    """Scored articles of the window, with the score column to store."""
    df = window_scan(articles, as_of, int(config.max_age_hours))
    df = cluster_sizes(df) if "cluster_id" in df.columns else df
    return rank_scores(df, as_of, config).withColumn("score", half_up(F.col("final_score") * 100))


def ranking_run(articles: DataFrame, as_of: Column, config: Ranking = Ranking(), top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(changes to store: article_id, score, is_featured of the rows where either differs; the day's feed: article_id,
    final_score, rank). Without an article in the window nothing changes."""
    scored = reliable(ranking_job(articles, as_of, config).select("article_id", "final_score", F.col("score").cast("double").alias("_score")))
    feed = reliable(top_ranked(scored, top).select("article_id", "final_score", F.col("rank").cast("long").alias("rank")))
    first = F.broadcast(feed.where("rank = 1").select(F.col("article_id").alias("_top")))
    rows = articles.select("article_id", "published_at", "score", F.coalesce("is_featured", F.lit(False)).alias("is_featured"))
    now = featured(rows.join(first), F.col("_top"), as_of).select("article_id", F.col("is_featured").alias("_flag"))
    new = rows.join(now, "article_id").join(scored, "article_id", "left").withColumn("_new", F.coalesce("_score", "score"))
    differs = ~F.col("_new").eqNullSafe(F.col("score")) | (F.col("_flag") != F.col("is_featured"))
    return new.where(differs).select("article_id", F.col("_new").alias("score"), F.col("_flag").alias("is_featured")), feed
