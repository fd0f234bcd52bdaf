"""Notifications: breaking-news scores, payloads, digests, statistics, retries and cooldowns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake import config
from newslake.functions.text import keyword_hits


def breaking_scores(articles: DataFrame, as_of: Column, threshold: float = 85) -> DataFrame:
    """articles (score, view_count, bookmark_count, ...) with breaking_score, is_breaking and reasons."""
    hits = keyword_hits(F.lower("title"), config.BREAKING_KEYWORDS)
    recent = (F.unix_timestamp(as_of) - F.unix_timestamp("published_at")) / 3600 < 2
    trusted = F.lit(False)
    for s in config.BREAKING_SOURCES:
        trusted = trusted | F.contains("source_name", F.lit(s))
    why = F.lower(F.coalesce("why_it_matters", F.lit(""))) if "why_it_matters" in articles.columns else F.lit("")
    flagged = why.rlike("major|significant|breakthrough|critical")
    ten = lambda c, n: F.when(c, n).otherwise(0)
    views, marks = F.col("view_count") > 1000, F.col("bookmark_count") > 50
    score = F.coalesce("score", F.lit(0.0)) + F.size(hits) * 5 + ten(recent, 10) + ten(views, 5) + ten(marks, 5) + ten(flagged, 10) + ten(trusted, 10)
    reasons = F.array_compact(F.array(
        F.when(F.size(hits) > 0, F.concat(F.lit("Keywords: "), F.array_join(hits, ", "))), F.when(recent, "Very recent (< 2 hours)"),
        F.when(views, F.concat(F.lit("High views: "), F.col("view_count"))), F.when(marks, F.concat(F.lit("High bookmarks: "), F.col("bookmark_count"))),
        F.when(flagged, "AI flagged as important"), F.when(trusted, F.concat(F.lit("Authoritative source: "), F.col("source_name"))),
    ))
    return articles.withColumns({"breaking_score": score, "is_breaking": score >= threshold, "reasons": reasons})


def breaking_best(articles: DataFrame, as_of: Column, candidates: int = 20) -> DataFrame:
    """Of the newest candidates of the last hour, the one of the highest score; ties to the newest."""
    recent = articles.where(F.col("published_at") >= as_of - F.expr("INTERVAL 1 HOUR"))
    newest = recent.orderBy(F.desc("published_at"), F.desc("score"), "article_id").limit(candidates)
    return breaking_scores(newest, as_of).orderBy(F.desc("breaking_score"), F.desc("published_at"), "article_id").limit(1)


def shortened(body: Column) -> Column:
    return F.when(F.length(body) > 150, F.concat(F.substring(body, 1, 147), F.lit("..."))).otherwise(body)


def payload(articles: DataFrame, kind: str = "breaking_news", scheme: str = "app", as_of: Column | None = None) -> DataFrame:
    """(article_id, category_slug, type, title, body, image_url, priority, data) of each article's notification. Title and
    body are the model's summary's where it has them (ai_summary struct<title, summary, ...>), else the article's."""
    have = set(articles.columns)
    filled = lambda c: F.when(c != "", c)
    of = lambda field: F.coalesce(filled(F.col(f"ai_summary.{field}")), F.col(field)) if "ai_summary" in have else F.col(field)
    key = F.col("article_id").cast("string")
    data = {"type": F.lit(kind), "articleId": key, "category": F.col("category_slug"), "deepLink": F.concat(F.lit(f"{scheme}://article/"), key)}
    data |= {"timestamp": F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss'Z'")} if as_of is not None else {}
    return articles.select(
        "article_id", "category_slug", F.lit(kind).alias("type"), of("title").alias("title"), shortened(of("summary")).alias("body"),
        (F.col("image_url") if "image_url" in have else F.lit(None).cast("string")).alias("image_url"), F.lit("high" if kind == "breaking_news" else "normal").alias("priority"),
        F.create_map(*[x for k, v in data.items() for x in (F.lit(k), v)]).alias("data"),
    )


def channel(kind: Column) -> Column:
    out = F.lit(config.CHANNEL_DEFAULT)
    for k, v in config.CHANNELS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def digest(articles: DataFrame, as_of: Column, n: int = 10, score: str = "final_score", bounded: bool = True, scheme: str = "app") -> DataFrame:
    """One row, or none without articles: the top articles (of the last day), their ids and categories in order, and the
    digest's text. Articles with an ai_summary column count only where it is set."""
    rows = articles.where(F.col("published_at") >= as_of - F.expr("INTERVAL 24 HOURS")) if bounded else articles
    rows = rows.where("ai_summary is not null") if "ai_summary" in articles.columns else rows
    image = F.col("image_url") if "image_url" in articles.columns else F.lit(None).cast("string")
    top = rows.orderBy(F.desc(score), "article_id").limit(n).withColumn("image_url", image)
    rows = top.agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), "article_id", "title", "category_slug", "image_url"))).alias("r")).where(F.size("r") > 0)
    first = F.get("r", F.lit(0))
    text = F.concat(F.size("r").cast("string"), F.lit(" top stories today: "), first["title"], F.when(F.size("r") > 1, " and more").otherwise(""))
    return rows.select(
        F.array_join(F.transform("r", lambda x: x["article_id"].cast("string")), ",").alias("article_ids"),
        F.array_join(F.array_distinct(F.transform("r", lambda x: x["category_slug"])), ",").alias("categories"),
        F.lit("Your Daily Tech Digest").alias("title"), F.substring(text, 1, 150).alias("body"), first["image_url"].alias("image_url"), F.lit(f"{scheme}://digest").alias("deep_link"),
    )


def breaking_outbox(articles: DataFrame, as_of: Column, threshold: float = 85) -> DataFrame:
    """Payloads of the articles that are breaking news. Recipients are the same for all: recipients(users, as_of, "all")."""
    return payload(breaking_scores(articles, as_of, threshold).where("is_breaking"), "breaking_news", as_of=as_of)


def topic_outbox(articles: DataFrame, as_of: Column, least: float = 70) -> DataFrame:
    """Payloads of the articles whose score is high enough for a topic alert."""
    return payload(articles.where(F.coalesce("score", F.lit(0.0)) >= least), "topic_alert", as_of=as_of)


def older_outbox(articles: DataFrame) -> DataFrame:
    """The older breaking form: no score gate, the article's title as body."""
    return articles.select("article_id", F.lit("🚨 Breaking Tech News").alias("title"), F.col("title").alias("body"))


def addressed(outbox: DataFrame, tokens: DataFrame) -> DataFrame:
    """outbox (..., category_slug) with the number of distinct tokens of its category's audience; rows without an audience
    are left out. tokens (category, token); the pairs of article and token are not made, a category's tokens are one list."""
    n = tokens.distinct().groupBy(F.col("category").alias("category_slug")).agg(F.count("*").alias("n_tokens"))
    return outbox.join(n, "category_slug")


def recorded(outbox: DataFrame, results: DataFrame) -> DataFrame:
    """outbox (notification_id, ...) with the results' success_count, failure_count, invalid_tokens and status."""
    n = send_summary(results, "notification_id")
    none = F.expr("cast(array() as array<string>)")
    out = outbox.join(n, "notification_id", "left").withColumns({"success_count": F.coalesce("successes", F.lit(0)), "failure_count": F.coalesce("failures", F.lit(0)), "invalid_tokens": F.coalesce("invalid_tokens", none)})
    return out.drop("successes", "failures").withColumn("status", F.when(F.col("success_count") > 0, "sent").otherwise("failed"))


def retried(failed: DataFrame, results: DataFrame) -> DataFrame:
    """Failed notifications (notification_id, device_tokens, success_count, failure_count) after a retry with results
    (notification_id, token, ok, error): counts are added, invalid tokens go, and the status follows this try's successes.
    Those without a token stay failed, with a message."""
    n = send_summary(results, "notification_id")
    tokens = F.filter("device_tokens", lambda t: F.coalesce(t != "", F.lit(False)))
    none = F.expr("cast(array() as array<string>)")
    out = failed.withColumn("_t", tokens).join(n, "notification_id", "left")
    tried, good, bad = F.size("_t") > 0, F.coalesce("successes", F.lit(0)), F.coalesce("failures", F.lit(0))
    return out.select(
        "notification_id", F.when(tried & (good > 0), "sent").otherwise("failed").alias("status"), (F.col("success_count") + F.when(tried, good).otherwise(0)).alias("success_count"),
        (F.col("failure_count") + F.when(tried, bad).otherwise(0)).alias("failure_count"), F.when(tried, F.array_except("_t", F.coalesce("invalid_tokens", none))).otherwise(F.col("device_tokens")).alias("device_tokens"),
        F.when(~tried, "No valid tokens remaining").alias("error_message"), tried.alias("retried"),
    )


def sent_to_user(users: DataFrame, user_id) -> DataFrame:
    """(user_id, token) of one user; none without tokens or with notifications off."""
    return users.where((F.col("user_id") == user_id) & F.col("notifications_enabled")).select("user_id", F.explode("device_tokens").alias("token"))


def notification_stats(log: DataFrame, start: Column, end: Column) -> DataFrame:
    """By type and status, and in total (nulls), over [start, end]; the total is there even without rows."""
    rows = log.where(F.col("created_at").between(start, end))
    measures = [F.count("*").alias("n"), F.coalesce(F.sum("success_count"), F.lit(0)).alias("successes"), F.coalesce(F.sum("failure_count"), F.lit(0)).alias("failures")]
    each = rows.groupBy("type", "status").agg(*measures)
    total = rows.agg(*measures).select(F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("status"), "n", "successes", "failures")
    return each.union(total)


def retry_plan(log: DataFrame, as_of: Column, limit: int = 50) -> DataFrame:
    return log.where((F.col("status") == "failed") & (F.col("created_at") >= as_of - F.expr("INTERVAL 24 HOURS"))).orderBy("created_at", "notification_id").limit(limit)


def cooldown(candidates: DataFrame, seconds: int = 3600) -> DataFrame:
    """Of candidates (key, ts, ...), those that a greedy fold sends: none within `seconds` of the last sent of its key whose
    send succeeded. With a column ok, a send that failed (ok false or null) starts no cooldown, so the next candidate is
    free; without it every send succeeds.

    Every candidate is folded, in order of time; a task reads its keys sorted, holds only the last success, and jumps from
    it to the next free candidate by binary search. Candidates without a time are not sent.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, free = (), 0  # no key is (); free: from when on its candidates are sent
        for part in batches:
            keys, at, ok = part.column(0), part.column(1).to_numpy(), part.column(2).to_numpy(zero_copy_only=False)
            keep = np.zeros(len(at), bool)
            same = pc.fill_null(pc.equal(keys[1:], keys[:-1]), False).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(~same) + 1).tolist(), len(at)]
            for i, end in zip(edges, edges[1:], strict=False):
                key = keys[i].as_py() if i < end else held
                if key != held:
                    held, free = key, np.iinfo(np.int64).min
                while i < end and (i := i + int(np.searchsorted(at[i:end], free))) < end:
                    keep[i] = True
                    if ok[i]:
                        free = int(at[i]) + seconds * 1_000_000
                    i += 1
            yield part.filter(pa.array(keep))

    ok = F.coalesce("ok", F.lit(False)) if "ok" in candidates.columns else F.lit(True)
    rows = candidates.where("ts is not null").select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), ok.alias("ok"))
    sent = rows.repartition("key").sortWithinPartitions("key", "at", "ok").mapInArrow(fold, rows.schema)
    return sent.select("key", F.floor(F.col("at") / 1_000_000).alias("epoch"))


def send_summary(results: DataFrame, *by: str) -> DataFrame:
    """Successes, failures and distinct invalid tokens of results (token, ok, error), over all or by key."""
    bad = F.col("error").isin(*config.INVALID_TOKEN_ERRORS)
    invalid = F.array_sort(F.collect_set(F.when(bad, F.col("token")))).alias("invalid_tokens")
    return results.groupBy(*by).agg(F.count_if(F.col("ok")).alias("successes"), F.count_if(~F.col("ok")).alias("failures"), invalid)
