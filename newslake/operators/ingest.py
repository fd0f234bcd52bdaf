"""The ingest job: union of raw articles, tech filter, cleaning, the duplicate verdict against store and batch, totals.

Duplicates are decided as a fold over the rows decides them (URL, then content, then title, against the rows that are
stored before): rows of the store come before those of the batch. Content is compared as clean text on both sides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.functions import text, urls
from newslake.operators.checkpoints import reliable
from newslake.operators.dedupe import keyed, new_rows, verdicts
from newslake.operators.serving import with_new_categories

#: Of sources that hold tech articles only.
ALL_TECH = ("github-trending",)


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of all sources; columns that a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def tech_only(raw: DataFrame, extra_high=()) -> DataFrame:
    """Rows that the tech filter lets through; sources of ALL_TECH pass unread."""
    name = F.concat_ws(" ", "source_id", "source_name")
    tech = text.is_tech(text.tech_score(F.col("title"), F.col("summary"), F.col("content"), name, extra_high))
    return raw.where(F.coalesce(F.col("source_id").isin(*ALL_TECH), F.lit(False)) | F.coalesce(tech, F.lit(False)))


def clean_rows(raw: DataFrame, as_of: Column) -> DataFrame:
    """raw (raw_id, title, url, content, summary, source_name, source_id, published_at, author, image_url, categories) as
    articles without id: clean text, summary, tags, category, read time, date and image."""
    title, none = text.clean_title(F.col("title")), F.expr("cast(array() as array<string>)")
    content = text.remove_boilerplate(text.strip_html(F.coalesce("content", F.lit(""))))
    categories = F.coalesce("categories", none)
    tags = text.extract_tags(categories, F.coalesce("title", F.lit("")), F.col("source_id"))
    out = raw.select(
        F.col("raw_id").alias("article_id"), title.alias("title"), content.alias("content"), F.col("summary").alias("_summary"), F.col("url").alias("source_url"), "source_name", "source_id",
        urls.image_url(F.col("image_url")).alias("image_url"), F.trim("author").alias("author"), text.normalize_date(F.col("published_at"), as_of).alias("published_at"), categories.alias("_categories"),
        tags.alias("tags"),
    )
    summary = text.make_summary(F.coalesce(F.when(F.col("_summary") != "", F.col("_summary")), F.col("content")))
    return out.select(
        "article_id", "title", summary.alias("summary"), "content", "source_url", "source_name", "source_id", "image_url", text.categorize(F.concat("_categories", "tags")).alias("category_slug"),
        "tags", "author", "published_at", text.content_fingerprint(F.coalesce("title", F.lit("")), F.col("content")).alias("fingerprint"), text.read_time(F.col("content")).alias("read_time"),
    )


def ingest(raw: DataFrame, store: DataFrame, as_of: Column, extra_high=()) -> DataFrame:
    """The clean rows of raw that pass the tech filter, with match_type and matched_id (of the store's, or of raw's as
    matched_raw_id). match_type is none for rows to add, error for rows without a title or URL.

    store: article_id, title, content, source_url of the stored articles of the horizon.
    """
    # read several times below, and stored in the end
    rows = reliable(clean_rows(tech_only(raw, extra_high), as_of))
    broken = (F.coalesce("title", F.lit("")) == "") | (F.coalesce("source_url", F.lit("")) == "")
    found = verdicts(keyed(rows.where(~broken)), keyed(store))
    m = F.col("matched_id")
    found = found.select("article_id", "match_type", F.when(~F.col("in_batch"), m).alias("matched_id"), F.when(F.col("in_batch"), m).alias("matched_raw_id"))
    return rows.join(found, "article_id", "left").withColumn("match_type", F.coalesce("match_type", F.lit("error")))


def added(ingested: DataFrame) -> DataFrame:
    """Articles to store, with the counters and flags that a new article has."""
    zero = F.lit(0).cast("long")
    rows = ingested.where("match_type = 'none'").drop("match_type", "matched_id", "matched_raw_id")
    return new_rows(rows, None, ("source_url", "fingerprint")).withColumns({"score": F.lit(0.0), "is_featured": F.lit(False), "view_count": zero, "bookmark_count": zero})


def categories_after(categories: DataFrame, ingested: DataFrame) -> DataFrame:
    """The category dimension with a row for each new slug of the articles to store."""
    return with_new_categories(categories, ingested.where("match_type = 'none'").select(F.col("category_slug").alias("slug")))


def totals(raw: DataFrame, ingested: DataFrame) -> DataFrame:
    """By source and overall (source_name null): fetched, added, duplicates, errors."""
    n = lambda c: F.count_if(c)
    kind = F.col("match_type")
    rows = raw.select("source_name", F.lit("fetched").alias("match_type")).union(ingested.select("source_name", "match_type"))
    return rows.rollup("source_name").agg(
        n(kind == "fetched").alias("fetched"), n(kind == "none").alias("added"), n(kind.isin("url", "content", "title")).alias("duplicates"), n(kind == "error").alias("errors"),
    )


def legacy_rows(items: DataFrame, sources: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """The older mapping of feed items (source_id, title, link, content, content_snippet, pub_date, creator, categories,
    image_url) of active sources (source_id, name, category, is_active): identity is title and host, read time has no cap.
    Items whose fingerprint the store has are left out; of equal ones in the batch the first by link stays."""
    content = F.coalesce("content", F.lit(""))
    snippet = F.coalesce(F.when(F.col("content_snippet") != "", F.col("content_snippet")), F.substring(content, 1, 500))
    small = sources.where("is_active").select("source_id", F.col("name").alias("source_name"), F.col("category").alias("category_slug"))
    rows = items.join(small, "source_id").select(
        "title", snippet.alias("summary"), content.alias("content"), F.col("link").alias("source_url"), "source_name", "image_url", "category_slug",
        F.coalesce("categories", F.expr("cast(array() as array<string>)")).alias("tags"), F.col("creator").alias("author"), F.col("pub_date").alias("published_at"),
        text.title_domain_fingerprint(F.col("title"), urls.host(F.col("link"))).alias("fingerprint"), text.read_time(F.col("content"), None).alias("read_time"),
    )
    return new_rows(rows, store, ("fingerprint",), "source_url")
