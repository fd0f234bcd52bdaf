"""Exact and near duplicates at ingest: URL keys, content fingerprints, title buckets, and the verdict in that order, as a
fold over the rows gives it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newslake.functions import text, urls
from newslake.operators.checkpoints import reliable
from newslake.operators.similarity import bucket_pairs


def keyed(articles: DataFrame) -> DataFrame:
    return articles.select(
        "article_id", "title",
        urls.url_key(F.col("source_url")).alias("url_key"),
        text.content_fingerprint(F.col("title"), F.col("content")).alias("fingerprint"),
        text.bucket_key(F.col("title")).alias("bucket"),
        text.title_words(F.col("title")).alias("title_words"),
    )


def first_per(df: DataFrame, key: str, order: str = "article_id") -> DataFrame:
    """(key, first article): aggregated map-side, so that a hot key is no hot task."""
    return df.groupBy(key).agg(F.min(order).alias("first_id"))


def matches_on(df: DataFrame, key: str) -> DataFrame:
    """(article_id, first_id) of the rows that are not the first with their key."""
    return df.join(first_per(df, key), key).where("article_id > first_id").select("article_id", "first_id")


def store_duplicates(batch: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Batch rows whose key the store has."""
    return batch.join(store.select(key).distinct(), key, "left_semi")


def with_stored_flag(batch: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """batch with is_stored: whether the store has its key."""
    keys = store.select(F.col(key).alias("_key")).where("_key is not null").distinct().withColumn("_hit", F.lit(True))
    return batch.join(keys, F.col(key) == F.col("_key"), "left").withColumn("is_stored", F.coalesce("_hit", F.lit(False))).drop("_key", "_hit")


def new_rows(batch: DataFrame, store: DataFrame | None, keys=("url_key", "fingerprint"), id_col: str = "article_id") -> DataFrame:
    """Batch rows with no key of the store's, of each key the row of the smallest id; key after key. Null keys equal none."""
    columns = batch.columns
    for key in keys:
        batch = batch.join(store.select(key).distinct(), key, "left_anti") if store is not None else batch
        firsts = batch.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(id_col).alias("_first"))
        batch = batch.join(firsts, F.col(key) == F.col("_key"), "left").where(F.col(key).isNull() | (F.col(id_col) == F.col("_first"))).select(*columns)
    return batch


def title_sets(df: DataFrame) -> DataFrame:
    """df's rows that have title words, with w: those words in order."""
    return df.where("size(title_words) > 0").withColumn("w", F.array_sort("title_words"))


def set_pairs(sets: DataFrame, least: float = 0.85) -> DataFrame:
    """(a, b, similarity) of different word sets (id, bucket, w) of one bucket at or above the threshold, a < b."""
    sets = reliable(sets.select("id", "bucket", "w"))  # read on both sides
    a, b = (sets.select("bucket", F.col("id").alias(side), F.col("w").alias(f"t{side}")) for side in ("a", "b"))
    return bucket_pairs(a, b, least).where("a < b").withColumnRenamed("jaccard", "similarity")


def title_pairs(df: DataFrame, least: float = 0.85) -> DataFrame:
    """(a, b, similarity) of titles in one bucket at or above the threshold, a < b; at the level of distinct word sets,
    so that a title that many articles share is one row and is not paired with itself."""
    return set_pairs(title_sets(df).groupBy("bucket", "w").agg(F.min("article_id").alias("id")), least)


def _keys(df: DataFrame) -> DataFrame:
    """(id, u, f, t): a row's id, URL key, fingerprint and the key of its title's bucket and word set (null without words)."""
    w = F.array_sort("title_words")
    t = F.md5(F.concat_ws("\u0001", "bucket", F.array_join(w, "\u0001")))
    return df.select(F.col("article_id").alias("id"), F.col("url_key").alias("u"), F.col("fingerprint").alias("f"), F.when(F.size(w) > 0, t).alias("t"), "bucket", w.alias("w"))


def _without(rows: DataFrame, held: DataFrame, near: DataFrame) -> DataFrame:
    """rows that share no key with held and whose title is near none of its titles."""
    taken = held.select("t").union(near.join(held.select(F.col("t").alias("s")), "s", "left_semi").select("t"))
    for key, seen in (("u", held), ("f", held), ("t", taken)):
        rows = rows.join(seen.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return rows


def first_stored(rows: DataFrame, near: DataFrame, save: Callable[[DataFrame], DataFrame] = reliable) -> DataFrame:
    """Of rows (id, u, f, t; saved) those that a fold in order of id stores: a row is stored if no row stored before it has its
    URL key u, its fingerprint f, its title t, or a title s near it (near: t, s, both ways). Null keys equal none.

    That is the first independent set of the rows' conflicts. In each round every row that is the least of all its keys
    is stored, and the open rows in conflict with those go; a hot key takes a row a task, and no pair of rows is made.
    Rounds follow the longest chain of rows each of which depends on the one before; they are few on real ids.
    """
    open_ = rows.select("id", "u", "f", "t")
    done: list[DataFrame] = []
    while not open_.isEmpty():
        least = {k: open_.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("id").alias("id")) for k in ("u", "f", "t")}
        around = near.join(least["t"].withColumnRenamed("t", "s"), "s").groupBy("t").agg(F.min("id").alias("other"))
        title = least["t"].join(around, "t", "left").where("other is null or id < other")
        votes = least["u"].select("id").union(least["f"].select("id")).union(title.select("id")).groupBy("id").agg(F.count("*").alias("votes"))
        free = sum((F.col(k).isNull().cast("int") for k in ("u", "f", "t")), F.lit(0))
        voted = save(open_.join(votes, "id", "left").withColumn("first", F.coalesce("votes", F.lit(0)) + free == 3).select("id", "u", "f", "t", "first"))
        done.append(voted.where("first").drop("first"))
        open_ = save(_without(voted.where("not first").drop("first"), done[-1], near).select("id", "u", "f", "t"))
    return reduce(DataFrame.union, done) if done else open_


def verdicts(batch: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """(article_id, match_type, matched_id, in_batch) of the keyed rows of batch, judged in order of article_id against the
    store and the batch's own rows that are stored before them: url, then content, then title, else none. A rejected row
    shadows nothing. matched_id is the least match, the store's before the batch's (in_batch says which)."""
    rows = reliable(_keys(batch))
    held = reliable(_keys(store)) if store is not None else rows.where("false")
    sets = rows.union(held).where("t is not null").groupBy("t").agg(F.first("bucket").alias("bucket"), F.first("w").alias("w"))
    pairs = reliable(set_pairs(sets.withColumnRenamed("t", "id")).select("a", "b"))
    near = pairs.selectExpr("a t", "b s").union(pairs.selectExpr("b t", "a s"))
    kept = first_stored(reliable(_without(rows, held, near)) if store is not None else rows, near)
    seen = held.select(F.struct(F.lit(0).alias("part"), "id").alias("m"), "u", "f", "t").union(kept.select(F.struct(F.lit(1), "id"), "u", "f", "t"))
    least = {k: seen.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("m").alias(f"m{k}")) for k in ("u", "f", "t")}
    reach = least["t"].union(near.join(least["t"].withColumnRenamed("t", "s"), "s").select("t", "mt"))
    least["t"] = reach.groupBy("t").agg(F.min("mt").alias("mt"))
    out = rows
    for k, m in least.items():
        out = out.join(m, k, "left")
    own = F.struct(F.lit(1).alias("part"), "id")
    match = [F.when(F.col(f"m{k}") < own, F.col(f"m{k}")) for k in ("u", "f", "t")]
    kind = F.when(match[0].isNotNull(), "url").when(match[1].isNotNull(), "content").when(match[2].isNotNull(), "title").otherwise("none")
    out = out.select(F.col("id").alias("article_id"), kind.alias("match_type"), F.coalesce(*match).alias("m"))
    return out.select("article_id", "match_type", F.col("m.id").alias("matched_id"), (F.col("m.part") == 1).alias("in_batch"))


def in_list_order(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row of each key over ordered lists."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")
