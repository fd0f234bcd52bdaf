"""Registered queries of the reading services: feeds, details, search, bookmarks, history, categories, notifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from newslake import config
from newslake.operators import engagement, feeds, runs, serving
from newslake.plans.queries import _K, NOW, RULES, SCORED_SQL, day, query, quoted, rounded, sql_day, sql_rounded
from newslake.views import ARTICLE_SQL, FULL_SQL, USERS_SQL, articles, as_of, bare_articles, full_articles, key_number, table, users

joined = lambda c: F.array_join(c, ",")


def categories(spark, sf_dir):
    """The seeds, and a row for each new language slug of the documents."""
    return serving.with_new_categories(serving.seed_categories(spark), table(spark, sf_dir, "documents").select(F.col("lang").alias("slug")))


def _case(key: str, values: dict[str, str], default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in values.items()) + f" ELSE {quoted(default)} END"


_SEEDS = ", ".join(f"({quoted(a)}, {quoted(b)}, {quoted(c)}, {quoted(d)}, {quoted(e)}, {f}, TRUE)" for a, b, c, d, e, f in config.CATEGORY_SEEDS)
_NAME = "upper(substring(slug, 1, 1)) || substring(slug, 2)"
CATEGORY_SQL = f""", seed(slug, name, description, icon, color, sort_order, is_active) AS (VALUES {_SEEDS}),
cat AS (SELECT * FROM seed UNION ALL SELECT slug, {_NAME}, {_NAME} || ' news and articles', {_case("slug", config.CATEGORY_ICONS, config.CATEGORY_DEFAULT[0])}, {_case("slug", config.CATEGORY_COLORS, config.CATEGORY_DEFAULT[1])}, {config.CATEGORY_DEFAULT[2]}, TRUE
  FROM (SELECT DISTINCT lang AS slug FROM documents) WHERE slug NOT IN (SELECT slug FROM seed))"""
_FEED = f"article_id, title, summary, source_url, source_name, image_url, coalesce(cat.name, '') AS category_name, category_slug, tags, author, {sql_day('published_at')} AS published, score, read_time, is_featured"
WITH_FULL = f"WITH {ARTICLE_SQL}{FULL_SQL}{CATEGORY_SQL}"


def _feed_out(df, *more):
    names = [c for c in serving.FEED_ROW if c not in ("tags", "published_at")]
    return df.select(*names, joined("tags").alias("tags"), day("published_at").alias("published"), *more)


@query(f"{WITH_FULL} SELECT {_FEED} FROM full_article LEFT JOIN cat ON slug = category_slug ORDER BY published_at DESC, score DESC, article_id LIMIT 20")
def feed_rows(spark, sf_dir):
    return _feed_out(serving.feed_rows(feeds.latest_feed(full_articles(spark, sf_dir)), categories(spark, sf_dir)))


@query(f"{WITH_FULL} SELECT {_FEED}, md5(content) AS content_md5, view_count, bookmark_count FROM full_article LEFT JOIN cat ON slug = category_slug")
def detail_rows(spark, sf_dir):
    return _feed_out(serving.detail_rows(full_articles(spark, sf_dir), categories(spark, sf_dir)), F.md5("content").alias("content_md5"), "view_count", "bookmark_count")


@query(f"WITH {ARTICLE_SQL}{FULL_SQL} SELECT article_id, title, summary, source_name AS source, source_url, image_url, category_slug AS category, tags, read_time, score AS relevance_score, {sql_day('published_at')} AS published, {sql_day('created_at')} AS created FROM full_article WHERE category_slug = 'de' ORDER BY published_at DESC, score DESC, article_id LIMIT 20 OFFSET 20")
def news_rows(spark, sf_dir):
    rows = serving.news_rows(feeds.latest_feed(full_articles(spark, sf_dir), 2, 20, category="de"))
    return rows.withColumns({"tags": joined("tags"), "published": day("published_at"), "created": day("created_at")}).drop("published_at", "created_at")


@query(f"WITH {ARTICLE_SQL}{FULL_SQL} SELECT article_id, score FROM full_article WHERE published_at >= {NOW} - INTERVAL 24 HOUR ORDER BY score DESC, article_id LIMIT 20 OFFSET 20")
def today_by_score(spark, sf_dir):
    return feeds.today_by_score(full_articles(spark, sf_dir, bare_articles(spark, sf_dir)), as_of(), 2).select("article_id", "score")


@query(f"WITH {ARTICLE_SQL}{FULL_SQL} SELECT article_id, score FROM full_article ORDER BY score DESC, published_at DESC, article_id LIMIT 20")
def top_feed(spark, sf_dir):
    return feeds.top_feed(full_articles(spark, sf_dir, bare_articles(spark, sf_dir)), 30).select("article_id", "score")


@query(f"WITH {ARTICLE_SQL}{FULL_SQL}{SCORED_SQL.replace('FROM article', 'FROM full_article').replace('substring(content, 1, 2000))', 'substring(content, 1, 2000), replace(tags, chr(44), chr(32)))')} SELECT article_id, final_score, row_number() OVER (ORDER BY score DESC, published_at DESC, article_id) AS rank FROM scored ORDER BY score DESC, published_at DESC, article_id LIMIT 10")
def top_rescored(spark, sf_dir):
    return feeds.top_rescored(full_articles(spark, sf_dir), as_of(), 10, RULES).select("article_id", "final_score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {ARTICLE_SQL}{SCORED_SQL.replace('concat_ws(' + chr(39) + ' ' + chr(39) + ', title, ', 'concat_ws(' + chr(39) + ' ' + chr(39) + ', ' + chr(39) * 2 + ', ')} SELECT article_id, floor(final_score * 100 + 0.5) AS score FROM scored")
def legacy_score(spark, sf_dir):
    from newslake.operators import ranking

    return ranking.legacy_score(ranking.window_scan(articles(spark, sf_dir), as_of()), as_of(), RULES).withColumn("score", F.col("score").cast("double"))


_SEARCH = f"""WITH {ARTICLE_SQL}{FULL_SQL}, w AS (
  SELECT article_id, published_at, 10 AS weight, unnest(regexp_split_to_array(lower(title), '[^a-z0-9]+')) AS t FROM full_article UNION ALL
  SELECT article_id, published_at, 5, unnest(regexp_split_to_array(lower(summary), '[^a-z0-9]+')) FROM full_article UNION ALL
  SELECT article_id, published_at, 3, unnest(regexp_split_to_array(lower(tags), '[^a-z0-9]+')) FROM full_article),
s AS (SELECT article_id, published_at, CAST(sum(weight) AS BIGINT) AS text_score FROM w WHERE t IN ('und', 'the', 't3') GROUP BY 1, 2) SELECT article_id, text_score FROM s"""


@query(f"{_SEARCH} ORDER BY text_score DESC, published_at DESC, article_id LIMIT 20 OFFSET 20")
def search_page(spark, sf_dir):
    return feeds.search_page(full_articles(spark, sf_dir, bare_articles(spark, sf_dir)), "und the T3", 2).select("article_id", "text_score")


@query(f"{_SEARCH} ORDER BY published_at DESC, article_id LIMIT 20")
def search_by_date(spark, sf_dir):
    return feeds.search_page(full_articles(spark, sf_dir, bare_articles(spark, sf_dir)), "und the T3", by_date=True).select("article_id", "text_score")


# ---- bookmarks and history --------------------------------------------------------------------------------------
def _bookmarks(spark, sf_dir):
    """Purchases as bookmarks; every thirteenth is of an article that is gone."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    folder = F.when(F.col("value") < 20, "General").when(F.col("value") < 60, "Later").otherwise("Work")
    gone = F.when(F.col("event_id") % 13 == 0, -1).otherwise(key_number(F.col("props")))
    return e.select(F.col("event_id").alias("bookmark_id"), "user_id", gone.alias("article_id"), folder.alias("folder"), F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("notes"), F.col("ts").alias("created_at"))


_MARK_SQL = f", mark AS (SELECT event_id AS bookmark_id, user_id, CASE WHEN event_id % 13 = 0 THEN -1 ELSE {_K} END AS article_id, CASE WHEN value < 20 THEN 'General' WHEN value < 60 THEN 'Later' ELSE 'Work' END AS folder, 'note ' || CAST(event_id AS VARCHAR) AS notes, ts AS created_at FROM events WHERE event_type = 'purchase')"
_MARK_OUT = f"bookmark_id, user_id, a.article_id, a.title, a.source_name AS source, CASE WHEN a.article_id IS NOT NULL THEN coalesce(cat.name, '') END AS category, a.read_time, folder, notes, {sql_day('m.created_at')} AS created"


def _mark_out(df):
    a = F.col("article")
    return df.select("bookmark_id", "user_id", a["id"].alias("article_id"), a["title"].alias("title"), a["source"].alias("source"), a["category"].alias("category"), a["read_time"].alias("read_time"), "folder", "notes", day("created_at").alias("created"))


@query(f"{WITH_FULL}{_MARK_SQL} SELECT {_MARK_OUT} FROM mark m LEFT JOIN full_article a USING (article_id) LEFT JOIN cat ON slug = category_slug")
def bookmark_rows(spark, sf_dir):
    return _mark_out(serving.bookmark_rows(_bookmarks(spark, sf_dir), full_articles(spark, sf_dir, bare_articles(spark, sf_dir)), categories(spark, sf_dir)))


@query(f"{WITH_FULL}{_MARK_SQL} SELECT {_MARK_OUT} FROM (SELECT * FROM mark WHERE user_id = 3 AND folder = 'Later' ORDER BY created_at DESC, bookmark_id DESC LIMIT 5) m LEFT JOIN full_article a USING (article_id) LEFT JOIN cat ON slug = category_slug")
def bookmark_page(spark, sf_dir):
    return _mark_out(serving.bookmark_page(_bookmarks(spark, sf_dir), full_articles(spark, sf_dir, bare_articles(spark, sf_dir)), categories(spark, sf_dir), 3, "Later", 1, 5))


@query(f"WITH x AS (SELECT 1){_MARK_SQL} SELECT user_id, folder, count(*) AS n FROM mark GROUP BY 1, 2")
def folder_list(spark, sf_dir):
    return serving.folder_list(_bookmarks(spark, sf_dir))


@query(f"WITH x AS (SELECT 1){_MARK_SQL} SELECT user_id, count(*) AS n, (SELECT string_agg(CAST(article_id AS VARCHAR), ',' ORDER BY article_id) FROM (SELECT DISTINCT article_id FROM mark WHERE user_id = m.user_id)) AS article_ids FROM mark m GROUP BY 1")
def bookmarked_ids(spark, sf_dir):
    return serving.bookmarked_ids(_bookmarks(spark, sf_dir)).withColumn("article_ids", joined(F.transform("article_ids", lambda x: x.cast("string"))))


@query(f"WITH {ARTICLE_SQL}{_MARK_SQL}, p AS (SELECT user_id, article_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at, bookmark_id) - 1 AS pos FROM mark) SELECT user_id, pos, article_id, title FROM p JOIN article USING (article_id)")
def bookmarks_in_order(spark, sf_dir):
    order = F.array_sort(F.collect_list(F.struct("created_at", "bookmark_id", "article_id")))
    lists = _bookmarks(spark, sf_dir).groupBy("user_id").agg(F.transform(order, lambda x: x["article_id"]).alias("ids"))
    out = feeds.ids_in_order(lists, bare_articles(spark, sf_dir), "ids", ["user_id"])
    return out.select("user_id", F.col("pos").cast("long").alias("pos"), "article_id", "title")


@query(f"WITH {ARTICLE_SQL}{_MARK_SQL} SELECT article_id, title FROM article WHERE article_id IN (SELECT article_id FROM mark WHERE folder = 'Work')")
def articles_of_ids(spark, sf_dir):
    return serving.of_ids(bare_articles(spark, sf_dir), _bookmarks(spark, sf_dir).where("folder = 'Work'")).select("article_id", "title")


@query(f"""WITH {ARTICLE_SQL}{CATEGORY_SQL}, l AS (SELECT user_id, {_K} AS article_id, max(ts) AS read_at FROM events WHERE event_type = 'view' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY read_at DESC, article_id) AS n FROM l)
SELECT user_id, n - 1 AS pos, r.article_id, {sql_day('read_at')} AS read_at, title, CASE WHEN a.article_id IS NOT NULL THEN coalesce(cat.name, '') END AS category_name FROM r LEFT JOIN article a USING (article_id) LEFT JOIN cat ON slug = category_slug WHERE n <= 20""")
def history_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'view'").select("user_id", key_number(F.col("props")).alias("article_id"), F.col("ts").alias("read_at"))
    entries = engagement.read_history(e).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pos", "article_id", "read_at"))).alias("x"))
    history = entries.select("user_id", F.transform("x", lambda x: F.struct(x["article_id"].alias("article_id"), x["read_at"].alias("read_at"))).alias("read_history"))
    out = serving.history_rows(history, bare_articles(spark, sf_dir), categories(spark, sf_dir))
    return out.withColumns({"pos": F.col("pos").cast("long"), "read_at": day("read_at")})


@query(f"WITH x AS (SELECT 1){CATEGORY_SQL} SELECT name, cat.slug, description, icon, color, count(d.doc_id) AS article_count, sort_order FROM cat LEFT JOIN documents d ON d.lang = cat.slug GROUP BY ALL")
def category_rows(spark, sf_dir):
    return serving.category_rows(feeds.category_refresh(categories(spark, sf_dir), bare_articles(spark, sf_dir)))


# ---- notifications and users ------------------------------------------------------------------------------------
def notification_log(spark, sf_dir):
    """Every event as a notification of three articles, the last of which is gone for some."""
    e = table(spark, sf_dir, "events")
    k = key_number(F.col("props"))
    return e.select(
        F.col("event_id").alias("notification_id"), F.col("event_type").alias("type"), F.when(F.col("event_type") == "error", "failed").otherwise("sent").alias("status"), F.col("ts").alias("created_at"),
        F.array(k, k + 7, F.when(F.col("event_id") % 5 == 0, -1).otherwise(k + 3)).alias("article_ids"), F.array(F.concat(F.lit("t"), k.cast("string"))).alias("device_tokens"),
    )


@query(f"""WITH {ARTICLE_SQL}, n AS (SELECT event_id AS notification_id, unnest([{_K}, {_K} + 7, CASE WHEN event_id % 5 = 0 THEN -1 ELSE {_K} + 3 END]) AS article_id, unnest([0, 1, 2]) AS pos FROM events)
SELECT notification_id, md5(coalesce(string_agg(title, chr(1) ORDER BY pos), '')) AS titles_md5, count(article.article_id) AS n FROM n LEFT JOIN article USING (article_id) GROUP BY 1""")
def notification_titles(spark, sf_dir):
    out = serving.notification_titles(notification_log(spark, sf_dir), bare_articles(spark, sf_dir))
    return out.select("notification_id", F.md5(F.array_join("titles", "\x01")).alias("titles_md5"), F.size("titles").cast("long").alias("n"))


@query(f"SELECT event_id AS notification_id, event_type AS type, 'failed' AS status, {sql_day('ts')} AS created FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 20")
def notification_history(spark, sf_dir):
    out = serving.notification_history(notification_log(spark, sf_dir), "error", "failed", 2)
    assert "device_tokens" not in out.columns
    return out.select("notification_id", "type", "status", day("created_at").alias("created"))


@query(f"WITH {USERS_SQL} SELECT user_id FROM app_user WHERE t1 = 't11' OR t2 = 't11'")
def users_of_token(spark, sf_dir):
    return serving.users_of_token(users(spark, sf_dir), "t11").select("user_id")


@query(f"WITH {USERS_SQL} SELECT count(*) AS users, count(*) FILTER (is_active) AS active, count(*) FILTER (notifications_enabled) AS notifiable FROM app_user")
def user_counts(spark, sf_dir):
    return serving.user_counts(users(spark, sf_dir))


@query(f"WITH {USERS_SQL} SELECT user_id FROM app_user WHERE notifications_enabled")
def digest_recipients_older(spark, sf_dir):
    return serving.notifiable(users(spark, sf_dir)).select("user_id")


@query(f"WITH {USERS_SQL}, bad AS (SELECT 't' || {_K} AS t FROM events WHERE event_type = 'error') SELECT user_id, CASE WHEN t1 IN (SELECT t FROM bad) THEN '' ELSE t1 END AS first, CASE WHEN t2 = t1 OR t2 IN (SELECT t FROM bad) THEN '' ELSE t2 END AS second FROM app_user")
def without_tokens(spark, sf_dir):
    bad = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.concat(F.lit("t"), key_number(F.col("props")).cast("string")).alias("token"))
    u = users(spark, sf_dir)
    kept = engagement.without_tokens(u, bad).select("user_id", F.col("device_tokens").alias("kept")).join(u.select("user_id", "device_tokens"), "user_id")
    has = lambda i: F.when(F.array_contains("kept", F.get("device_tokens", F.lit(i))), F.get("device_tokens", F.lit(i))).otherwise("")
    return kept.select("user_id", has(0).alias("first"), F.coalesce(has(1), F.lit("")).alias("second"))


# ---- runs -------------------------------------------------------------------------------------------------------
@query(f"WITH {ARTICLE_SQL} SELECT count(*) FILTER (published_at >= {NOW} - INTERVAL 2 DAY) AS kept, count(*) FILTER (published_at < {NOW} - INTERVAL 2 DAY) AS deleted FROM article")
def retention_counts(spark, sf_dir):
    return feeds.deleted_before(bare_articles(spark, sf_dir), as_of() - F.expr("INTERVAL 2 DAYS"))


_TABLES = ("documents", "pages", "events", "customer", "conversations", "labels", "benchmark")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def table_counts(spark, sf_dir):
    return feeds.table_counts({t: table(spark, sf_dir, t) for t in _TABLES})


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.floor(F.col("event_id") / 5).alias("run_id"), F.col("event_type").alias("stage"), (F.col("value") > 25).alias("success"), (F.col("value") < 5).alias("thrown"),
        F.col("value").alias("duration"), key_number(F.col("props")).alias("items"), F.col("ts").alias("started_at"),
    )


_RUN_SQL = f"WITH l AS (SELECT event_id, event_id // 5 AS run_id, event_type AS stage, value > 25 AS success, value < 5 AS thrown, value AS duration, {_K} AS items, ts FROM events)"


@query(f"{_RUN_SQL} SELECT coalesce(stage, 'all') AS stage, count(*) AS runs, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures, {sql_rounded('coalesce(avg(duration) FILTER (NOT thrown), 0.0)', 3)} AS avg_duration FROM l GROUP BY ROLLUP (stage)")
def stage_overall(spark, sf_dir):
    out = runs.stage_overall(_runs(spark, sf_dir))
    return out.withColumns({"stage": F.coalesce("stage", F.lit("all")), "avg_duration": rounded(F.col("avg_duration"), 3)})


@query(f"{_RUN_SQL} SELECT run_id, count(*) AS stages, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, CAST(coalesce(sum(items) FILTER (success), 0) AS BIGINT) AS items FROM l GROUP BY 1")
def run_items(spark, sf_dir):
    return runs.run_summary(_runs(spark, sf_dir)).select("run_id", "stages", "succeeded", "failed", "items")


@query(f"{_RUN_SQL} SELECT run_id, {sql_day('max(ts)')} AS started FROM l GROUP BY 1 ORDER BY max(ts) DESC, run_id DESC LIMIT 100")
def run_history(spark, sf_dir):
    return runs.run_history(_runs(spark, sf_dir), 500).select("run_id", day("started_at").alias("started"))


@query(f"SELECT count(*) AS articles, CAST(coalesce(sum(CAST(ceil(length(props) / 4.0) AS BIGINT)), 0) AS BIGINT) AS tokens FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY")
def ai_usage_last_days(spark, sf_dir):
    from newslake.functions.text import token_estimate

    e = table(spark, sf_dir, "events").select(F.col("ts").alias("generated_at"), token_estimate(F.col("props")).alias("tokens"))
    return runs.ai_usage(runs.last_days(e, F.lit("2024-01-20 00:00:00").cast("timestamp"), 7, "generated_at"), 0.25, 0.75).select("articles", "tokens")
