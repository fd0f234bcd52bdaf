"""Registered queries of notifications and summaries: payloads, outboxes, send results, retries, backfills."""

from __future__ import annotations

from pyspark.sql import functions as F

from newslake import config
from newslake.functions import text
from newslake.operators import engagement, notify, summaries
from newslake.plans.queries import _BREAKING_SQL, _K, NOW, query, quoted, rounded, sql_hits, sql_rounded
from newslake.plans.serving import _case
from newslake.views import ARTICLE_SQL, FULL_SQL, USERS_SQL, articles, as_of, bare_articles, full_articles, key_number, table, users

STAMP = config.AS_OF.replace(" ", "T") + "Z"
_BODY = "CASE WHEN length(b) > 150 THEN substring(b, 1, 147) || '...' ELSE b END"


def _payload_sql(rows: str, kind: str, priority: str) -> str:
    return f"""SELECT article_id, t AS title, {_BODY} AS body, image_url, '{priority}' AS priority, '{kind}' AS type, category_slug AS category, 'app://article/' || CAST(article_id AS VARCHAR) AS deep_link, '{STAMP}' AS stamp
FROM (SELECT *, CASE WHEN ai_title <> '' THEN ai_title ELSE title END AS t, CASE WHEN ai_summary <> '' THEN ai_summary ELSE summary END AS b FROM {rows})"""


def _payload_out(df):
    return df.select("article_id", "title", "body", "image_url", "priority", "type", F.col("data")["category"].alias("category"), F.col("data")["deepLink"].alias("deep_link"), F.col("data")["timestamp"].alias("stamp"))


@query(f"WITH {ARTICLE_SQL}{FULL_SQL} {_payload_sql('full_article', 'topic_alert', 'normal')}")
def article_payloads(spark, sf_dir):
    return _payload_out(notify.payload(full_articles(spark, sf_dir, bare_articles(spark, sf_dir)), "topic_alert", as_of=as_of()))


@query(f"SELECT event_id, {_case('kind', config.CHANNELS, config.CHANNEL_DEFAULT)} AS channel FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'breaking_news' WHEN 'click' THEN 'daily_digest' WHEN 'signup' THEN 'topic_alert' ELSE event_type END AS kind FROM events)")
def channels(spark, sf_dir):
    kind = F.expr("CASE event_type WHEN 'view' THEN 'breaking_news' WHEN 'click' THEN 'daily_digest' WHEN 'signup' THEN 'topic_alert' ELSE event_type END")
    return table(spark, sf_dir, "events").select("event_id", notify.channel(kind).alias("channel"))


_REASONS = f"""WITH {ARTICLE_SQL}{FULL_SQL}, h AS (SELECT *, list_filter([{', '.join(map(quoted, config.BREAKING_KEYWORDS))}], lambda k: contains(lower(title), k)) AS hits,
  (epoch({NOW}) - epoch(published_at)) / 3600.0 < 2 AS recent, regexp_matches(lower(coalesce(ai_why, '')), 'major|significant|breakthrough|critical') AS flagged,
  {' OR '.join(f'contains(source_name, {quoted(x)})' for x in config.BREAKING_SOURCES)} AS trusted FROM full_article),
br AS (SELECT *, score + 5 * len(hits) + CASE WHEN recent THEN 10 ELSE 0 END + CASE WHEN view_count > 1000 THEN 5 ELSE 0 END + CASE WHEN bookmark_count > 50 THEN 5 ELSE 0 END + CASE WHEN flagged THEN 10 ELSE 0 END + CASE WHEN trusted THEN 10 ELSE 0 END AS breaking_score FROM h)"""


def _breaking(spark, sf_dir):
    return full_articles(spark, sf_dir).withColumn("why_it_matters", F.col("ai_summary.why_it_matters"))


@query(f"""{_REASONS} SELECT article_id, breaking_score, array_to_string(list_filter([CASE WHEN len(hits) > 0 THEN 'Keywords: ' || array_to_string(hits, ', ') END, CASE WHEN recent THEN 'Very recent (< 2 hours)' END,
  CASE WHEN view_count > 1000 THEN 'High views: ' || CAST(view_count AS VARCHAR) END, CASE WHEN bookmark_count > 50 THEN 'High bookmarks: ' || CAST(bookmark_count AS VARCHAR) END,
  CASE WHEN flagged THEN 'AI flagged as important' END, CASE WHEN trusted THEN 'Authoritative source: ' || source_name END], lambda x: x IS NOT NULL), '; ') AS reasons FROM br""")
def breaking_reasons(spark, sf_dir):
    return notify.breaking_scores(_breaking(spark, sf_dir), as_of()).select("article_id", "breaking_score", F.array_join("reasons", "; ").alias("reasons"))


_AUDIENCE = ", aud AS (SELECT category, t1 AS token FROM app_user WHERE is_active AND notifications_enabled UNION SELECT category, t2 FROM app_user WHERE is_active AND notifications_enabled UNION SELECT second_category, t1 FROM app_user WHERE is_active AND notifications_enabled AND second_category IS NOT NULL UNION SELECT second_category, t2 FROM app_user WHERE is_active AND notifications_enabled AND second_category IS NOT NULL)"


@query(f"{_REASONS}, {USERS_SQL}{_AUDIENCE} SELECT p.*, (SELECT count(DISTINCT token) FROM aud) AS n_tokens FROM ({_payload_sql('br WHERE breaking_score >= 85', 'breaking_news', 'high')}) p")
def breaking_outbox(spark, sf_dir):
    """Every breaking article goes to the same audience, so its tokens are counted once."""
    out = _payload_out(notify.breaking_outbox(_breaking(spark, sf_dir), as_of()))
    n = engagement.distinct_tokens(engagement.recipients(users(spark, sf_dir), as_of(), "all")).agg(F.count("*").alias("n_tokens"))
    return out.join(F.broadcast(n))  # one row


@query(f"WITH {ARTICLE_SQL}{FULL_SQL}, {USERS_SQL}{_AUDIENCE}, n AS (SELECT category AS c, count(*) AS n_tokens FROM aud GROUP BY 1) SELECT p.*, n_tokens FROM ({_payload_sql('full_article WHERE score >= 70', 'topic_alert', 'normal')}) p JOIN n ON n.c = p.category")
def topic_outbox(spark, sf_dir):
    tokens = engagement.category_tokens(engagement.recipients(users(spark, sf_dir), as_of(), "all"))
    out = notify.addressed(notify.topic_outbox(full_articles(spark, sf_dir, bare_articles(spark, sf_dir)), as_of()), tokens)
    return _payload_out(out).join(out.select("article_id", "n_tokens"), "article_id")


@query(f"WITH {ARTICLE_SQL} SELECT article_id, '🚨 Breaking Tech News' AS title, title AS body FROM article WHERE published_at >= {NOW} - INTERVAL 1 HOUR")
def older_outbox(spark, sf_dir):
    return notify.older_outbox(bare_articles(spark, sf_dir).where(F.col("published_at") >= as_of() - F.expr("INTERVAL 1 HOUR")))


@query(f"""WITH {ARTICLE_SQL}{FULL_SQL}, {USERS_SQL}, t AS (SELECT * FROM full_article WHERE published_at >= {NOW} - INTERVAL 24 HOUR AND ai_title IS NOT NULL ORDER BY score DESC, article_id LIMIT 10),
f AS (SELECT *, row_number() OVER (ORDER BY score DESC, article_id) AS r, count(*) OVER () AS n FROM t), c AS (SELECT category_slug, min(r) AS r FROM f GROUP BY 1),
rec AS (SELECT t1 AS token FROM app_user WHERE is_active AND notifications_enabled AND abs(pref_hour - hour({NOW})) <= 1 UNION SELECT t2 FROM app_user WHERE is_active AND notifications_enabled AND abs(pref_hour - hour({NOW})) <= 1)
SELECT (SELECT string_agg(CAST(article_id AS VARCHAR), ',' ORDER BY r) FROM f) AS article_ids, (SELECT string_agg(category_slug, ',' ORDER BY r) FROM c) AS categories, 'Your Daily Tech Digest' AS title,
substring(CAST(n AS VARCHAR) || ' top stories today: ' || title || CASE WHEN n > 1 THEN ' and more' ELSE '' END, 1, 150) AS body, image_url, 'app://digest' AS deep_link, (SELECT count(*) FROM rec) AS n_tokens FROM f WHERE r = 1""")
def digest_outbox(spark, sf_dir):
    out = notify.digest(full_articles(spark, sf_dir, bare_articles(spark, sf_dir)), as_of(), score="score")
    n = engagement.distinct_tokens(engagement.recipients(users(spark, sf_dir), as_of())).agg(F.count("*").alias("n_tokens"))
    return out.join(F.broadcast(n))  # one row each


@query(f"WITH {ARTICLE_SQL}{FULL_SQL}, t AS (SELECT * FROM full_article ORDER BY score DESC, article_id LIMIT 5) SELECT string_agg(CAST(article_id AS VARCHAR), ',' ORDER BY score DESC, article_id) AS article_ids FROM t")
def digest_older(spark, sf_dir):
    rows = full_articles(spark, sf_dir, bare_articles(spark, sf_dir)).drop("ai_summary")
    return notify.digest(rows, as_of(), 5, "score", bounded=False).select("article_ids")


# ---- sends and retries ------------------------------------------------------------------------------------------
_ERRORS = ("messaging/internal-error", *config.INVALID_TOKEN_ERRORS)


def _results(spark, sf_dir):
    """Every event as the send of a token for one of event_id / 7 notifications."""
    e = table(spark, sf_dir, "events")
    ok = F.col("value") > 30
    error = F.element_at(F.array(*map(F.lit, _ERRORS)), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.floor(F.col("event_id") / 7).alias("notification_id"), F.concat(F.lit("t"), key_number(F.col("props")).cast("string")).alias("token"), ok.alias("ok"), F.when(~ok, error).alias("error"))


_RES_SQL = f"res AS (SELECT event_id // 7 AS notification_id, 't' || CAST({_K} AS VARCHAR) AS token, value > 30 AS ok, event_id % 4 <> 0 AND NOT value > 30 AS invalid FROM events)"
_SUM_SQL = f"{_RES_SQL}, sm AS (SELECT notification_id, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures, coalesce(list_sort(list_distinct(list(token) FILTER (invalid))), []) AS bad FROM res GROUP BY 1)"


@query(f"WITH {_SUM_SQL} SELECT notification_id, successes, failures, array_to_string(bad, ',') AS invalid_tokens FROM sm")
def send_summary(spark, sf_dir):
    return notify.send_summary(_results(spark, sf_dir), "notification_id").withColumn("invalid_tokens", F.array_join("invalid_tokens", ","))


@query(f"WITH {_SUM_SQL}, o AS (SELECT DISTINCT event_id // 5 AS notification_id FROM events) SELECT notification_id, coalesce(successes, 0) AS success_count, coalesce(failures, 0) AS failure_count, CASE WHEN coalesce(successes, 0) > 0 THEN 'sent' ELSE 'failed' END AS status, len(coalesce(bad, [])) AS n_invalid FROM o LEFT JOIN sm USING (notification_id)")
def recorded_sends(spark, sf_dir):
    outbox = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 5).alias("notification_id")).distinct()
    out = notify.recorded(outbox, _results(spark, sf_dir))
    return out.select("notification_id", "success_count", "failure_count", "status", F.size("invalid_tokens").cast("long").alias("n_invalid"))


@query(f"""WITH {_SUM_SQL}, f AS (SELECT event_id AS notification_id, CASE WHEN event_id % 6 = 0 THEN [''] ELSE ['t' || CAST({_K} AS VARCHAR), '', 't' || CAST({_K} + 1 AS VARCHAR)] END AS tokens, CAST(floor(value) AS BIGINT) AS s FROM events WHERE event_type = 'error'),
v AS (SELECT *, list_filter(tokens, lambda x: x <> '') AS t FROM f)
SELECT notification_id, CASE WHEN len(t) > 0 AND coalesce(successes, 0) > 0 THEN 'sent' ELSE 'failed' END AS status, s + CASE WHEN len(t) > 0 THEN coalesce(successes, 0) ELSE 0 END AS success_count, CASE WHEN len(t) > 0 THEN coalesce(failures, 0) ELSE 0 END AS failure_count,
array_to_string(CASE WHEN len(t) > 0 THEN list_filter(t, lambda x: NOT list_contains(coalesce(bad, []), x)) ELSE tokens END, ',') AS device_tokens, CASE WHEN len(t) = 0 THEN 'No valid tokens remaining' END AS error_message FROM v LEFT JOIN sm USING (notification_id)""")
def retry_apply(spark, sf_dir):
    k = key_number(F.col("props"))
    token = lambda x: F.concat(F.lit("t"), x.cast("string"))
    tokens = F.when(F.col("event_id") % 6 == 0, F.array(F.lit(""))).otherwise(F.array(token(k), F.lit(""), token(k + 1)))
    failed = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("notification_id"), tokens.alias("device_tokens"), F.floor("value").alias("success_count"), F.lit(0).cast("long").alias("failure_count"))
    return notify.retried(failed, _results(spark, sf_dir)).withColumn("device_tokens", F.array_join("device_tokens", ",")).drop("retried")


@query(f"WITH {USERS_SQL} SELECT user_id FROM app_user WHERE is_active AND notifications_enabled AND (category = 'fr' OR second_category = 'fr')")
def topic_recipients(spark, sf_dir):
    return engagement.recipients(users(spark, sf_dir), as_of(), "topic", "fr").select("user_id")


@query(f"WITH {USERS_SQL} SELECT user_id, t1 AS token FROM app_user WHERE user_id = 5 AND notifications_enabled UNION SELECT user_id, t2 FROM app_user WHERE user_id = 5 AND notifications_enabled")
def sent_to_user(spark, sf_dir):
    return notify.sent_to_user(users(spark, sf_dir), 5)


# ---- summaries --------------------------------------------------------------------------------------------------
_NEEDS = f"WITH {ARTICLE_SQL}{FULL_SQL}, need AS (SELECT * FROM full_article WHERE (ai_title IS NULL OR coalesce(ai_summary, '') = '') AND content <> '')"


@query(f"{_NEEDS} SELECT article_id FROM need ORDER BY published_at DESC, article_id LIMIT 50")
def needs_summary(spark, sf_dir):
    return summaries.needs_summary(full_articles(spark, sf_dir, bare_articles(spark, sf_dir))).select("article_id")


_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(content, '\\s+', ' ', 'g'), '\\[.*?\\]', '', 'g'), 'https?://\\S+', '', 'g'))"
_BACKFILL = f"""{_NEEDS}, c AS (SELECT *, {_CLEAN} AS x, length(trim(content)) AS n, len(regexp_split_to_array(trim(content), '\\s+')) AS words FROM need),
s AS (SELECT article_id, unnest(a) AS s, generate_subscripts(a, 1) AS pos FROM (SELECT article_id, string_split(regexp_replace(x, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS a FROM c)),
r AS (SELECT article_id, s, pos, row_number() OVER (PARTITION BY article_id ORDER BY pos) AS rn FROM s WHERE length(s) > 20 AND length(s) < 200),
f AS (SELECT article_id, substring(string_agg(s, ' ' ORDER BY pos), 1, 300) AS summary FROM r WHERE rn <= 3 GROUP BY 1),
k AS (SELECT *, list_filter([{', '.join(map(quoted, config.SUMMARY_KEYWORDS))}], lambda k: contains(lower(x), k))[1:3] AS hits FROM c),
b AS (SELECT k.article_id, NOT (n < 100 OR (n >= 200 AND words < 30)) AS valid, CASE WHEN n < 100 THEN 'too short' WHEN n < 200 THEN 'brief' WHEN words < 30 THEN 'too few words' ELSE 'ok' END AS reason, coalesce(f.summary, 'Summary not available.') AS summary,
  CASE WHEN len(hits) > 0 THEN 'This relates to ' || array_to_string(hits, ', ') || ' in tech.' ELSE 'This is a notable development in the tech industry.' END AS why,
  substring(trim(regexp_replace(regexp_replace(regexp_replace(title, '\\s+', ' ', 'g'), '\\|.*$', ''), '-\\s*[^-]*$', '')), 1, 100) AS ai_title FROM k LEFT JOIN f USING (article_id))"""


@query(f"{_BACKFILL} SELECT article_id, valid, reason, CASE WHEN valid THEN summary END AS summary, CASE WHEN valid THEN why END AS why, CASE WHEN valid THEN ai_title END AS title FROM b")
def summary_backfill(spark, sf_dir):
    need = summaries.needs_summary(full_articles(spark, sf_dir, bare_articles(spark, sf_dir)), None)
    out = summaries.backfill(need, as_of())
    return out.select("article_id", "valid", "reason", "summary", F.col("ai_summary.why_it_matters").alias("why"), F.col("ai_summary.title").alias("title"))


@query(f"{_BACKFILL} SELECT count(*) AS total, count(*) FILTER (valid) AS successful, count(*) FILTER (NOT valid) AS skipped FROM b")
def summary_counts(spark, sf_dir):
    return summaries.backfill_counts(summaries.backfill(summaries.needs_summary(full_articles(spark, sf_dir, bare_articles(spark, sf_dir)), None), as_of()))


@query(f"{_BACKFILL} SELECT a.article_id, CASE WHEN b.valid THEN b.summary ELSE a.summary END AS summary, CASE WHEN b.valid THEN b.ai_title ELSE a.ai_title END AS ai_title FROM full_article a LEFT JOIN b USING (article_id)")
def summary_stored(spark, sf_dir):
    rows = full_articles(spark, sf_dir, bare_articles(spark, sf_dir))
    return summaries.stored(rows, summaries.backfill(summaries.needs_summary(rows, None), as_of())).select("article_id", "summary", F.col("ai_summary.title").alias("ai_title"))


_TWO = "SELECT article_id, s, pos, row_number() OVER (PARTITION BY article_id ORDER BY pos) AS rn FROM (SELECT article_id, unnest(a) AS s, generate_subscripts(a, 1) AS pos FROM (SELECT article_id, string_split(regexp_replace(regexp_replace(content, '\\s+', ' ', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS a FROM article)) WHERE length(s) > 20"


@query(f"WITH {ARTICLE_SQL}, r AS ({_TWO}), f AS (SELECT article_id, substring(string_agg(s, ' ' ORDER BY pos), 1, 500) AS summary FROM r WHERE rn <= 2 GROUP BY 1) SELECT a.article_id, coalesce(summary, '') AS summary FROM article a LEFT JOIN f USING (article_id)")
def two_sentences(spark, sf_dir):
    return bare_articles(spark, sf_dir).select("article_id", text.two_sentences(F.col("content")).alias("summary"))


_PROMPT = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '\\s+', ' ', 'g'), '\\[.*?\\]', '', 'g'), 'https?://\\S+', '', 'g'), '[^\\w\\s.,!?;:''\"()-]', '', 'g'))"


@query(f"""WITH {ARTICLE_SQL}, p AS (SELECT article_id, {_PROMPT} AS x FROM article), c AS (SELECT *, substring(x, 1, 3000) AS cut FROM p),
e AS (SELECT *, length(regexp_extract(cut, '^(.*[.!?])', 1, 's')) AS stop, length(regexp_extract(cut, '^(.*) ', 1, 's')) AS space FROM c)
SELECT article_id, md5(y) AS prompt_md5, CAST(ceil(length(y) / 4.0) AS BIGINT) AS tokens FROM (SELECT article_id, CASE WHEN length(x) <= 3000 THEN x WHEN stop - 1 > 2100 THEN substring(cut, 1, stop) ELSE substring(cut, 1, space) || '...' END AS y FROM e)""")
def prompt_inputs(spark, sf_dir):
    return summaries.prompt_inputs(bare_articles(spark, sf_dir), 3000).select("article_id", F.md5("prompt").alias("prompt_md5"), "tokens")


_MODELS = [*config.MODEL_PRICES, "other"]
_PRICES = ", ".join(f"({quoted(m)}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for m, (a, b) in config.MODEL_PRICES.items())


@query(f"""WITH u AS (SELECT [{", ".join(map(quoted, _MODELS))}][CAST(conv_id % 5 AS INTEGER) + 1] AS model, CAST(ceil(length(text) / 4.0) AS BIGINT) AS i, turn + 1 AS o FROM conversations), p(model, a, b) AS (VALUES {_PRICES}),
s AS (SELECT model, count(*) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens FROM u GROUP BY 1) SELECT model, calls, input_tokens, output_tokens, {sql_rounded('input_tokens * a + output_tokens * b', 9)} AS cost FROM s LEFT JOIN p USING (model)""")
def model_costs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    model = F.element_at(F.array(*map(F.lit, _MODELS)), (F.col("conv_id") % 5 + 1).cast("int"))
    out = summaries.model_costs(c.select(model.alias("model"), text.token_estimate(F.col("text")).alias("input_tokens"), (F.col("turn") + 1).alias("output_tokens")))
    return out.withColumn("cost", rounded(F.col("cost"), 9))


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN NULL WHEN doc_id % 4 = 1 THEN 'Untitled' ELSE 'Title of ' || CAST(doc_id AS VARCHAR) END AS title, CASE WHEN doc_id % 6 = 5 THEN NULL ELSE lang || ' text' END AS summary,
CASE WHEN doc_id % 6 = 5 THEN NULL WHEN doc_id % 3 = 0 THEN 'since ' || source WHEN doc_id % 3 = 1 THEN source ELSE '' END AS why FROM documents""")
def reply_fields(spark, sf_dir):
    """Replies are made of the documents' ids, languages and sources: fenced, with blank fields, both spellings, and none."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id").cast("string")
    title = F.when(F.col("doc_id") % 4 == 1, "  ").otherwise(F.concat(F.lit(" Title of "), i))
    why = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('"why_it_matters": "since '), "source", F.lit('"'))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('"why_it_matters": "", "whyItMatters": "'), "source", F.lit('"'))).otherwise('"other": 1')
    reply = F.concat(F.lit('Here it is:\n```json\n{"title": "'), title, F.lit('",\n"summary": "'), "lang", F.lit(' text", '), why, F.lit("}\n```"))
    reply = F.when(F.col("doc_id") % 12 == 5, "no braces").when(F.col("doc_id") % 12 == 11, '{"title": broken').otherwise(reply)
    return d.select("doc_id", text.reply_fields(reply).alias("x")).select("doc_id", "x.title", "x.summary", F.col("x.why_it_matters").alias("why"))
