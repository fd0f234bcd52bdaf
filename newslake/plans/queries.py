"""Registered queries over the test tables, each with an equal SQL text where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslake import config
from newslake.functions import text, urls
from newslake.operators import dedupe, engagement, feeds, notify, ranking, runs, similarity
from newslake.operators.checkpoints import reliable
from newslake.views import ARTICLE_SQL, FULL_SQL, USERS_SQL, articles, as_of, bare_articles, full_articles, key_number, table, users

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: A dictionary that the generated words of the test tables match.
SMALL_KEYWORDS = {"tion": 3.0, "ing": 2.0, "ent": 1.5, "eux": 2.5, "ung": 1.0, "able": 1.0, "zz": 3.0}
NOW = f"TIMESTAMP '{config.AS_OF}'"


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def day(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def sql_day(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_hits(column: str, weights: dict[str, float]) -> str:
    return " + ".join(f"CASE WHEN contains({column}, {quoted(k)}) THEN {float(w)}::DOUBLE ELSE 0.0::DOUBLE END" for k, w in weights.items())


def sql_lookup(column: str, values: dict[str, float], default: float) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {quoted(k)} THEN {float(v)}::DOUBLE" for k, v in values.items()) + f" ELSE {float(default)}::DOUBLE END"


def rounded(x, n: int = 6):
    return text.half_up(x, n)


def sql_rounded(x: str, n: int = 6) -> str:
    return f"floor(({x}) * {10.0**n:.1f}::DOUBLE + 0.5) / {10.0**n:.1f}::DOUBLE"


def mean4(x):
    """Four decimals, a tie (within the error of a sum's order) upwards."""
    return F.floor(x * 10000.0 + 0.500001) / 10000.0


def sql_mean4(x: str) -> str:
    return f"floor(({x}) * 10000.0::DOUBLE + 0.500001::DOUBLE) / 10000.0::DOUBLE"


# ---- ranking ----------------------------------------------------------------------------------------------------
RULES = config.Ranking(keywords={**config.KEYWORD_WEIGHTS, **SMALL_KEYWORDS}, boosts={**config.CATEGORY_BOOSTS, "en": 1.25, "fr": 1.1}, authorities={**config.SOURCE_AUTHORITY, "src0": 98, "src1": 85})

SCORED_SQL = f""", raw AS (
  SELECT *, lower(concat_ws(' ', title, substring(content, 1, 2000))) AS body, (epoch({NOW}) - epoch(published_at)) / 3600.0::DOUBLE AS age FROM article
  WHERE published_at >= {NOW} - INTERVAL 72 HOUR),
sig AS (SELECT *, {sql_hits("body", RULES.keywords)} AS kw, {sql_lookup("source_name", RULES.authorities, 50)} AS auth, {sql_lookup("category_slug", RULES.boosts, 1)} AS boost FROM raw),
comp AS (SELECT *, 0.2::DOUBLE * 0.20::DOUBLE AS comp_source,
  (CASE WHEN kw = 0 THEN 0.1::DOUBLE ELSE greatest(0.1::DOUBLE, least(1.0::DOUBLE, 1 / (1 + exp(-0.3::DOUBLE * (kw - 5))))) END) * 0.25::DOUBLE AS comp_keyword,
  (CASE WHEN age > 72 THEN 0.01::DOUBLE ELSE greatest(0.01::DOUBLE, pow(0.5::DOUBLE, age / 12.0::DOUBLE)) END) * 0.25::DOUBLE AS comp_recency,
  greatest(0.05::DOUBLE, least(1.0::DOUBLE, least(0.25::DOUBLE, log10(view_count + 1.0::DOUBLE) * 0.1::DOUBLE) + least(0.15::DOUBLE, log10(bookmark_count + 1.0::DOUBLE) * 0.1::DOUBLE))) * 0.20::DOUBLE AS comp_engagement,
  greatest(0.1::DOUBLE, least(1.0::DOUBLE, auth / 100)) * 0.10::DOUBLE AS comp_authority FROM sig),
scored AS (SELECT *, floor((comp_source + comp_keyword + comp_recency + comp_engagement + comp_authority) * boost * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS final_score FROM comp)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_scores(ranking.window_scan(articles(spark, sf_dir), as_of()), as_of(), RULES)


@query(f"WITH {ARTICLE_SQL}{SCORED_SQL} SELECT article_id, title, final_score, row_number() OVER (ORDER BY final_score DESC, article_id) AS rank FROM scored ORDER BY final_score DESC, article_id LIMIT 10")
def rank_top10(spark, sf_dir):
    return ranking.top_ranked(scored(spark, sf_dir)).select("article_id", "title", "final_score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {ARTICLE_SQL}{SCORED_SQL} SELECT article_id, final_score FROM scored")
def rank_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("article_id", "final_score")


@query(f"WITH {ARTICLE_SQL}, t AS (SELECT article_id, lower(concat_ws(' ', coalesce(title, ''), substring(coalesce(content, ''), 1, 2000))) AS low FROM article) SELECT article_id, array_to_string(list_filter([{', '.join(map(quoted, config.KEYWORD_WEIGHTS))}], lambda k: contains(low, k)), ',') AS keywords FROM t")
def rank_keywords(spark, sf_dir):
    return ranking.signals(bare_articles(spark, sf_dir), as_of()).select("article_id", F.array_join("raw_keywords", ",").alias("keywords"))


_COMPONENTS = ("source", "keyword", "recency", "engagement", "authority")


@query(f"WITH {ARTICLE_SQL}{SCORED_SQL} SELECT article_id, {', '.join(f'{sql_rounded(f'comp_{n}')} AS {n}' for n in _COMPONENTS)} FROM scored")
def rank_components(spark, sf_dir):
    return scored(spark, sf_dir).select("article_id", *[rounded(F.col(f"comp_{n}")).alias(n) for n in _COMPONENTS])


@query(f"""WITH {ARTICLE_SQL}{SCORED_SQL}, top AS (SELECT article_id AS top_id FROM scored ORDER BY final_score DESC, article_id LIMIT 1)
SELECT a.article_id, CASE WHEN a.published_at >= {NOW} - INTERVAL 24 HOUR THEN a.article_id = top_id ELSE a.article_id % 50 = 0 OR a.article_id = top_id END AS is_featured FROM article a, top""")
def featured_flag(spark, sf_dir):
    top = F.broadcast(ranking.top_ranked(scored(spark, sf_dir), 1).select(F.col("article_id").alias("top_id")))
    rows = articles(spark, sf_dir).withColumn("is_featured", F.col("article_id") % 50 == 0).join(top)
    return ranking.featured(rows, F.col("top_id"), as_of()).select("article_id", "is_featured")


# ---- feeds ------------------------------------------------------------------------------------------------------
@query(f"WITH {ARTICLE_SQL}{FULL_SQL} SELECT article_id, title, source_name, {sql_day('published_at')} AS published FROM full_article ORDER BY published_at DESC, score DESC, article_id LIMIT 20 OFFSET 20")
def latest_feed_page2(spark, sf_dir):
    return feeds.latest_feed(full_articles(spark, sf_dir, bare_articles(spark, sf_dir)), 2, 20).select("article_id", "title", "source_name", day("published_at").alias("published"))


@query(f"WITH {ARTICLE_SQL} SELECT article_id, {sql_day('published_at')} AS published FROM article WHERE category_slug = 'fr' AND published_at >= {NOW} - INTERVAL 48 HOUR")
def category_feed(spark, sf_dir):
    rows = feeds.article_filter(bare_articles(spark, sf_dir), category="fr", since=as_of() - F.expr("INTERVAL 48 HOURS"))
    return rows.select("article_id", day("published_at").alias("published"))


@query(f"WITH {ARTICLE_SQL}{FULL_SQL} SELECT article_id FROM full_article WHERE category_slug = 'en' AND published_at >= {NOW} - INTERVAL 72 HOUR AND published_at <= {NOW} - INTERVAL 2 HOUR AND NOT is_featured AND contains(lower(title), 'th')")
def filtered_feed(spark, sf_dir):
    at = lambda h: as_of() - F.expr(f"INTERVAL {h} HOURS")
    rows = full_articles(spark, sf_dir, bare_articles(spark, sf_dir))
    return feeds.article_filter(rows, "en", at(72), at(2), False, "TH").select("article_id")


@query(f"WITH {ARTICLE_SQL} SELECT article_id, title FROM article WHERE published_at >= {NOW} - INTERVAL 24 HOUR")
def today_feed(spark, sf_dir):
    return feeds.today_feed(bare_articles(spark, sf_dir), as_of()).select("article_id", "title")


@query(f"WITH {ARTICLE_SQL} SELECT article_id, {sql_day('published_at')} AS published FROM article WHERE published_at < {NOW} - INTERVAL 10 HOUR OR (published_at = {NOW} - INTERVAL 10 HOUR AND article_id < 500) ORDER BY published_at DESC, article_id DESC LIMIT 21")
def keyset_page(spark, sf_dir):
    at = as_of() - F.expr("INTERVAL 10 HOURS")
    return feeds.keyset_page(bare_articles(spark, sf_dir), "published_at", at, 500, 20).select("article_id", day("published_at").alias("published"))


_PAGE_SQL = f"WITH {ARTICLE_SQL}, p AS (SELECT article_id, published_at FROM article WHERE published_at < {NOW} - INTERVAL 10 HOUR OR (published_at = {NOW} - INTERVAL 10 HOUR AND article_id < 500) ORDER BY published_at DESC, article_id DESC LIMIT 21), o AS (SELECT *, row_number() OVER (ORDER BY published_at DESC, article_id DESC) AS n FROM p)"


@query(f"{_PAGE_SQL} SELECT (SELECT count(*) > 20 FROM p) AS has_more, {sql_day('l.published_at')} AS next_value, l.article_id AS next_id, {sql_day('f.published_at')} AS prev_value, f.article_id AS prev_id FROM o f LEFT JOIN o l ON l.n = 20 AND (SELECT count(*) > 20 FROM p) WHERE f.n = 1")
def keyset_cursors(spark, sf_dir):
    page = feeds.keyset_page(bare_articles(spark, sf_dir), "published_at", as_of() - F.expr("INTERVAL 10 HOURS"), 500, 20)
    out = feeds.keyset_cursors(page, "published_at", 20, True)
    return out.withColumns({c: day(c) for c in ("next_value", "prev_value")})


@query(f"{_PAGE_SQL}, f AS (SELECT * FROM o WHERE n = 1) SELECT a.article_id, {sql_day('a.published_at')} AS published FROM article a, f WHERE a.published_at > f.published_at OR (a.published_at = f.published_at AND a.article_id > f.article_id) ORDER BY a.published_at, a.article_id LIMIT 21")
def keyset_previous(spark, sf_dir):
    """The page before, by the previous cursor read upwards."""
    rows = bare_articles(spark, sf_dir)
    page = feeds.keyset_page(rows, "published_at", as_of() - F.expr("INTERVAL 10 HOURS"), 500, 20)
    at = feeds.keyset_cursors(page, "published_at", 20, True).first()
    before = feeds.keyset_page(rows, "published_at", F.lit(at["prev_value"]), at["prev_id"], 20, ascending=True)
    return before.select("article_id", day("published_at").alias("published"))


@query(f"WITH {ARTICLE_SQL} SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages, 150 < count(*) AS has_more, TRUE AS has_previous FROM article")
def page_info(spark, sf_dir):
    return feeds.page_info(bare_articles(spark, sf_dir), 3, 50)


@query(f"""WITH {ARTICLE_SQL}, w AS (
  SELECT article_id, 10 AS weight, unnest(regexp_split_to_array(lower(title), '[^a-z0-9]+')) AS t FROM article UNION ALL
  SELECT article_id, 1, unnest(regexp_split_to_array(lower(content), '[^a-z0-9]+')) FROM article)
SELECT article_id, CAST(sum(weight) AS BIGINT) AS text_score FROM w WHERE t IN ('tion', 'ing', 'with') GROUP BY article_id""")
def search_weighted(spark, sf_dir):
    return feeds.search(bare_articles(spark, sf_dir), "tion ing with", {"title": 10, "content": 1}).select("article_id", "text_score")


@query("SELECT source AS source_name, count(*) AS n FROM documents GROUP BY 1")
def source_counts(spark, sf_dir):
    return feeds.counts_by(bare_articles(spark, sf_dir), "source_name")


@query("SELECT lang AS category_slug, count(*) AS n FROM documents GROUP BY 1")
def category_counts(spark, sf_dir):
    return feeds.counts_by(bare_articles(spark, sf_dir), "category_slug")


@query(f"WITH {ARTICLE_SQL} SELECT source_name, min(article_id) AS article_id, arg_min(title, article_id) AS title FROM article GROUP BY 1")
def source_sample(spark, sf_dir):
    return feeds.sample_by(bare_articles(spark, sf_dir), "source_name")


@query(f"WITH {ARTICLE_SQL}, c(slug) AS (VALUES ('en'), ('fr'), ('de'), ('es'), ('it')) SELECT slug, count(article_id) AS article_count FROM c LEFT JOIN article ON category_slug = slug GROUP BY 1")
def category_refresh(spark, sf_dir):
    c = spark.createDataFrame([(x,) for x in ("en", "fr", "de", "es", "it")], "slug string")
    return feeds.category_refresh(c, bare_articles(spark, sf_dir))


# ---- text -------------------------------------------------------------------------------------------------------
@query(f"""WITH {ARTICLE_SQL}, t AS (SELECT article_id, source_name, lower(concat_ws(' ', title, '', content)) AS x FROM article),
s AS (SELECT article_id, CASE WHEN {' OR '.join(f'contains(lower(source_name), {quoted(x)})' for x in config.TECH_SOURCES)} THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS trust, {sql_hits('x', {**dict.fromkeys(config.TECH_HIGH, 3), **{'tion': 3}})} AS high, {sql_hits('x', dict.fromkeys(config.TECH_MEDIUM, 2))} AS medium, {sql_hits('x', dict.fromkeys(config.TECH_LOW, 1))} AS low, {sql_hits('x', dict.fromkeys(config.NON_TECH, 2))} AS non FROM t)
SELECT article_id, {sql_rounded('greatest(0.0::DOUBLE, least(1.0::DOUBLE, (high + medium + low - non + trust) / 30))')} AS score, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (high + medium + low - non + trust) / 30)) >= 0.15 AS is_tech FROM s""")
def tech_filter(spark, sf_dir):
    x = text.tech_score(F.col("title"), F.lit(""), F.col("content"), F.col("source_name"), ("tion",))
    return bare_articles(spark, sf_dir).select("article_id", x.alias("x")).select("article_id", rounded(F.col("x")).alias("score"), text.is_tech(F.col("x")).alias("is_tech"))


def _sql_chain(x: str, steps) -> str:
    for pattern, to, flags in steps:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(to)}, {quoted(flags)})"
    return x


_STRIP = _sql_chain("html", [("<script[^>]*>.*?</script>", "", "gis"), ("<style[^>]*>.*?</style>", "", "gis"), ("<[^>]+>", " ", "g"), ("&nbsp;", " ", "g"), ("&amp;", "&", "g"), ("&lt;", "<", "g"), ("&gt;", ">", "g"), ("&quot;", '"', "g"), ("&#39;", "'", "g"), (r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+", " ", "g")])


@query(f"""SELECT page_id, md5(x) AS text_md5, length(x) AS n_chars, CAST(greatest(1, least(30, ceil(len(regexp_split_to_array(x, '\\s+')) / 200.0))) AS INTEGER) AS read_time FROM (SELECT page_id, trim({_STRIP}) AS x FROM pages)""")
def normalize_pages(spark, sf_dir):
    x = text.strip_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(x).alias("text_md5"), F.length(x).cast("long").alias("n_chars"), text.read_time(x).alias("read_time"))


_PLAIN = lambda c: f"trim(regexp_replace(regexp_replace(lower({c}), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_HOST = "regexp_extract(source_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)"
_PATH = "regexp_extract(source_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1)"
_BASE = f"regexp_replace(concat(regexp_replace({_HOST}, '^www\\.', ''), CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END), '/+$', '')"
_PARAMS = "concat_ws('&', " + ", ".join(f"CASE WHEN regexp_extract(source_url, '[?&]{p}=([^&#]*)', 1) <> '' THEN concat('{p}=', regexp_extract(source_url, '[?&]{p}=([^&#]*)', 1)) END" for p in ("id", "p", "article", "story")) + ")"
_URL_KEY = f"CASE WHEN {_HOST} = '' THEN lower(source_url) ELSE lower(concat({_BASE}, CASE WHEN {_PARAMS} <> '' THEN concat('?', {_PARAMS}) ELSE '' END)) END"
_CLUSTER_KEY = f"CASE WHEN {_HOST} = '' THEN lower(source_url) ELSE lower({_BASE}) END"


@query(f"WITH {ARTICLE_SQL} SELECT article_id, {_URL_KEY} AS url_key, {_CLUSTER_KEY} AS cluster_key FROM article")
def url_keys(spark, sf_dir):
    u = F.col("source_url")
    return articles(spark, sf_dir).select("article_id", urls.url_key(u).alias("url_key"), urls.url_key(u, ()).alias("cluster_key"))


_FINGERPRINT = f"substring(sha256(concat({_PLAIN('title')}, '|', substring({_PLAIN('content')}, 1, 500))), 1, 32)"


@query(f"WITH {ARTICLE_SQL} SELECT article_id, {_FINGERPRINT} AS content_fp FROM article")
def fingerprints(spark, sf_dir):
    return bare_articles(spark, sf_dir).select("article_id", text.content_fingerprint(F.col("title"), F.col("content")).alias("content_fp"))


@query(f"""WITH {ARTICLE_SQL}, w AS (SELECT article_id, unnest(a) AS word, generate_subscripts(a, 1) AS pos FROM (SELECT article_id, regexp_split_to_array(regexp_replace(lower(content), '[^a-z0-9\\s]', '', 'g'), '\\s+') AS a FROM article)),
c AS (SELECT article_id, word, count(*) AS n, min(pos) AS first FROM w WHERE length(word) > 3 AND word NOT IN ({', '.join(map(quoted, config.FINGERPRINT_STOPS))}) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY n DESC, first) AS rn FROM c),
f AS (SELECT article_id, string_agg(word, '|' ORDER BY word) AS top FROM r WHERE rn <= 20 GROUP BY 1)
SELECT a.article_id, substring(sha256(coalesce(top, '')), 1, 32) AS keyword_fp FROM article a LEFT JOIN f USING (article_id)""")
def keyword_fingerprint(spark, sf_dir):
    return text.keyword_fingerprint(bare_articles(spark, sf_dir))


@query(f"""WITH {ARTICLE_SQL}, c AS (SELECT article_id, trim(regexp_replace(regexp_replace(regexp_replace(content, '\\s+', ' ', 'g'), '\\[.*?\\]', '', 'g'), 'https?://\\S+', '', 'g')) AS x FROM article),
s AS (SELECT article_id, unnest(a) AS s, generate_subscripts(a, 1) AS pos FROM (SELECT article_id, string_split(regexp_replace(x, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS a FROM c)),
r AS (SELECT article_id, s, pos, row_number() OVER (PARTITION BY article_id ORDER BY pos) AS rn FROM s WHERE length(s) > 20 AND length(s) < 200),
f AS (SELECT article_id, substring(string_agg(s, ' ' ORDER BY pos), 1, 300) AS summary FROM r WHERE rn <= 3 GROUP BY 1)
SELECT a.article_id, coalesce(f.summary, 'Summary not available.') AS summary FROM article a LEFT JOIN f USING (article_id)""")
def extractive_summary(spark, sf_dir):
    return bare_articles(spark, sf_dir).select("article_id", text.extractive_summary(F.col("content")).alias("summary"))


@query(f"""WITH {ARTICLE_SQL}, t AS (SELECT article_id, trim(content) AS x FROM article)
SELECT article_id, CASE WHEN length(x) < 100 THEN 'too short' WHEN length(x) < 200 THEN 'brief' WHEN len(regexp_split_to_array(x, '\\s+')) < 30 THEN 'too few words' ELSE 'ok' END AS reason FROM t""")
def summarizable(spark, sf_dir):
    return bare_articles(spark, sf_dir).select("article_id", text.summarizable(F.col("content"))["reason"].alias("reason"))


@query("SELECT role, count(*) AS turns, CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) AS BIGINT) AS tokens FROM conversations GROUP BY 1")
def token_budget(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.sum(text.token_estimate(F.col("text"))).alias("tokens"))


@query(f"SELECT count(*) AS articles, CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) AS BIGINT) AS tokens, {sql_rounded('sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) * 0.5::DOUBLE / 1000')} AS cost FROM conversations")
def ai_usage(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(text.token_estimate(F.col("text")).alias("tokens"))
    return runs.ai_usage(rows, 0.25, 0.75).select("articles", "tokens", rounded(F.col("cost")).alias("cost"))


# ---- duplicates -------------------------------------------------------------------------------------------------
def _matches(key: str) -> str:
    return f"WITH {ARTICLE_SQL}, k AS (SELECT article_id, {key} AS k FROM article), f AS (SELECT k, min(article_id) AS first_id FROM k GROUP BY 1) SELECT article_id, first_id FROM k JOIN f USING (k) WHERE article_id > first_id"


@query(_matches(_URL_KEY))
def dup_by_url(spark, sf_dir):
    return dedupe.matches_on(dedupe.keyed(articles(spark, sf_dir)), "url_key")


@query(_matches(_FINGERPRINT))
def dup_by_fingerprint(spark, sf_dir):
    return dedupe.matches_on(dedupe.keyed(articles(spark, sf_dir)), "fingerprint")


_TITLES = f""", w AS (SELECT article_id, title, unnest(regexp_split_to_array(trim(regexp_replace(lower(title), '[^\\w\\s]', '', 'g')), '\\s+')) AS x FROM article),
ws AS (SELECT article_id, title, list_sort(list_distinct(list(x))) AS s FROM w WHERE length(x) > 2 GROUP BY 1, 2),
wp AS (SELECT article_id, unnest(a) AS x, generate_subscripts(a, 1) AS pos FROM (SELECT article_id, regexp_split_to_array(trim(regexp_replace(lower(title), '[^\\w\\s]', '', 'g')), '\\s+') AS a FROM article)),
bk AS (SELECT article_id, arg_min(x, pos) AS b FROM wp WHERE length(x) > 2 AND x NOT IN ({', '.join(map(quoted, config.BUCKET_STOPS))}) GROUP BY 1),
sets AS (SELECT coalesce(b, lower(substring(title, 1, 5))) AS bucket, s, min(ws.article_id) AS id FROM ws LEFT JOIN bk USING (article_id) GROUP BY 1, 2)"""


@query(f"""WITH {ARTICLE_SQL}{_TITLES}, p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) AS n FROM sets a JOIN sets b ON a.bucket = b.bucket AND a.id < b.id)
SELECT a, b, {sql_rounded('i / (n - i)::DOUBLE')} AS similarity FROM p WHERE i / (n - i)::DOUBLE >= 0.85""")
def dup_by_title(spark, sf_dir):
    return dedupe.title_pairs(dedupe.keyed(articles(spark, sf_dir))).withColumn("similarity", rounded(F.col("similarity")))


def sql_fold(rows: str, stored: str) -> str:
    """CTEs that fold over `rows` (ord, u, f, bucket, s; to be judged, in order of ord) one by one: kept is the list of ords
    stored so far, at first those of `stored`. v has ord, match_type and matched (ord). Rows of `stored` come first."""
    jac = "len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))::DOUBLE >= 0.85"
    return f"""every_row AS MATERIALIZED (SELECT ord, u, f, bucket, s FROM {stored} UNION ALL SELECT ord, u, f, bucket, s FROM {rows}),
mu AS (SELECT b.ord, list(a.ord) AS l FROM every_row a JOIN {rows} b ON a.u = b.u AND a.ord < b.ord GROUP BY 1), mf AS (SELECT b.ord, list(a.ord) AS l FROM every_row a JOIN {rows} b ON a.f = b.f AND a.ord < b.ord GROUP BY 1),
mt AS (SELECT b.ord, list(a.ord) AS l FROM every_row a JOIN {rows} b ON a.bucket = b.bucket AND a.ord < b.ord AND len(a.s) > 0 AND len(b.s) > 0 AND {jac} GROUP BY 1),
row_of AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ord) AS n, ord, coalesce(mu.l, []) AS lu, coalesce(mf.l, []) AS lf, coalesce(mt.l, []) AS lt FROM {rows} LEFT JOIN mu USING (ord) LEFT JOIN mf USING (ord) LEFT JOIN mt USING (ord)),
fold AS (SELECT CAST(0 AS BIGINT) AS n, (SELECT coalesce(list(ord), []) FROM {stored}) AS kept
  UNION ALL SELECT r.n, CASE WHEN list_has_any(kept, list_concat(lu, lf, lt)) THEN kept ELSE list_append(kept, ord) END FROM fold JOIN row_of r ON r.n = fold.n + 1),
fin AS (SELECT kept FROM fold ORDER BY n DESC LIMIT 1),
hit AS (SELECT ord, list_min(list_intersect(lu, kept)) AS iu, list_min(list_intersect(lf, kept)) AS jf, list_min(list_intersect(lt, kept)) AS jt FROM row_of, fin),
v AS (SELECT ord, CASE WHEN iu IS NOT NULL THEN 'url' WHEN jf IS NOT NULL THEN 'content' WHEN jt IS NOT NULL THEN 'title' ELSE 'none' END AS match_type, coalesce(iu, jf, jt) AS matched FROM hit)"""


@query(f"""WITH RECURSIVE {ARTICLE_SQL}{_TITLES}, k AS MATERIALIZED (SELECT article_id AS ord, {_URL_KEY} AS u, {_FINGERPRINT} AS f, coalesce(b, lower(substring(title, 1, 5))) AS bucket, coalesce(ws.s, []) AS s
  FROM article LEFT JOIN (SELECT article_id, s FROM ws) ws USING (article_id) LEFT JOIN bk USING (article_id)),
no_row AS (SELECT * FROM k WHERE false), {sql_fold('k', 'no_row')}
SELECT ord AS article_id, match_type, coalesce(matched, -1) AS matched_id FROM v""")
def ingest_verdict(spark, sf_dir):
    return dedupe.verdicts(dedupe.keyed(articles(spark, sf_dir))).withColumn("matched_id", F.coalesce("matched_id", F.lit(-1))).drop("in_batch")


@query("""WITH k AS (SELECT source AS source_name, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY md5(text)) THEN 'content' ELSE 'none' END AS m FROM documents)
SELECT source_name, count(*) AS fetched, count(*) FILTER (m = 'none') AS added, count(*) FILTER (m <> 'none') AS duplicates FROM k GROUP BY ROLLUP (source_name)""")
def ingest_totals(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("k"))
    first = d.groupBy("k").agg(F.min("doc_id").alias("f"))
    rows = d.join(first, "k").select(F.col("source").alias("source_name"), F.when(F.col("doc_id") > F.col("f"), "content").otherwise("none").alias("match_type"))
    return runs.ingest_totals(rows)


# ---- similarity -------------------------------------------------------------------------------------------------
def _sql_tokens(column: str) -> str:
    return f"unnest(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower({column}), 'https?://\\S+', '', 'g'), '[^\\w\\s'']', ' ', 'g'), '\\s+', ' ', 'g')), ' '))"


_KEEP = f"length(t) > 2 AND length(t) < 30 AND t NOT IN ({', '.join(map(quoted, config.STOP_WORDS))}) AND NOT regexp_full_match(t, '\\d+')"
_IDF = f"""tok AS (SELECT DISTINCT article_id, t FROM (SELECT article_id, {_sql_tokens("concat_ws(' ', title, substring(content, 1, 500))")} AS t FROM article) WHERE {_KEEP}),
n AS (SELECT count(*) AS docs FROM article), df AS (SELECT t AS term, count(*) AS df FROM tok GROUP BY 1),
idf AS (SELECT term, df, ln((docs + 1) / (df + 1)::DOUBLE) + 1 AS idf FROM df, n)"""


@query(f"WITH {ARTICLE_SQL}, {_IDF} SELECT term, df, {sql_rounded('idf')} AS idf FROM idf")
def idf(spark, sf_dir):
    return similarity.idf_table(bare_articles(spark, sf_dir)).select("term", "df", rounded(F.col("idf")).alias("idf"))


@query(f"WITH {ARTICLE_SQL}, {_IDF} SELECT count(*) AS vocabulary, (SELECT docs FROM n) AS documents FROM df")
def corpus_stats(spark, sf_dir):
    return similarity.corpus_stats(bare_articles(spark, sf_dir))


_BOOST = f"CASE WHEN t IN ({', '.join(map(quoted, config.BOOST_TERMS))}) THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END"


@query(f"WITH {ARTICLE_SQL}, c AS (SELECT article_id, t, count(*) AS n FROM (SELECT article_id, {_sql_tokens('title')} AS t FROM article) WHERE {_KEEP} GROUP BY 1, 2) SELECT article_id, t AS term, {sql_rounded(f'(1 + ln(n)) * {_BOOST} * 2')} AS w FROM c")
def title_vectors(spark, sf_dir):
    return similarity.title_vectors(bare_articles(spark, sf_dir)).select("article_id", "term", rounded(F.col("w")).alias("w"))


_PAIRS = f""", ti AS (SELECT title, min(article_id) AS id, max(article_id) AS last FROM article GROUP BY 1),
tt AS (SELECT DISTINCT id, t FROM (SELECT id, {_sql_tokens('title')} AS t FROM ti) WHERE {_KEEP}), tn AS (SELECT id, count(*) AS n FROM tt GROUP BY 1),
bw AS (SELECT id, unnest(a) AS x, generate_subscripts(a, 1) AS pos FROM (SELECT id, regexp_split_to_array(trim(regexp_replace(lower(title), '[^\\w\\s]', '', 'g')), '\\s+') AS a FROM ti)),
b1 AS (SELECT id, arg_min(x, pos) AS b FROM bw WHERE length(x) > 2 AND x NOT IN ({', '.join(map(quoted, config.CLUSTER_BUCKET_STOPS))}) GROUP BY 1),
bu AS (SELECT ti.id, coalesce(b, lower(substring(title, 1, 5))) AS b FROM ti LEFT JOIN b1 USING (id)),
pr AS (SELECT id, b FROM bu UNION SELECT id, x FROM (SELECT id, unnest(a) AS x, generate_subscripts(a, 1) AS pos FROM (SELECT id, string_split(lower(title), ' ') AS a FROM ti)) WHERE pos <= 3 AND length(x) > 3),
cand AS (SELECT DISTINCT least(pr.id, bu.id) AS a, greatest(pr.id, bu.id) AS b FROM pr JOIN bu ON pr.b = bu.b AND pr.id <> bu.id JOIN ti l ON l.id = bu.id WHERE pr.id < l.last),
inter AS (SELECT c.a, c.b, count(*) AS i FROM cand c JOIN tt x ON x.id = c.a JOIN tt y ON y.id = c.b AND y.t = x.t GROUP BY 1, 2),
jac AS (SELECT a, b, i / (x.n + y.n - i)::DOUBLE AS jaccard FROM inter JOIN tn x ON x.id = a JOIN tn y ON y.id = b WHERE i / (x.n + y.n - i)::DOUBLE >= 0.3)"""


@query(f"WITH {ARTICLE_SQL}{_PAIRS} SELECT a, b, {sql_rounded('jaccard')} AS jaccard FROM jac")
def pair_jaccard(spark, sf_dir):
    pairs = similarity.candidate_pairs(similarity.distinct_titles(bare_articles(spark, sf_dir)))
    return pairs.select("a", "b", rounded(F.col("jaccard")).alias("jaccard"))


_COSINE = f""", vec AS (SELECT id, t, (1 + ln(count(*))) * {_BOOST} * 2 AS w FROM (SELECT id, {_sql_tokens('title')} AS t FROM ti) WHERE {_KEEP} GROUP BY 1, 2), nv AS (SELECT id, sqrt(sum(w * w)) AS norm FROM vec GROUP BY 1),
cos AS (SELECT j.a, j.b, sum(x.w * y.w) / (any_value(m.norm) * any_value(n2.norm)) AS cosine FROM jac j JOIN vec x ON x.id = j.a JOIN vec y ON y.id = j.b AND y.t = x.t JOIN nv m ON m.id = j.a JOIN nv n2 ON n2.id = j.b GROUP BY 1, 2)"""


@query(f"WITH {ARTICLE_SQL}{_PAIRS}{_COSINE} SELECT a, b, {sql_rounded('cosine')} AS cosine FROM cos")
def pair_cosine(spark, sf_dir):
    pairs = similarity.candidate_pairs(similarity.distinct_titles(bare_articles(spark, sf_dir)))
    return pairs.select("a", "b", rounded(F.col("cosine")).alias("cosine"))


_NGRAMS = ", g AS (SELECT DISTINCT id, substring(x, i, 3) AS g FROM (SELECT id, x, unnest(generate_series(1, length(x) - 2)) AS i FROM (SELECT id, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS x FROM ti))), gn AS (SELECT id, count(*) AS n FROM g GROUP BY 1)"


@query(f"WITH {ARTICLE_SQL}{_PAIRS}{_NGRAMS}, i AS (SELECT j.a, j.b, count(y.g) AS i FROM jac j JOIN g x ON x.id = j.a LEFT JOIN g y ON y.id = j.b AND y.g = x.g GROUP BY 1, 2) SELECT a, b, {sql_rounded('i / (m.n + k.n - i)::DOUBLE')} AS ngram FROM i JOIN gn m ON m.id = a JOIN gn k ON k.id = b")
def pair_ngram(spark, sf_dir):
    titles = similarity.distinct_titles(bare_articles(spark, sf_dir))
    g = titles.select("id", text.char_ngrams(F.col("title")).alias("g"))
    pairs = similarity.candidate_pairs(titles).join(g.selectExpr("id a", "g ga"), "a").join(g.selectExpr("id b", "g gb"), "b")
    return pairs.select("a", "b", rounded(text.jaccard(F.col("ga"), F.col("gb"))).alias("ngram"))


# ---- engagement -------------------------------------------------------------------------------------------------
_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"


@query(f"SELECT {_K} AS article_id, count(*) FILTER (event_type = 'view') AS view_count, count(*) FILTER (event_type = 'purchase') AS bookmark_count FROM events GROUP BY 1")
def engagement_counters(spark, sf_dir):
    from newslake.views import counters

    return counters(table(spark, sf_dir, "events"))


def _bookmarks(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    folder = F.when(F.col("value") < 20, "General").when(F.col("value") < 60, "Later").otherwise("Work")
    return e.select("user_id", key_number(F.col("props")).alias("article_id"), folder.alias("folder"), "ts")


@query(f"SELECT user_id, {_K} AS article_id, count(*) % 2 = 1 AS bookmarked FROM events WHERE event_type = 'purchase' GROUP BY 1, 2")
def bookmark_state(spark, sf_dir):
    return engagement.bookmark_state(_bookmarks(spark, sf_dir))


@query("SELECT user_id, CASE WHEN value < 20 THEN 'General' WHEN value < 60 THEN 'Later' ELSE 'Work' END AS folder, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2")
def folder_counts(spark, sf_dir):
    return engagement.folder_counts(_bookmarks(spark, sf_dir))


@query(f"WITH v AS (SELECT DISTINCT user_id, {_K} AS article_id FROM events WHERE event_type = 'view'), b AS (SELECT DISTINCT user_id, {_K} AS article_id, TRUE AS m FROM events WHERE event_type = 'purchase') SELECT user_id, article_id, coalesce(m, FALSE) AS bookmarked FROM v LEFT JOIN b USING (user_id, article_id)")
def bulk_bookmarked(spark, sf_dir):
    ids = table(spark, sf_dir, "events").where("event_type = 'view'").select("user_id", key_number(F.col("props")).alias("article_id")).distinct()
    return engagement.bulk_bookmarked(ids, _bookmarks(spark, sf_dir))


@query(f"WITH l AS (SELECT user_id, {_K} AS article_id, max(ts) AS read_at FROM events WHERE event_type = 'view' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY read_at DESC, article_id) AS pos FROM l) SELECT user_id, article_id, pos FROM r WHERE pos <= 100")
def read_history(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'view'").select("user_id", key_number(F.col("props")).alias("article_id"), F.col("ts").alias("read_at"))
    return engagement.read_history(e).select("user_id", "article_id", F.col("pos").cast("long").alias("pos"))


@query(f"WITH e AS (SELECT 't' || {_K} AS token, user_id, event_type = 'signup' AS reg, row_number() OVER (PARTITION BY {_K} ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type IN ('signup', 'error')) SELECT token, user_id FROM e WHERE rn = 1 AND reg")
def token_owner(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type in ('signup', 'error')")
    op = F.when(F.col("event_type") == "signup", "register").otherwise("unregister")
    return engagement.token_owner(e.select(F.concat(F.lit("t"), key_number(F.col("props")).cast("string")).alias("token"), "user_id", op.alias("op"), "ts", "event_id"))


_RECIPIENTS = f", rec AS (SELECT * FROM app_user WHERE is_active AND notifications_enabled AND abs(pref_hour - hour({NOW})) <= 1)"


@query(f"WITH {USERS_SQL}{_RECIPIENTS} SELECT user_id, category FROM rec")
def recipients(spark, sf_dir):
    return engagement.recipients(users(spark, sf_dir), as_of()).select("user_id", "category")


@query(f"WITH {USERS_SQL}{_RECIPIENTS} SELECT t1 AS token FROM rec UNION SELECT t2 FROM rec")
def distinct_tokens(spark, sf_dir):
    return engagement.distinct_tokens(engagement.recipients(users(spark, sf_dir), as_of()))


@query(f"WITH {USERS_SQL}, {ARTICLE_SQL}, uc AS (SELECT user_id, category FROM app_user WHERE is_active AND notifications_enabled UNION ALL SELECT user_id, second_category FROM app_user WHERE is_active AND notifications_enabled AND second_category IS NOT NULL), n AS (SELECT category, count(*) AS n FROM uc GROUP BY 1) SELECT article_id, coalesce(n, 0) AS audience FROM article LEFT JOIN n ON category = category_slug")
def topic_audience(spark, sf_dir):
    return engagement.topic_audience(bare_articles(spark, sf_dir), users(spark, sf_dir), as_of())


@query(f"WITH {USERS_SQL}, t AS (SELECT t1 AS t FROM app_user UNION SELECT t2 FROM app_user), n AS (SELECT count(*) AS n FROM t), w AS (SELECT unnest(generate_series(0, (n - 1) // 500)) AS wave, n FROM n) SELECT CAST(wave AS BIGINT) AS wave, CAST(least(500, n - wave * 500) AS BIGINT) AS tokens FROM w")
def send_waves(spark, sf_dir):
    waves = engagement.send_waves(engagement.distinct_tokens(users(spark, sf_dir)))
    return waves.groupBy("wave").agg(F.count("*").alias("tokens"))


# ---- notifications ----------------------------------------------------------------------------------------------
def _breaking(spark, sf_dir):
    return articles(spark, sf_dir).withColumn("score", (F.col("article_id") % 100).cast("double"))


_BREAKING_SQL = f"""WITH {ARTICLE_SQL}, b AS (SELECT article_id, published_at, article_id % 100 + 5 * ({' + '.join(f"CASE WHEN contains(lower(title), {quoted(k)}) THEN 1 ELSE 0 END" for k in config.BREAKING_KEYWORDS)})
  + CASE WHEN (epoch({NOW}) - epoch(published_at)) / 3600.0 < 2 THEN 10 ELSE 0 END + CASE WHEN view_count > 1000 THEN 5 ELSE 0 END + CASE WHEN bookmark_count > 50 THEN 5 ELSE 0 END
  + CASE WHEN {' OR '.join(f'contains(source_name, {quoted(x)})' for x in config.BREAKING_SOURCES)} THEN 10 ELSE 0 END AS s FROM article)"""


@query(f"{_BREAKING_SQL} SELECT article_id, CAST(s AS DOUBLE) AS breaking_score, s >= 85 AS is_breaking FROM b")
def breaking_scores(spark, sf_dir):
    return notify.breaking_scores(_breaking(spark, sf_dir), as_of()).select("article_id", "breaking_score", "is_breaking")


@query(f"{_BREAKING_SQL}, c AS (SELECT * FROM b WHERE published_at >= {NOW} - INTERVAL 1 HOUR ORDER BY published_at DESC, article_id % 100 DESC, article_id LIMIT 20) SELECT article_id, CAST(s AS DOUBLE) AS breaking_score FROM c ORDER BY s DESC, published_at DESC, article_id LIMIT 1")
def breaking_best(spark, sf_dir):
    return notify.breaking_best(_breaking(spark, sf_dir), as_of()).select("article_id", "breaking_score")


@query(f"""WITH {ARTICLE_SQL}{SCORED_SQL}, t AS (SELECT * FROM scored WHERE published_at >= {NOW} - INTERVAL 24 HOUR ORDER BY final_score DESC, article_id LIMIT 10),
d AS (SELECT string_agg(CAST(article_id AS VARCHAR), ',' ORDER BY final_score DESC, article_id) AS article_ids, concat(count(*), ' top stories today: ', arg_min(title, struct_pack(a := -final_score, b := article_id)), CASE WHEN count(*) > 1 THEN ' and more' ELSE '' END) AS x FROM t),
c AS (SELECT string_agg(category_slug, ',' ORDER BY s DESC, i) AS categories FROM (SELECT category_slug, max(final_score) AS s, arg_min(article_id, struct_pack(a := -final_score, b := article_id)) AS i FROM t GROUP BY 1))
SELECT article_ids, categories, substring(x, 1, 150) AS body FROM d, c""")
def digest_payload(spark, sf_dir):
    return notify.digest(scored(spark, sf_dir), as_of()).select("article_ids", "categories", "body")


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "failed").otherwise("sent")
    return e.select(F.col("event_id").alias("notification_id"), F.col("event_type").alias("type"), status.alias("status"), F.col("ts").alias("created_at"), F.floor("value").alias("success_count"), F.lit(0).cast("long").alias("failure_count"))


_LOG_STATS = "count(*) AS n, CAST(coalesce(sum(CAST(floor(value) AS BIGINT)), 0) AS BIGINT) AS successes, CAST(0 AS BIGINT) AS failures"
_LOG_ROWS = "FROM (SELECT *, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'sent' END AS status FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00')"


@query(f"SELECT event_type AS type, status, {_LOG_STATS} {_LOG_ROWS} GROUP BY 1, 2 UNION ALL SELECT NULL, NULL, {_LOG_STATS} {_LOG_ROWS}")
def notification_stats(spark, sf_dir):
    at = lambda x: F.lit(x).cast("timestamp")
    return notify.notification_stats(_log(spark, sf_dir), at("2024-01-05 00:00:00"), at("2024-01-20 00:00:00"))


@query("SELECT event_id AS notification_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR ORDER BY ts, event_id LIMIT 50")
def retry_plan(spark, sf_dir):
    return notify.retry_plan(_log(spark, sf_dir), F.lit("2024-01-20 00:00:00").cast("timestamp")).select("notification_id")


# ---- runs -------------------------------------------------------------------------------------------------------
def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.floor(F.col("event_id") / 5).alias("run_id"), F.col("event_type").alias("stage"), (F.col("value") > 25).alias("success"), F.col("value").alias("duration"))


@query(f"SELECT event_type AS stage, count(*) AS runs, count(*) FILTER (value > 25) AS successes, count(*) FILTER (NOT value > 25) AS failures, {sql_mean4('avg(value)')} AS avg_duration FROM events GROUP BY 1")
def stage_metrics(spark, sf_dir):
    return runs.stage_metrics(_runs(spark, sf_dir)).withColumn("avg_duration", mean4(F.col("avg_duration")))


@query("SELECT event_id // 5 AS run_id, count(*) AS stages, count(*) FILTER (value > 25) AS succeeded, CASE WHEN count(*) FILTER (value > 25) = count(*) THEN 'completed' WHEN count(*) FILTER (value > 25) = 0 THEN 'failed' ELSE 'partial' END AS status FROM events GROUP BY 1")
def run_summary(spark, sf_dir):
    return runs.run_summary(_runs(spark, sf_dir)).select("run_id", "stages", "succeeded", "status")


@query("WITH l AS (SELECT event_type AS stage, max(event_id) FILTER (value > 25) AS ok FROM events GROUP BY 1), s AS (SELECT stage, count(*) FILTER (ok IS NULL OR event_id > ok) AS streak FROM events JOIN l ON stage = event_type GROUP BY 1) SELECT stage, streak, streak < 3 AS healthy FROM s")
def failure_streak(spark, sf_dir):
    return runs.failure_streak(_runs(spark, sf_dir))


@query(f"SELECT event_id, {sql_mean4('avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS mean_duration FROM events")
def running_mean(spark, sf_dir):
    return runs.running_mean(_runs(spark, sf_dir)).select("event_id", mean4(F.col("mean_duration")).alias("mean_duration"))


@query(f"SELECT user_id, {sql_day("time_bucket(INTERVAL 15 MINUTE, ts)")} AS window_start, count(*) AS n, count(*) > 2 AS blocked FROM events GROUP BY 1, time_bucket(INTERVAL 15 MINUTE, ts)")
def quota_tumbling(spark, sf_dir):
    return runs.quota(table(spark, sf_dir, "events"), 2).withColumn("window_start", day("window_start"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS rate FROM events")
def rate_trailing(spark, sf_dir):
    return runs.trailing_rate(table(spark, sf_dir, "events"), 3600).select("event_id", "rate")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS rate FROM events")
def rate_last_minute(spark, sf_dir):
    return runs.trailing_rate(table(spark, sf_dir, "events")).select("event_id", "rate")


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2")
def daily_quota(spark, sf_dir):
    return runs.daily(table(spark, sf_dir, "events")).withColumn("day", F.col("day").cast("string"))


@query(f"WITH {ARTICLE_SQL} SELECT article_id FROM article WHERE published_at >= {NOW} - INTERVAL 2 DAY")
def retention(spark, sf_dir):
    return runs.retained(bare_articles(spark, sf_dir), as_of() - F.expr("INTERVAL 2 DAYS")).select("article_id")


@query(f"SELECT o_orderkey, {sql_day(f"CASE WHEN o_orderdate > {NOW} OR o_orderdate < {NOW} - INTERVAL 365 DAY THEN {NOW} ELSE o_orderdate END")} AS at FROM orders")
def late_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.date_format(text.normalize_date(F.col("o_orderdate").cast("timestamp"), as_of()), "yyyy-MM-dd HH:mm:ss").alias("at"))
