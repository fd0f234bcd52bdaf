"""Registered queries of ingest: clean rows, tags and categories, the verdict against the store, totals, older mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from newslake import config
from newslake.functions import text, urls
from newslake.operators import dedupe, ingest, serving
from newslake.operators.checkpoints import reliable
from newslake.plans.queries import _FINGERPRINT, _HOST, _STRIP, _URL_KEY, _sql_chain, day, query, quoted, sql_day, sql_fold, sql_hits
from newslake.plans.serving import CATEGORY_SQL, _case
from newslake.sources import page_text
from newslake.views import ARTICLE_SQL, articles, as_of, bare_articles, table

#: Articles from here on are the batch, the others the store.
CUT = "2024-01-30 12:00:00"
FIRST_PAGE = 10_000_000_000
EXTRA = ("tion",)


def _store(spark, sf_dir):
    return articles(spark, sf_dir).where(f"published_at < timestamp'{CUT}'")


def _raw(spark, sf_dir):
    """The newer articles and all pages, as two sources."""
    a = articles(spark, sf_dir).where(f"published_at >= timestamp'{CUT}'")
    i = F.col("article_id")
    news = a.select(
        i.alias("raw_id"), "title", F.col("source_url").alias("url"), "content", F.lit("").alias("summary"), "source_name", F.col("source_name").alias("source_id"),
        F.when(i % 11 == 0, as_of() + F.expr("INTERVAL 1 DAY")).otherwise(F.col("published_at")).alias("published_at"), F.concat(F.lit("  by "), i.cast("string"), F.lit(" ")).alias("author"),
        F.when(i % 4 == 0, F.concat(F.lit("https://img.example.com/placeholder"), i.cast("string"))).otherwise(F.concat(F.lit("https://img.example.com/"), i.cast("string"))).alias("image_url"), F.array("category_slug").alias("categories"),
    )
    p = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    pages = p.select(
        (F.lit(FIRST_PAGE) + F.col("page_id")).alias("raw_id"), F.when(F.col("page_id") % 17 != 0, title).alias("title"), "url", F.col("html").alias("content"), F.lit("").alias("summary"), F.lit("pages").alias("source_name"),
        F.lit("techcrunch-pages").alias("source_id"), F.lit(None).cast("timestamp").alias("published_at"), F.array(F.lit("Technology")).alias("categories"),
    )
    return ingest.union_sources(news, pages)


def _sql_make_summary(x: str, most: int = 500) -> str:
    cut = f"substring({x}, 1, {most})"
    stop, space = f"length(regexp_extract({cut}, '^(.*[.!?])', 1, 's'))", f"length(regexp_extract({cut}, '^(.*) ', 1, 's'))"
    return f"CASE WHEN length({x}) <= {most} THEN {x} WHEN {stop} - 1 > {most * 0.6} THEN trim(substring({cut}, 1, {stop})) ELSE substring({cut}, 1, {space}) || '...' END"


_WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_COLLAPSED = lambda x: f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"
_PLAIN_TEXT = "trim(" + _sql_chain(f"trim({_STRIP.replace('html', 'content')})", [(p, "", "gi") for p in config.BOILERPLATE]) + ")"
_LIST = lambda values: "[" + ", ".join(map(quoted, values)) + "]"
_ORDERED = lambda x: f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"
_TAGS = f"list_concat(list_transform(cats, lambda c: lower(c)), list_filter({_LIST(config.TAG_KEYWORDS)}, lambda k: contains(lower(coalesce(raw_title, '')), k)), [source_id])"
_CATEGORY = "CASE " + " ".join(
    f"WHEN len(list_filter({_LIST(ks)}, lambda k: len(list_filter(terms, lambda t: contains(lower(t), k))) > 0)) > 0 THEN {quoted(slug)}" for slug, ks in config.CATEGORY_KEYWORDS.items()
) + " ELSE 'technology' END"
_TRUST = " OR ".join(f"contains(lower(source_id || ' ' || source_name), {quoted(x)})" for x in config.TECH_SOURCES)
_RAW_SQL = f"""WITH {ARTICLE_SQL}, raw AS (
  SELECT article_id AS raw_id, title, source_url AS url, content, source_name, source_name AS source_id, CASE WHEN article_id % 11 = 0 THEN TIMESTAMP '{config.AS_OF}' + INTERVAL 1 DAY ELSE published_at END AS published_at,
    'by ' || CAST(article_id AS VARCHAR) AS author, CASE WHEN article_id % 4 <> 0 THEN 'https://img.example.com/' || CAST(article_id AS VARCHAR) END AS image_url, [category_slug] AS cats FROM article WHERE published_at >= TIMESTAMP '{CUT}'
  UNION ALL SELECT {FIRST_PAGE} + page_id, CASE WHEN page_id % 17 <> 0 THEN regexp_extract(html, '<title>(.*?)</title>', 1, 's') END, url, html, 'pages', 'techcrunch-pages', NULL, NULL, NULL, ['Technology'] FROM pages),
tech AS (SELECT *, lower(concat_ws(' ', title, '', content)) AS low FROM raw),
scored AS (SELECT *, {sql_hits('low', {**dict.fromkeys(config.TECH_HIGH, 3), **{'tion': 3}})} + {sql_hits('low', dict.fromkeys(config.TECH_MEDIUM, 2))} + {sql_hits('low', dict.fromkeys(config.TECH_LOW, 1))} - ({sql_hits('low', dict.fromkeys(config.NON_TECH, 2))}) + CASE WHEN {_TRUST} THEN 5 ELSE 0 END AS points FROM tech),
c1 AS (SELECT raw_id AS article_id, title AS raw_title, substring({_COLLAPSED('title')}, 1, 300) AS title, {_PLAIN_TEXT} AS content, url AS source_url, source_name, source_id, image_url, author, cats,
  CASE WHEN published_at IS NULL OR published_at > TIMESTAMP '{config.AS_OF}' OR published_at < TIMESTAMP '{config.AS_OF}' - INTERVAL 365 DAY THEN TIMESTAMP '{config.AS_OF}' ELSE published_at END AS published_at FROM scored WHERE greatest(0.0::DOUBLE, least(1.0::DOUBLE, points / 30)) >= 0.15),
c2 AS (SELECT *, {_COLLAPSED('content')} AS flat, {_TAGS} AS all_tags FROM c1),
c3 AS (SELECT *, {_ORDERED('all_tags')}[1:10] AS tags FROM c2), c4 AS (SELECT *, list_concat(cats, tags) AS terms FROM c3),
clean AS (SELECT article_id, title, {_sql_make_summary('flat')} AS summary, content, source_url, source_name, image_url, author, {_CATEGORY} AS category_slug, array_to_string(tags, ',') AS tags, published_at,
  {_FINGERPRINT} AS fingerprint, CAST(greatest(1, least(30, ceil(len(regexp_split_to_array(trim(content), '\\s+')) / 200.0))) AS INTEGER) AS read_time FROM c4)"""


def _clean(spark, sf_dir):
    return ingest.clean_rows(ingest.tech_only(_raw(spark, sf_dir), EXTRA), as_of())


@query(f"{_RAW_SQL} SELECT article_id, title, md5(summary) AS summary_md5, md5(content) AS content_md5, source_url, image_url, author, category_slug, tags, {sql_day('published_at')} AS published, fingerprint, read_time FROM clean")
def clean_rows(spark, sf_dir):
    out = _clean(spark, sf_dir)
    return out.select(
        "article_id", "title", F.md5("summary").alias("summary_md5"), F.md5("content").alias("content_md5"), "source_url", "image_url", "author", "category_slug", F.array_join("tags", ",").alias("tags"),
        day("published_at").alias("published"), "fingerprint", "read_time",
    )


_BUCKET_WORDS = "regexp_split_to_array(trim(regexp_replace(lower(title), '[^\\w\\s]', '', 'g')), '\\s+')"
_VERDICT_SQL = f"""{_RAW_SQL.replace("WITH", "WITH RECURSIVE", 1)}, good AS (SELECT * FROM clean WHERE coalesce(title, '') <> '' AND coalesce(source_url, '') <> ''),
every AS (SELECT 0 AS part, article_id, title, content, source_url FROM article WHERE published_at < TIMESTAMP '{CUT}' UNION ALL SELECT 1, article_id, title, content, source_url FROM good),
k AS MATERIALIZED (SELECT part, article_id, title, part * 100000000000 + article_id AS ord, {_URL_KEY} AS u, {_FINGERPRINT} AS f, list_sort(list_distinct(list_filter({_BUCKET_WORDS}, lambda x: length(x) > 2))) AS s,
  coalesce(list_filter({_BUCKET_WORDS}, lambda x: length(x) > 2 AND NOT list_contains({_LIST(config.BUCKET_STOPS)}, x))[1], lower(substring(title, 1, 5))) AS bucket FROM every),
batch_row AS (SELECT * FROM k WHERE part = 1), store_row AS (SELECT * FROM k WHERE part = 0), {sql_fold('batch_row', 'store_row')},
judged AS (SELECT article_id, match_type, matched AS o FROM v JOIN batch_row USING (ord)),
ing AS (SELECT clean.*, coalesce(match_type, 'error') AS match_type, CASE WHEN o < 100000000000 THEN o END AS matched_id, CASE WHEN o >= 100000000000 THEN o - 100000000000 END AS matched_raw_id FROM clean LEFT JOIN judged USING (article_id))"""


def ingested(spark, sf_dir):
    return ingest.ingest(_raw(spark, sf_dir), _store(spark, sf_dir), as_of(), EXTRA)


@query(f"{_VERDICT_SQL} SELECT article_id, match_type, matched_id, matched_raw_id FROM ing")
def ingest_job(spark, sf_dir):
    return ingested(spark, sf_dir).select("article_id", "match_type", "matched_id", "matched_raw_id")


@query(f"{_VERDICT_SQL} SELECT article_id, title, md5(content) AS content_md5, category_slug, score, is_featured, view_count FROM (SELECT *, 0.0::DOUBLE AS score, FALSE AS is_featured, CAST(0 AS BIGINT) AS view_count, min(article_id) OVER (PARTITION BY source_url) AS first FROM ing WHERE match_type = 'none') WHERE first = article_id")
def ingest_added(spark, sf_dir):
    return ingest.added(reliable(ingested(spark, sf_dir))).select("article_id", "title", F.md5("content").alias("content_md5"), "category_slug", "score", "is_featured", "view_count")


@query(f"{_VERDICT_SQL}, f AS (SELECT source_name, 'fetched' AS match_type FROM raw UNION ALL SELECT source_name, match_type FROM ing) SELECT coalesce(source_name, 'all') AS source_name, count(*) FILTER (match_type = 'fetched') AS fetched, count(*) FILTER (match_type = 'none') AS added, count(*) FILTER (match_type IN ('url', 'content', 'title')) AS duplicates, count(*) FILTER (match_type = 'error') AS errors FROM f GROUP BY ROLLUP (source_name)")
def ingest_run_totals(spark, sf_dir):
    return ingest.totals(_raw(spark, sf_dir), ingested(spark, sf_dir)).withColumn("source_name", F.coalesce("source_name", F.lit("all")))


_ADD = "SELECT DISTINCT category_slug AS slug FROM ing WHERE match_type = 'none'"
_CAT_NAME = "upper(substring(slug, 1, 1)) || substring(slug, 2)"


@query(f"{_VERDICT_SQL}{CATEGORY_SQL}, nw AS (SELECT slug FROM ({_ADD}) WHERE slug NOT IN (SELECT slug FROM seed)) SELECT slug, name, icon, color, sort_order FROM seed UNION ALL SELECT slug, {_CAT_NAME}, {_case('slug', config.CATEGORY_ICONS, config.CATEGORY_DEFAULT[0])}, {_case('slug', config.CATEGORY_COLORS, config.CATEGORY_DEFAULT[1])}, 99 FROM nw")
def ingest_categories(spark, sf_dir):
    return ingest.categories_after(serving.seed_categories(spark), ingested(spark, sf_dir)).select("slug", "name", "icon", "color", "sort_order")


@query(f"{_VERDICT_SQL} SELECT article_id, EXISTS (SELECT 1 FROM every e WHERE part = 0 AND e.source_url = g.source_url) AS is_stored FROM good g")
def stored_flags(spark, sf_dir):
    rows = _clean(spark, sf_dir).where("coalesce(title, '') <> '' and coalesce(source_url, '') <> ''")
    return dedupe.with_stored_flag(rows, _store(spark, sf_dir), "source_url").select("article_id", "is_stored")


@query(f"WITH {ARTICLE_SQL}, h AS (SELECT *, lower(concat_ws(' ', title, '', content)) AS low FROM article) SELECT article_id, array_to_string(list_filter({_LIST((*config.TECH_HIGH, *EXTRA, *config.TECH_MEDIUM, *config.TECH_LOW))}, lambda k: contains(low, k))[1:10], ',') AS keywords FROM h")
def tech_keywords(spark, sf_dir):
    x = text.tech_keywords(F.col("title"), F.lit(""), F.col("content"), EXTRA)
    return bare_articles(spark, sf_dir).select("article_id", F.array_join(x, ",").alias("keywords"))


@query(f"WITH {ARTICLE_SQL}, t AS (SELECT article_id, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS t, regexp_replace({_HOST}, '^(.*?)www\\.', '\\1') AS h FROM article) SELECT article_id, substring(sha256(concat(t, '|', h)), 1, 32) AS fp FROM t")
def title_domain_fingerprint(spark, sf_dir):
    return articles(spark, sf_dir).select("article_id", text.title_domain_fingerprint(F.col("title"), urls.host(F.col("source_url"))).alias("fp"))


_LEGACY_FP = f"substring(sha256(concat(trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')), '|', regexp_replace({_HOST}, '^(.*?)www\\.', '\\1'))), 1, 32)"


@query(f"""WITH {ARTICLE_SQL}, src AS (SELECT source_name, max(category_slug) AS category, source_name <> 'src3' AS is_active FROM article GROUP BY 1),
r AS (SELECT a.*, {_LEGACY_FP} AS fingerprint, s.category FROM article a JOIN src s USING (source_name) WHERE is_active),
n AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY source_url) AS rn FROM r WHERE published_at >= TIMESTAMP '{CUT}' AND fingerprint NOT IN (SELECT {_LEGACY_FP} FROM article WHERE published_at < TIMESTAMP '{CUT}'))
SELECT source_url, md5(CASE WHEN article_id % 2 = 0 THEN substring(title, 1, 50) ELSE substring(content, 1, 500) END) AS summary_md5, 'Source ' || source_name AS source_name, category AS category_slug, fingerprint, CAST(greatest(1, ceil(len(regexp_split_to_array(trim(content), '\\s+')) / 200.0)) AS INTEGER) AS read_time FROM n WHERE rn = 1""")
def legacy_ingest(spark, sf_dir):
    a = articles(spark, sf_dir)
    sources = a.groupBy(F.col("source_name").alias("source_id")).agg(F.max("category_slug").alias("category")).select("source_id", F.concat(F.lit("Source "), "source_id").alias("name"), "category", (F.col("source_id") != "src3").alias("is_active"))
    snippet = F.when(F.col("article_id") % 2 == 0, F.substring("title", 1, 50)).otherwise("")
    items = a.where(f"published_at >= timestamp'{CUT}'").select(F.col("source_name").alias("source_id"), "title", F.col("source_url").alias("link"), "content", snippet.alias("content_snippet"), F.col("published_at").alias("pub_date"), F.lit(None).cast("string").alias("creator"), F.lit(None).cast("array<string>").alias("categories"), F.lit(None).cast("string").alias("image_url"))
    store = _store(spark, sf_dir).select(text.title_domain_fingerprint(F.col("title"), urls.host(F.col("source_url"))).alias("fingerprint"))
    out = ingest.legacy_rows(items, sources, store)
    return out.select("source_url", F.md5("summary").alias("summary_md5"), "source_name", "category_slug", "fingerprint", "read_time")


@query()
def page_texts(spark, sf_dir):
    """The element-tree form; an HTML parser has no SQL, so tests compare it with a plain version."""
    x = page_text.page_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", x.alias("text"))
