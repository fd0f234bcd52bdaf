"""Registered queries of stories: clusters, canonical articles, members, duplicate decisions; with recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from newslake import config
from newslake.operators import notify, ranking, serving, similarity
from newslake.operators.checkpoints import reliable
from newslake.plans.queries import _BOOST, _CLUSTER_KEY, _COSINE, _IDF, _KEEP, _PAIRS, NOW, RULES, SCORED_SQL, _sql_tokens, day, query, rounded, sql_day, sql_lookup, sql_rounded
from newslake.sources import files, sinks, store
from newslake.views import ARTICLE_SQL, articles, as_of, table

#: The 72-hour window as the articles that the SQL of pairs works on.
_RECENT = f"WITH RECURSIVE {ARTICLE_SQL.replace('article AS', 'whole AS')}, article AS (SELECT * FROM whole WHERE published_at >= {NOW} - INTERVAL 72 HOUR)"
#: Cosines of contents, for pairs of articles ca (a, b).
_CONTENT = f""", {_IDF}, cn AS (SELECT article_id, t, count(*) AS n FROM (SELECT article_id, {_sql_tokens('content')} AS t FROM article) WHERE {_KEEP} GROUP BY 1, 2),
cv AS (SELECT article_id, t, (1 + ln(cn.n)) * {_BOOST} * coalesce(idf, ln((docs + 1) / 2.0::DOUBLE) + 1) AS w FROM cn LEFT JOIN idf ON term = t, n), cl AS (SELECT article_id, sqrt(sum(w * w)) AS norm FROM cv GROUP BY 1)"""
_LINKS = f"""{_RECENT}{_PAIRS}{_COSINE}{_CONTENT},
ca AS (SELECT x.article_id AS a, y.article_id AS b, cosine, length(x.content) > 100 AND length(y.content) > 100 AS long FROM cos JOIN ti p ON p.id = cos.a JOIN ti q ON q.id = cos.b JOIN article x ON x.title = p.title JOIN article y ON y.title = q.title WHERE cosine <= 0.9),
cd AS (SELECT ca.a, ca.b, sum(u.w * v.w) AS dot FROM ca JOIN cv u ON u.article_id = ca.a JOIN cv v ON v.article_id = ca.b AND v.t = u.t WHERE long GROUP BY 1, 2),
cc AS (SELECT ca.a, ca.b, CASE WHEN long THEN 0.7 * cosine + 0.3 * coalesce(dot / (l.norm * m.norm), 0) ELSE cosine END AS s FROM ca LEFT JOIN cd USING (a, b) LEFT JOIN cl l ON l.article_id = ca.a LEFT JOIN cl m ON m.article_id = ca.b),
lk AS (SELECT a, b FROM cos WHERE cosine > 0.9 UNION ALL SELECT a, b FROM cc WHERE s >= 0.8 UNION ALL SELECT ti.id, article_id FROM ti JOIN article USING (title) WHERE article_id <> ti.id AND ti.id IN (SELECT id FROM tt)),
both_ways AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk), reach AS (SELECT a AS node, a AS root FROM both_ways UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node WHERE r.root < e.b),
comp AS (SELECT node, min(root) AS root FROM reach GROUP BY 1), ids AS (SELECT root, substring(md5(string_agg(CAST(node AS VARCHAR), '|' ORDER BY CAST(node AS VARCHAR))), 1, 16) AS cluster_id FROM comp GROUP BY 1),
mem AS (SELECT a.*, cluster_id, CAST(article_id * 13 % 101 AS DOUBLE) AS score FROM comp JOIN ids USING (root) JOIN article a ON a.article_id = node)"""
_BEST = f"""{_LINKS}, fm AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY published_at, article_id) = 1 AS is_first FROM mem),
q AS (SELECT *, {sql_rounded(f"{sql_lookup('source_name', config.CANONICAL_AUTHORITY, 50)} * 0.40 + least(100.0::DOUBLE, length(content) / 50.0::DOUBLE) * 0.25 + CASE WHEN is_first THEN 15.0 ELSE 0.0 END + least(100.0::DOUBLE, log10(view_count + 1.0::DOUBLE) * 20 + log10(bookmark_count + 1.0::DOUBLE) * 30) * 0.20")} AS quality FROM fm),
best AS (SELECT cluster_id, arg_max(article_id, struct_pack(a := quality, b := -article_id)) AS canonical_id, count(*) AS size, min(published_at) AS first_published, max(published_at) AS last_published,
  string_agg(DISTINCT source_name, ',' ORDER BY source_name) AS sources, avg(score) AS average_score FROM q GROUP BY 1)"""


def _recent(spark, sf_dir):
    return ranking.window_scan(articles(spark, sf_dir), as_of())


def _grouped(spark, sf_dir):
    rows = _recent(spark, sf_dir)
    return rows, reliable(similarity.clusters(rows))


def _members(spark, sf_dir):
    rows, group = _grouped(spark, sf_dir)
    members = rows.join(group, "article_id").withColumn("score", ((F.col("article_id") * 13) % 101).cast("double"))
    return rows, members, similarity.canonical(members)


@query(f"{_LINKS} SELECT article_id, cluster_id FROM mem")
def clusters(spark, sf_dir):
    return _grouped(spark, sf_dir)[1].select("article_id", "cluster_id")


_BEST_OUT = f"cluster_id, canonical_id, size, {sql_day('first_published')} AS first_published, {sql_day('last_published')} AS last_published, sources, {sql_rounded('average_score')} AS average_score"


def _best_out(df):
    return df.select("cluster_id", "canonical_id", "size", day("first_published").alias("first_published"), day("last_published").alias("last_published"), "sources", rounded(F.col("average_score")).alias("average_score"))


@query(f"{_BEST} SELECT {_BEST_OUT} FROM best")
def canonical(spark, sf_dir):
    return _best_out(_members(spark, sf_dir)[2])


@query(f"{_BEST} SELECT {_BEST_OUT} FROM best WHERE size >= 2 ORDER BY size DESC, cluster_id LIMIT 50")
def cluster_list(spark, sf_dir):
    return _best_out(serving.cluster_list(_members(spark, sf_dir)[2]))


@query(f"""{_BEST}, pc AS (SELECT article_id AS a, canonical_id AS b FROM mem JOIN best USING (cluster_id) WHERE article_id <> canonical_id),
tw AS (SELECT article_id, t, (1 + ln(count(*))) * {_BOOST} * 2 AS w FROM (SELECT article_id, {_sql_tokens('title')} AS t FROM article) WHERE {_KEEP} GROUP BY 1, 2), tl AS (SELECT article_id, sqrt(sum(w * w)) AS norm FROM tw GROUP BY 1),
td AS (SELECT a, b, sum(u.w * v.w) AS dot FROM pc JOIN tw u ON u.article_id = a JOIN tw v ON v.article_id = b AND v.t = u.t GROUP BY 1, 2),
xd AS (SELECT a, b, sum(u.w * v.w) AS dot FROM pc JOIN cv u ON u.article_id = a JOIN cv v ON v.article_id = b AND v.t = u.t GROUP BY 1, 2),
sm AS (SELECT pc.a, pc.b, coalesce(td.dot / (l.norm * m.norm), 0) AS tc, coalesce(xd.dot / (c.norm * d.norm), 0) AS xc FROM pc LEFT JOIN td USING (a, b) LEFT JOIN xd USING (a, b) LEFT JOIN tl l ON l.article_id = pc.a LEFT JOIN tl m ON m.article_id = pc.b LEFT JOIN cl c ON c.article_id = pc.a LEFT JOIN cl d ON d.article_id = pc.b)
SELECT mem.article_id, cluster_id, canonical_id, {sql_rounded("CASE WHEN mem.article_id = canonical_id THEN 1.0::DOUBLE WHEN tc <= 0.9 AND length(mem.content) > 100 AND length(k.content) > 100 THEN 0.7 * tc + 0.3 * xc ELSE tc END")} AS similarity
FROM mem JOIN best USING (cluster_id) JOIN article k ON k.article_id = canonical_id LEFT JOIN sm ON sm.a = mem.article_id""")
def cluster_members(spark, sf_dir):
    rows, members, best = _members(spark, sf_dir)
    out = similarity.cluster_members(members, best, rows)
    return out.select("article_id", "cluster_id", "canonical_id", rounded(F.col("similarity_to_canonical")).alias("similarity"))


@query(f"{_LINKS} SELECT cluster_id, article_id, source_name, row_number() OVER (PARTITION BY cluster_id ORDER BY published_at, article_id) AS rank FROM mem")
def cluster_sources(spark, sf_dir):
    return similarity.merged_sources(_members(spark, sf_dir)[1]).select("cluster_id", "article_id", "source_name", F.col("rank").cast("long").alias("rank"))


@query(f"{_LINKS} SELECT (SELECT count(*) FROM article) AS articles, count(*) AS assigned, count(DISTINCT cluster_id) AS clusters, count(*) - count(DISTINCT cluster_id) AS duplicates FROM mem")
def cluster_run(spark, sf_dir):
    return similarity.cluster_run(*_grouped(spark, sf_dir))


_SOURCES = "0.2::DOUBLE * 0.20::DOUBLE AS comp_source"
_BY_SIZE = "(CASE WHEN related <= 1 THEN 0.2::DOUBLE WHEN related = 2 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, 0.5 + log10(related::DOUBLE) * 0.5) END) * 0.20::DOUBLE AS comp_source"


@query(f"""{_LINKS}, rel AS (SELECT article.*, coalesce(n, 1) AS related FROM article LEFT JOIN mem m USING (article_id) LEFT JOIN (SELECT cluster_id, count(*) AS n FROM mem GROUP BY 1) z ON z.cluster_id = m.cluster_id)
{SCORED_SQL.replace('FROM article', 'FROM rel').replace(_SOURCES, _BY_SIZE).replace('comp AS (', 'parts AS (').replace('FROM comp)', 'FROM parts)')} SELECT article_id, final_score, floor(final_score * 100 + 0.5) AS score FROM scored""")
def ranking_job(spark, sf_dir):
    """Clusters first, then ranking with their sizes."""
    rows, group = _grouped(spark, sf_dir)
    out = ranking.ranking_job(similarity.with_clusters(rows, group), as_of(), RULES)
    return out.select("article_id", "final_score", F.col("score").cast("double").alias("score"))


@query(f"""{_LINKS}, rel AS (SELECT article.*, coalesce(n, 1) AS related FROM article LEFT JOIN mem m USING (article_id) LEFT JOIN (SELECT cluster_id, count(*) AS n FROM mem GROUP BY 1) z ON z.cluster_id = m.cluster_id)
{SCORED_SQL.replace('FROM article', 'FROM rel').replace(_SOURCES, _BY_SIZE).replace('comp AS (', 'parts AS (').replace('FROM comp)', 'FROM parts)')}, every AS (SELECT doc_id AS article_id, TIMESTAMP '{config.AS_OF}' - INTERVAL '1' MINUTE * CAST((doc_id * 37) % 5760 AS INT) AS pub FROM documents),
feed AS (SELECT article_id, row_number() OVER (ORDER BY final_score DESC, article_id) AS rank FROM scored), top AS (SELECT article_id AS top_id FROM feed WHERE rank = 1)
SELECT e.article_id, coalesce(floor(final_score * 100 + 0.5), CAST(e.article_id * 13 % 101 AS DOUBLE)) AS score, CASE WHEN pub >= TIMESTAMP '{config.AS_OF}' - INTERVAL 24 HOUR THEN e.article_id = top_id ELSE e.article_id % 50 = 0 OR e.article_id = top_id END AS is_featured,
  CASE WHEN rank <= 10 THEN rank END AS rank, CASE WHEN rank <= 10 THEN strftime(TIMESTAMP '{config.AS_OF}', '%Y-%m-%d') END AS feed_date FROM every e LEFT JOIN scored s USING (article_id) LEFT JOIN feed f USING (article_id), top""")
def ranking_stored(spark, sf_dir):
    """The whole run on a store by day: clusters, ranks, scores and featured flags of the rows that change, the daily feed."""
    path, feeds = files.scratch(spark, "articles"), files.scratch(spark, "feeds")
    i = F.col("article_id")
    store.append(articles(spark, sf_dir).withColumns({"score": ((i * 13) % 101).cast("double"), "is_featured": i % 50 == 0}), path)
    group = reliable(similarity.clusters(store.window(spark, path, as_of(), 72).drop(store.DAY)))
    rows = similarity.with_clusters(spark.read.parquet(path).drop(store.DAY), group)
    changes, feed = ranking.ranking_run(rows, as_of(), RULES)
    store.update(spark, path, changes, "article_id", ["score", "is_featured"])
    sinks.write_daily_feed(feed, F.to_date(as_of()), feeds)
    top = spark.read.parquet(feeds).select("article_id", "rank", F.col("feed_date").cast("string").alias("feed_date"))
    return spark.read.parquet(path).select("article_id", "score", "is_featured").join(top, "article_id", "left")


_CUT = "TIMESTAMP '2024-01-30 12:00:00'"
_DECIDE = f"""WITH {ARTICLE_SQL.replace('article AS', 'whole AS')}, article AS (SELECT * FROM whole WHERE published_at < {_CUT}), batch AS (SELECT * FROM whole WHERE published_at >= {_CUT}),
{_IDF}, every AS (SELECT *, 0 AS part FROM article UNION ALL SELECT *, 1 FROM batch),
w0 AS (SELECT title, regexp_split_to_array(trim(regexp_replace(lower(title), '[^\\w\\s]', '', 'g')), '\\s+') AS x FROM (SELECT DISTINCT title FROM every)),
bu AS (SELECT title, coalesce(list_filter(x, lambda v: length(v) > 2 AND NOT list_contains([{', '.join("'" + x + "'" for x in config.CLUSTER_BUCKET_STOPS)}], v))[1], lower(substring(title, 1, 5))) AS b FROM w0),
pr AS (SELECT title, b FROM bu UNION SELECT title, v FROM (SELECT title, unnest(string_split(lower(title), ' ')[1:3]) AS v FROM w0) WHERE length(v) > 3),
tt AS (SELECT title, t, count(*) AS c, (1 + ln(count(*))) * {_BOOST} * 2 AS w FROM (SELECT title, {_sql_tokens('title')} AS t FROM w0) WHERE {_KEEP} GROUP BY 1, 2), tn AS (SELECT title, count(*) AS n, sqrt(sum(w * w)) AS norm FROM tt GROUP BY 1),
cand AS (SELECT DISTINCT p.title AS a, q.title AS b FROM pr p JOIN bu q ON p.b = q.b AND p.title <> q.title WHERE p.title IN (SELECT title FROM batch) AND q.title IN (SELECT title FROM article)),
pc AS (SELECT a, b, count(*) AS i, sum(x.w * y.w) AS dot FROM cand JOIN tt x ON x.title = a JOIN tt y ON y.title = b AND y.t = x.t GROUP BY 1, 2),
cs AS (SELECT a, b, dot / (x.norm * y.norm) AS cosine FROM pc JOIN tn x ON x.title = a JOIN tn y ON y.title = b WHERE i / (x.n + y.n - i)::DOUBLE >= 0.3),
cn AS (SELECT part, article_id, t, count(*) AS n FROM (SELECT part, article_id, {_sql_tokens('content')} AS t FROM every) WHERE {_KEEP} GROUP BY 1, 2, 3),
cv AS (SELECT part, article_id, t, (1 + ln(cn.n)) * {_BOOST} * coalesce(idf, ln((docs + 1) / 2.0::DOUBLE) + 1) AS w FROM cn LEFT JOIN idf ON term = t, n), cl AS (SELECT part, article_id, sqrt(sum(w * w)) AS norm FROM cv GROUP BY 1, 2),
ca AS (SELECT x.article_id AS a, y.article_id AS b, cosine, length(x.content) > 100 AND length(y.content) > 100 AND cosine <= 0.9 AS long FROM cs JOIN batch x ON x.title = cs.a JOIN article y ON y.title = cs.b),
cd AS (SELECT ca.a, ca.b, sum(u.w * v.w) AS dot FROM ca JOIN cv u ON u.article_id = ca.a AND u.part = 1 JOIN cv v ON v.article_id = ca.b AND v.part = 0 AND v.t = u.t WHERE long GROUP BY 1, 2),
sc AS (SELECT ca.a, ca.b, CASE WHEN long THEN 0.7 * cosine + 0.3 * coalesce(dot / (l.norm * m.norm), 0) ELSE cosine END AS s FROM ca LEFT JOIN cd USING (a, b) LEFT JOIN cl l ON l.article_id = ca.a AND l.part = 1 LEFT JOIN cl m ON m.article_id = ca.b AND m.part = 0),
top AS (SELECT a, max(s) AS s FROM sc GROUP BY 1), uk AS (SELECT {_CLUSTER_KEY} AS u, min(article_id) AS id FROM article GROUP BY 1), sm AS (SELECT title, min(article_id) AS id FROM article WHERE title IN (SELECT title FROM tt) GROUP BY 1),
f AS (SELECT batch.article_id, CASE WHEN uk.id IS NOT NULL OR sm.id IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(top.s, 0.0::DOUBLE) END AS s FROM batch LEFT JOIN uk ON uk.u = {_CLUSTER_KEY} LEFT JOIN sm USING (title) LEFT JOIN top ON top.a = batch.article_id)"""


@query(f"{_DECIDE} SELECT article_id, CASE WHEN s >= 0.95 THEN 'skip' WHEN s >= 0.8 THEN 'near' ELSE 'store_new' END AS action, {sql_rounded('s')} AS score, CASE WHEN s >= 0.95 THEN 'exact' WHEN s >= 0.8 THEN 'near' WHEN s >= 0.6 THEN 'related' END AS match_type FROM f")
def dup_decision(spark, sf_dir):
    """Whether a near match has a cluster depends on which of equal matches stands for it, so both actions read near here;
    cluster_decisions and the tests tell them apart."""
    out = similarity.duplicate_decisions(*_parts(spark, sf_dir))
    return out.select("article_id", F.regexp_replace("action", "add_to_cluster|create_cluster", "near").alias("action"), rounded(F.col("score")).alias("score"), "match_type")


def _parts(spark, sf_dir):
    rows = articles(spark, sf_dir)
    return rows.where("published_at >= timestamp'2024-01-30 12:00:00'"), rows.where("published_at < timestamp'2024-01-30 12:00:00'")


@query(f"{_DECIDE} SELECT action, count(*) AS n FROM (SELECT CASE WHEN s >= 0.95 THEN 'skip' WHEN s >= 0.8 THEN 'add_to_cluster' ELSE 'store_new' END AS action FROM f) GROUP BY 1")
def cluster_decisions(spark, sf_dir):
    """Every stored article has a cluster here, so near matches join one."""
    batch, store = _parts(spark, sf_dir)
    return similarity.duplicate_decisions(batch, store.withColumn("cluster_id", F.lit("c"))).groupBy("action").agg(F.count("*").alias("n"))


@query(f"""{_DECIDE}, ot AS (SELECT title, content, min(article_id) AS id FROM article GROUP BY 1, 2), oid AS (SELECT title, min(article_id) AS id FROM article GROUP BY 1),
al AS (SELECT x.article_id, CASE WHEN uk.id IS NOT NULL THEN uk.id END AS url_id, x.title FROM batch x LEFT JOIN uk ON uk.u = {_CLUSTER_KEY}),
mt AS (SELECT article_id, url_id AS m, 1.0::DOUBLE AS s FROM al WHERE url_id IS NOT NULL UNION ALL SELECT article_id, sm.id, 1.0 FROM al JOIN sm USING (title) WHERE url_id IS NULL
  UNION ALL SELECT al.article_id, oid.id, cosine FROM al JOIN cs ON cs.a = al.title JOIN oid ON oid.title = cs.b WHERE url_id IS NULL AND cosine > 0.9
  UNION ALL SELECT al.article_id, sc.b, sc.s FROM al JOIN sc ON sc.a = al.article_id JOIN ot ON ot.id = sc.b JOIN cs ON cs.a = al.title AND cs.b = ot.title WHERE url_id IS NULL AND cosine <= 0.9),
md AS (SELECT article_id, m, max(s) AS s FROM mt WHERE s >= 0.6 GROUP BY 1, 2)
SELECT article_id, m AS matched_id, {sql_rounded('s')} AS score, CASE WHEN s >= 0.95 THEN 'exact' WHEN s >= 0.8 THEN 'near' ELSE 'related' END AS match_type FROM md""")
def dup_matches(spark, sf_dir):
    out = similarity.duplicate_matches(*_parts(spark, sf_dir))
    return out.select("article_id", "matched_id", rounded(F.col("score")).alias("score"), "match_type")


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, ts FROM events WHERE event_type = 'purchase'),
f AS (SELECT key, min(ts) AS ts FROM e GROUP BY 1 UNION ALL SELECT f.key, min(e.ts) FROM f JOIN e ON e.key = f.key AND e.ts >= f.ts + INTERVAL 1 HOUR GROUP BY f.key)
SELECT key, CAST(floor(epoch(ts)) AS BIGINT) AS epoch FROM f""")
def breaking_cooldown(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return notify.cooldown(e.select(F.col("user_id").alias("key"), "ts"))


@query("""WITH RECURSIVE e AS (SELECT key, ts, bool_or(ok) AS ok FROM (SELECT user_id AS key, ts, event_id % 3 = 0 AS ok FROM events WHERE event_type = 'purchase') GROUP BY 1, 2),
f AS (SELECT key, min({'ts': ts, 'ok': ok}) AS s FROM e GROUP BY 1
  UNION ALL SELECT f.key, min({'ts': e.ts, 'ok': e.ok}) FROM f JOIN e ON e.key = f.key AND CASE WHEN f.s.ok THEN e.ts >= f.s.ts + INTERVAL 1 HOUR ELSE e.ts > f.s.ts END GROUP BY f.key)
SELECT key, CAST(floor(epoch(s.ts)) AS BIGINT) AS epoch FROM f""")
def breaking_after_success(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    e = e.groupBy(F.col("user_id").alias("key"), "ts").agg(F.bool_or(F.col("event_id") % 3 == 0).alias("ok"))
    return notify.cooldown(e)
