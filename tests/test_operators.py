"""Hand-checked facts and traps of the article operators."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from newslake import config
from newslake.functions import text, urls
from newslake.operators import dedupe, engagement, feeds, notify, ranking, runs, similarity
from newslake.sources import landing, sinks

NOW = dt.datetime(2024, 1, 31)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return df.select(column.alias("y")).first()["y"]


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def test_weights_must_add_up():
    with pytest.raises(ValueError):
        config.Ranking(source=0.5)
    assert config.Ranking().merged(half_life_hours=6).half_life_hours == 6


def test_scores(spark):
    c = config.Ranking()
    for n, want in ((1, 0.2), (2, 0.5), (3, 0.7386)):
        assert one(spark, ranking.source_score(F.lit(n))) == pytest.approx(want, abs=1e-4)
    assert one(spark, ranking.recency_score(F.lit(12.0), c)) == pytest.approx(0.5)
    assert one(spark, ranking.recency_score(F.lit(73.0), c)) == 0.01
    assert one(spark, ranking.engagement_score(F.lit(10000), F.lit(100000), F.lit(5000))) == 1.0
    assert one(spark, ranking.keyword_score(F.lit(0.0))) == 0.1


def test_rank_and_empty(spark):
    rows = [(1, "AI launches", "x", "TechCrunch", "ai", NOW, 5, 1), (2, "Other", "x", "Nobody", "other", NOW - dt.timedelta(hours=40), 0, 0)]
    df = spark.createDataFrame(rows, "article_id long, title string, content string, source_name string, category_slug string, published_at timestamp, view_count long, bookmark_count long")
    scored = ranking.rank_scores(df, now())
    assert [(r.article_id, r["rank"]) for r in ranking.top_ranked(scored).collect()] == [(1, 1), (2, 2)]
    assert {r.article_id: r.raw_authority for r in scored.collect()} == {1: 85.0, 2: 50.0}
    assert ranking.top_ranked(ranking.rank_scores(df.limit(0), now())).count() == 0


def test_substring_keywords_have_no_word_boundaries(spark):
    assert one(spark, text.categorize(F.array(F.lit("blockchain")))) == "ai"


def test_summary_title_drops_after_last_dash(spark):
    assert one(spark, text.summary_title(F.lit("GPT-5 launches"))) == "GPT"


def test_make_summary_without_space(spark):
    assert one(spark, text.make_summary(F.lit("x" * 600))) == "..."
    assert one(spark, text.make_summary(F.lit("a" * 350 + ". " + "b" * 300))) == "a" * 350 + "."


def test_url_keys(spark):
    u = F.lit("https://www.Site.com/item/?id=1&utm=2")
    assert one(spark, urls.url_key(u)) == "site.com/item?id=1"
    assert one(spark, urls.url_key(u, ())) == "site.com/item"
    assert one(spark, urls.url_key(F.lit("Not a URL"))) == "not a url"
    assert one(spark, urls.image_url(F.lit("https://a.b/placeholder.png"))) is None


def test_jaccard_facts(spark):
    t = lambda s: text.tokens(F.lit(s))
    assert one(spark, text.jaccard(t("OpenAI launches new AI model"), t("OpenAI announces AI breakthrough"))) == pytest.approx(1 / 5)
    g = lambda s: text.char_ngrams(F.lit(s))
    assert one(spark, text.jaccard(g("artificial intelligence"), g("artifical intelligence"))) > 0.6


def test_dates_and_reading(spark):
    assert one(spark, text.normalize_date(F.lit(NOW + dt.timedelta(days=1)), now())) == NOW
    assert one(spark, text.read_time(F.lit(""))) == 1
    assert one(spark, text.token_estimate(F.lit("abcde"))) == 2


def test_title_duplicates_match_brute_force(spark):
    titles = ["Alpha beta gamma delta", "alpha beta gamma delta!", "Alpha other things", "", "Alpha beta gamma delta epsilon zeta eta", "alpha beta gamma delta epsilon zeta eta theta"]
    rows = [(i, t, f"text {i}", f"https://s.com/{i}") for i, t in enumerate(titles)]
    df = dedupe.keyed(spark.createDataFrame(rows, "article_id long, title string, content string, source_url string"))
    got = {r.article_id: (r.match_type, r.matched_id) for r in dedupe.verdicts(df).collect()}
    assert got == {0: ("none", None), 1: ("title", 0), 2: ("none", None), 3: ("none", None), 4: ("none", None), 5: ("title", 4)}


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 6), (5, 5), (10, 3), (9, 8), (8, 7)], "a long, b long")
    got = {r.node: r.component for r in similarity.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 6: 6, 7: 6, 8: 6, 9: 6}


def test_clusters_find_same_titles_and_near_titles(spark):
    body = "word " * 60
    rows = [(1, "Google releases quantum chip today"), (2, "Google releases quantum chip today"), (3, "Google releases quantum chip yesterday evening again"), (4, "Different story altogether")]
    df = spark.createDataFrame([(i, t, body, "Wired", NOW, 0, 0) for i, t in rows], "article_id long, title string, content string, source_name string, published_at timestamp, view_count long, bookmark_count long")
    found = similarity.clusters(df)
    assert {r.article_id for r in found.collect()} >= {1, 2} and 4 not in {r.article_id for r in found.collect()}
    best = similarity.canonical(df.join(found, "article_id")).collect()
    assert len(best) == 1 and best[0].canonical_id == 1


def test_candidates_of_a_later_copy(spark):
    """Article 2 probes 'quantum' as its second word; of that bucket's title only the copy 3 is greater."""
    rows = [(1, "Quantum chips ship"), (2, "Seven quantum chips ship"), (3, "Quantum chips ship")]
    titles = similarity.distinct_titles(spark.createDataFrame(rows, "article_id long, title string"))
    assert [(r.a, r.b) for r in similarity.candidate_pairs(titles).collect()] == [(1, 2)]
    once = similarity.distinct_titles(spark.createDataFrame(rows[:2], "article_id long, title string"))
    assert similarity.candidate_pairs(once).count() == 0


def test_duplicate_decisions_read_contents(spark):
    """Against the reference's rules row by row; new ids on both sides of the stored ones."""
    stop = set(config.STOP_WORDS)
    toks = lambda s: [w for w in re.sub(r"[^\w\s']", " ", s.lower()).split() if 2 < len(w) < 30 and w not in stop and not w.isdigit()]
    boost = lambda w: 1.5 if w in config.BOOST_TERMS else 1.0
    body = lambda k: " ".join(f"{k}word{i}" for i in range(30))
    stored = [(10, "Quantum chips beat older chips today", body("one")), (11, "Quantum maker ships seven fast parts", body("two")), (12, "Rivers flood northern towns again", "short"), (13, "Seven Quantum lanterns glow outside", body("four"))]
    new = [
        (1, "Quantum maker ships seven fast boats", body("two")), (20, "Quantum maker ships seven fast boats", body("nine")), (21, "Quantum maker ships seven fast trains", body("two") + " more"),
        (2, "Rivers flood northern towns", body("two")), (22, "Rivers flood northern villages", body("five")), (3, "Nothing like it anywhere", body("one")), (23, "Quantum chips beat older chips today", ""),
        (4, "Lanterns quantum seven glow", body("four")), (24, "Glow quantum Seven lanterns", body("four")), (5, None, None),
    ]
    df = lambda rows, k: spark.createDataFrame([(i, t, c, f"https://{k}.com/{i}") for i, t, c in rows], "article_id long, title string, content string, source_url string")
    docs = [set(toks(t + " " + c[:500])) for _, t, c in stored]
    idf = lambda w: math.log((len(docs) + 1) / ((sum(w in d for d in docs) or 1) + 1)) + 1

    def vector(words, weigh):
        return {w: (1 + math.log(words.count(w))) * boost(w) * weigh(w) for w in set(words)}

    def cos(x, y):
        norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return sum(v * y.get(w, 0) for w, v in x.items()) / norm if norm else 0.0

    first = lambda t: next((w for w in re.sub(r"[^\w\s]", "", t.lower()).split() if len(w) > 2 and w not in config.CLUSTER_BUCKET_STOPS), t[:5].lower())
    want = {}
    for i, t, c in new:
        best = (0.0, None)
        for j, u, d in stored if t else ():
            x, y = set(toks(t)), set(toks(u))
            if first(u) in {first(t), *(w for w in t.lower().split(" ")[:3] if len(w) > 3)} and len(x & y) / len(x | y) >= 0.3:
                s = cos(vector(toks(t), lambda w: 2), vector(toks(u), lambda w: 2))
                if s <= 0.9 and len(c) > 100 and len(d) > 100:
                    s = 0.7 * s + 0.3 * cos(vector(toks(c), idf), vector(toks(d), idf))
                best = max(best, (s, -j), key=lambda z: z[0])
        near = "add_to_cluster" if best[1] in (-11, -13) else "create_cluster"
        action = "skip" if best[0] > 0.9499 else near if best[0] >= 0.8 else "store_new"
        want[i] = (action, round(best[0], 6), -best[1] if best[0] >= 0.6 else None)
    store = df(stored, "s").withColumn("cluster_id", F.when(F.col("article_id").isin(11, 13), "c"))
    got = {r.article_id: (r.action, round(r.score, 6), r.matched_id) for r in similarity.duplicate_decisions(df(new, "n"), store).collect()}
    assert got == want and want[2][0] == "create_cluster" and want[1][0] == "add_to_cluster" and want[20][0] == "store_new" and want[23] == ("skip", 1.0, 10)


def test_breaking(spark):
    df = spark.createDataFrame([(1, "OpenAI launches GPT breakthrough AI", "X", NOW - dt.timedelta(hours=1), 80.0, 0, 0), (2, "Calm", "X", NOW, 30.0, 0, 0)], "article_id long, title string, source_name string, published_at timestamp, score double, view_count long, bookmark_count long")
    got = {r.article_id: (r.breaking_score, r.is_breaking) for r in notify.breaking_scores(df, now()).collect()}
    assert got == {1: (115.0, True), 2: (40.0, False)}


def test_cooldown_is_greedy(spark):
    at = [0, 900, 3600, 7000, 7200]
    df = spark.createDataFrame([(1, NOW + dt.timedelta(seconds=s)) for s in at], "key long, ts timestamp")
    start = int(NOW.replace(tzinfo=dt.timezone.utc).timestamp())
    assert sorted(r.epoch - start for r in notify.cooldown(df).collect()) == [0, 3600, 7200]


def test_cooldown_folds_every_candidate(spark):
    """Several candidates of a quarter of an hour, a hot key and a null key, against a plain fold."""
    r = random.Random(4)
    at = [(1, s) for s in (840, 3660, 4470)] + [(2, r.randrange(40_000)) for _ in range(3000)] + [(None, r.randrange(20_000)) for _ in range(50)]
    want, last = [], {}
    for key, s in sorted(at, key=lambda x: x[1]):
        if key not in last or s - last[key] >= 3600:
            want.append((key, s))
            last[key] = s
    df = spark.createDataFrame([(k, NOW + dt.timedelta(seconds=s)) for k, s in at], "key long, ts timestamp")
    start = int(NOW.replace(tzinfo=dt.timezone.utc).timestamp())
    assert (1, 4470) in want and sorted(((x.key, x.epoch - start) for x in notify.cooldown(df).collect()), key=str) == sorted(want, key=str)


def test_pages_clamp():
    assert feeds.clamp_page(0, 1000) == (1, 50) and feeds.clamp_page(3, 0) == (3, 20)


def test_streaks_and_tokens(spark):
    log = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "a", False), (4, "b", False), (5, "b", False), (6, "b", False)], "event_id long, stage string, success boolean")
    assert {r.stage: (r.streak, r.healthy) for r in runs.failure_streak(log).collect()} == {"a": (2, True), "b": (3, False)}
    users = spark.createDataFrame([(1, ["x", "y"]), (2, ["y"])], "user_id long, device_tokens array<string>")
    bad = spark.createDataFrame([("y",)], "token string")
    assert {r.user_id: r.device_tokens for r in engagement.without_tokens(users, bad).collect()} == {1: ["x"], 2: []}
    waves = engagement.send_waves(spark.range(1201).select(F.col("id").cast("string").alias("token")))
    assert sorted(r["count"] for r in waves.groupBy("wave").count().collect()) == [201, 500, 500]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"articles":[{"title":"T","url":"u","content":"","description":"d","source":{"name":""}},{"title":"","url":"u"}]}')
    rows = landing.news_json(spark, str(tmp_path / "n.json"), "News").collect()
    assert [(r.title, r.content, r.source_name) for r in rows] == [("T", "d", "News")]
    (tmp_path / "i.json").write_text('{"id":1,"type":"story","title":"","url":"u","time":0,"score":3}\n{"id":2,"type":"job","url":"u"}')
    assert [r.title for r in landing.link_items(spark, str(tmp_path / "i.json")).collect()] == ["Untitled"]
    page = '<article><h2><a href="/a/b">b</a></h2><p>Text</p><a href="/a/b/stargazers">1,234,567</a></article>'
    got = landing.repository_pages(spark.createDataFrame([(page,), (None,)], "html string")).collect()
    assert [(r.author, r.name, r.description, r.stars, r.forks) for r in got] == [("a", "b", "Text", 1234567, 0)]
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A</title><link>l</link><description>d</description></item></channel></rss>")
    assert [(r.title, r.url) for r in landing.feed(spark, str(tmp_path / "f.xml")).collect()] == [("A", "l")]
    rows = [(4, "u1", "f2"), (1, "u1", "f1"), (2, "u2", "f3"), (3, None, "f5"), (5, None, None), (6, None, None), (7, "u7", "f1")]
    batch = spark.createDataFrame(rows, "article_id long, source_url string, fingerprint string")
    counts = sinks.append_new(batch, spark.createDataFrame([(9, "u2", "f9")], batch.schema), str(tmp_path / "out"))
    # rows without a key equal none; of equal keys the smallest id stays
    assert sorted(r.article_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3, 5, 6]
    assert counts == {"added": 4, "duplicates": 3}
    t = spark.createDataFrame([(1, 0.0), (2, 0.0)], "id long, score double")
    assert {r.id: r.score for r in sinks.updated(t, t.where("id = 2").withColumn("score", F.lit(5.0)), "id", ["score"]).collect()} == {1: 0.0, 2: 5.0}
    twice = spark.createDataFrame([(2, 7.0), (2, 6.0)], t.schema)
    assert sorted((r.id, r.score) for r in sinks.updated(t, twice, "id", ["score"]).collect()) == [(1, 0.0), (2, 6.0)]


def test_stream_equals_batch(spark, tmp_path):
    from newslake.streaming import streams

    rows = [(1, "view", '{"k": 3}', NOW), (2, "view", '{"k": 3}', NOW), (3, "purchase", '{"k": 4}', NOW)]
    df = spark.createDataFrame(rows, "event_id long, event_type string, props string, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    streams.run_available(streams.counters(stream), "counted", str(tmp_path / "cp"))
    got = {(r.article_id, r.view_count, r.bookmark_count) for r in spark.table("counted").collect()}
    assert got == {(3, 2, 0), (4, 0, 1)} and math.isclose(len(got), 2)
