"""Work that must follow the input: rows shuffled for candidate pairs, and expressions computed once a row."""

import random

from pyspark.sql import functions as F

from newslake.functions import text
from newslake.operators import dedupe, similarity


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_title_is_one_row_of_its_bucket(spark):
    """No row a token: nothing is exploded before titles meet, whatever the number of their tokens."""
    rows = [(i, [f"w{k}" for k in range(i % 5, i % 5 + 20)], "x") for i in range(40)]
    a, b = (spark.createDataFrame(rows, f"{s} long, t{s} array<string>, bucket string") for s in ("a", "b"))
    pairs = similarity.bucket_pairs(a, b, 0.3)
    assert "Generate" not in plan(pairs) and pairs.count() == 1600


def test_long_titles_share_bits_of_the_sketch(spark):
    """Far more tokens than the sketch has bits: its bound stays above the common tokens."""
    r = random.Random(3)
    sets = [(i, "x", sorted(r.sample([f"t{k}" for k in range(700)], r.choice([250, 400, 600])))) for i in range(24)]
    got = {(x.a, x.b): x.similarity for x in dedupe.set_pairs(spark.createDataFrame(sets, "id long, bucket string, w array<string>"), 0.4).collect()}
    jaccard = lambda v, w: len(v & w) / len(v | w)
    want = {(i, j): jaccard(set(v), set(w)) for i, _, v in sets for j, _, w in sets if i < j and jaccard(set(v), set(w)) >= 0.4}
    assert got == want and 0 < len(want) < 276


def test_ngrams_clean_the_title_once(spark):
    """Not once for each n-gram."""
    df = spark.createDataFrame([("Ab  cD",)], "x string").select(text.char_ngrams(F.col("x")).alias("g"))
    assert plan(df).count("regexp_replace") == 1 and df.first().g == ["ab ", "b c", " cd"]


def test_title_cosines_come_with_the_pairs(spark):
    """Repeated and boosted terms included; no row a pair and term is joined after the titles met."""
    docs = spark.createDataFrame([(1, "Storm storm ai hits coast towns"), (2, "Storm hits hits hits coast towns again"), (3, "Storm ai ai coast towns")], "article_id long, title string")
    titles = similarity.distinct_titles(docs)
    got = {(r.a, r.b): r.cosine for r in similarity.candidate_pairs(titles).collect()}
    vectors = similarity.title_vectors(titles.selectExpr("id article_id", "title"))
    want = {(r.a, r.b): r.c for r in similarity.cosine(spark.createDataFrame(list(got), "a long, b long"), vectors, "c").collect()}
    assert len(got) == 3 and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_both_sides_of_a_duplicate_decision_may_use_an_id(spark):
    long_ = lambda w: " ".join(f"{w}{i}" for i in range(60))
    frame = lambda rows: spark.createDataFrame(rows, "article_id long, title string, content string, source_url string")
    store = frame([(1, "Storm hits coast towns tonight again", long_("a"), "https://s.com/1"), (2, "Quantum chips ship early", long_("b"), "https://s.com/2")])
    batch = frame([(2, "Storm hits coast towns tonight badly", long_("a"), "https://n.com/2"), (1, "Quantum chips ship early", long_("b"), "https://n.com/1")])
    got = {r.article_id: (r.matched_id, r.match_type) for r in similarity.duplicate_decisions(batch, store).collect()}
    assert got == {2: (1, "near"), 1: (2, "exact")}


def _vector_texts(monkeypatch):
    """Lists of the ids whose contents become vectors, one a call."""
    seen, plain = [], similarity.content_vectors
    monkeypatch.setattr(similarity, "content_vectors", lambda docs, *rest: seen.append({r.article_id for r in docs.select("article_id").collect()}) or plain(docs, *rest))
    return seen


def test_decided_rows_and_far_titles_are_not_compared(spark, monkeypatch):
    seen = _vector_texts(monkeypatch)
    body, names = "steel copper timber prices rise again " * 5, "article_id long, title string, content string, source_url string"
    store = spark.createDataFrame([(1, "market steel copper timber prices rise", body, "http://a/1"), (2, "market steel quarry", body, "http://a/2"), (3, "market steel copper timber prices fall", "other words here " * 9, "http://a/3")], names)
    batch = spark.createDataFrame([(11, "market steel copper timber prices rise", body, "http://b/1"), (12, "market steel copper timber prices", body, "http://a/2"), (13, "market steel copper timber quotas rise", body, "http://b/3")], names)
    got = {r.article_id: (r.action, r.matched_id) for r in similarity.duplicate_decisions(batch, store).collect()}
    assert got == {11: ("skip", 1), 12: ("skip", 2), 13: ("create_cluster", 1)}
    assert seen == [{"n13", "s1", "s3"}]


def test_titles_that_are_joined_already_need_no_contents(spark, monkeypatch):
    """The first and last title are near, but both are surely linked to the one between."""
    seen, words = _vector_texts(monkeypatch), [f"word{i}x" for i in range(13)]
    docs = spark.createDataFrame([(k, " ".join(["market", *words[k : k + 11]]), f"steel copper timber prices {k} " * 9) for k in range(3)], "article_id long, title string, content string")
    cosines = {(r.a, r.b): r.cosine for r in similarity.candidate_pairs(similarity.distinct_titles(docs)).collect()}
    assert cosines[0, 1] > 0.9 and cosines[1, 2] > 0.9 and 0.8 < cosines[0, 2] < 0.9
    assert similarity.clusters(docs).select("cluster_id").distinct().count() == 1
    assert seen == [set()]
