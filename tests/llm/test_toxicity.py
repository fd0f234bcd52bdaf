"""The chain against a plain version of it, its effect on the reported category, and odd tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newslake.llm import toxicity as T

WORDS = [f"w{i}" for i in range(60)]


def world(spark, n=400):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        low, toxic = r.random() < 0.4, r.random() < 0.3
        w = [r.choice(WORDS) for _ in range(r.randint(10, 40))] + ["spam%"] * low + ["idiot" if r.random() < 0.8 else "w1"] * toxic
        rows.append((i, " ".join(w)))
        labels.append((i, int(not low), int(toxic)))
    names = "doc_id long, quality int, toxic int"
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, names), rows, labels


def plain_logistic(x, y, ridge):
    """By gradient steps of a shrinking size until they vanish; the intercept is the last weight."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (x @ w)).sum() + (penalty * w * w).sum() / 2
    rate = 0.1
    for _ in range(20_000):
        g = x.T @ (1 / (1 + np.exp(-(x @ w))) - y) + penalty * w
        if np.abs(g).max() < 1e-6:
            break
        while loss(w - rate * g) > loss(w) - 0.3 * rate * (g @ g):
            rate /= 2
        w, rate = w - rate * g, rate * 1.5
    return w


def test_chain_against_a_plain_one(spark):
    docs, known, rows, labels = world(spark, 200)
    rules = T.Chain(words=5, folds=3)
    words, models = T.train(docs, known, rules, "doc_id", "text")
    assert "idiot" in words and "spam" in words
    x = np.array([[w in T.word_set(t) for w in (v.encode() for v in words)] for _, t in rows], float)
    ys = [np.array([f(q, t) for _, q, t in labels], float) for f in (lambda q, t: q == 0, lambda q, t: t == 1 and q == 0, lambda q, t: t == 1)]
    fold, whole, score = np.arange(len(rows)) % rules.folds, x, x
    for y, model in zip(ys, models, strict=True):
        w = plain_logistic(whole, y, rules.ridge)
        assert model == pytest.approx(w, abs=1e-3)
        out = np.zeros(len(y))
        for f in range(rules.folds):
            v = plain_logistic(whole[fold != f], y[fold != f], rules.ridge)
            out[fold == f] = 1 / (1 + np.exp(-(whole[fold == f] @ v[:-1] + v[-1])))
        p = 1 / (1 + np.exp(-(score @ w[:-1] + w[-1])))
        whole, score = np.c_[whole, out], np.c_[score, p]
    got = {r.doc_id: r for r in T.score(docs, words, models, rules).collect()}
    for k in range(len(rows)):
        assert got[k].p_toxic == pytest.approx(score[k, -1], abs=1e-3) and got[k].p_low_quality == pytest.approx(score[k, -3], abs=1e-3)
        assert got[k].toxic == (got[k].p_toxic >= 0.5)


def test_chain_reaches_the_reported_category(spark):
    docs, known, _, _ = world(spark)
    rules = T.Chain()
    words, models = T.train(docs, known, rules, "doc_id", "text")
    assert len(models[-1]) == len(words) + 3 and np.abs(models[-1][len(words) : -1]).min() > 0.05
    other = [*models[:-1], np.r_[models[-1][: len(words)], 0, 0, models[-1][-1]]]
    a, b = ({r.doc_id: r.p_toxic for r in T.score(docs, words, m, rules).collect()} for m in (models, other))
    assert max(abs(a[k] - b[k]) for k in a) > 0.02


def test_held_out_accuracy(spark):
    docs, known, _, labels = world(spark)
    got = {r.doc_id: r.toxic for r in T.classify(docs, known.where("doc_id % 4 <> 0")).collect()}
    toxic = [i for i, _, t in labels if t and i % 4 == 0]
    assert np.mean([got[i] for i in toxic]) > 0.7 and np.mean([not got[i] for i, _, t in labels if not t and i % 4 == 0]) > 0.97


def test_tables(spark):
    docs, known, _, _ = world(spark, 60)
    odd = docs.withColumn("toxic", F.lit("x")).withColumn("p_toxic", F.lit(1)).withColumn("id", F.lit(2))
    odd = odd.union(odd.where("doc_id < 3")).union(odd.limit(1).select(F.lit(None).cast("long"), F.lit(None).cast("string"), "toxic", "p_toxic", "id"))
    odd = odd.union(odd.limit(1).select(F.lit(7).cast("long"), F.repeat(F.lit("idiot word "), 100_000), "toxic", "p_toxic", "id"))
    twice = known.union(known).union(known.limit(1).select("doc_id", "quality", F.lit(None).cast("int")))
    got = T.classify(odd, twice)
    assert got.count() == 60 + 5 and got.columns == ["doc_id", "p_low_quality", "p_toxic_low_quality", "p_toxic", "toxic"]
    assert T.classify(odd.limit(0), known).count() == 0
    assert not any(r.toxic for r in T.classify(docs, known.limit(0)).collect())
