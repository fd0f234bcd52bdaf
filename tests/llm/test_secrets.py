"""The character models on planted strings and ordinary text: recall, false alarms, and spans against plain Python."""

import math
import random
import re
import string

import pytest

from newslake.llm import secrets

SYLLABLES = "tion ing ent able er un re de con pro ver ist ung lich keit eux ment que los dad cion ar".split()
ALPHABETS = {
    "base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "HEX": "0123456789ABCDEF", "letters": string.ascii_letters,
    "lower": string.ascii_lowercase + string.digits, "upper": string.ascii_uppercase + string.digits,
}


def word(r):
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3)))


def identifier(r):
    w = [word(r) for _ in range(r.randint(3, 5))]
    return r.choice([lambda: "_".join(w), lambda: "-".join(w), lambda: w[0] + "".join(x.title() for x in w[1:]), lambda: "".join(w) + str(r.randint(0, 999)), lambda: "_".join(w).upper(), lambda: "/".join(w)])()


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(5)
    rows = [" ".join(word(r) for _ in range(120)) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 1, "m") for i, t in enumerate(rows)], "doc_id long, text string, value int, label string")
    return df, secrets.train(secrets.labelled_samples(df))


def mean_ratio(value, models):
    pairs = [models.ratios[ord(a) * 128 + ord(b)] for a, b in zip(value, value[1:], strict=False)]
    return sum(pairs) / max(1, len(pairs))


def test_recall_and_false_alarms(spark, world):
    _, models = world
    r = random.Random(6)
    planted = [(k, "".join(r.choice(ALPHABETS[a]) for _ in range(r.randint(20, 40))), a) for k, a in enumerate(list(ALPHABETS) * 80)]
    plain = [(10_000 + k, identifier(r), "identifier") for k in range(2000)]
    rows = [(k, f"Some words, then {v} and é more words.", a) for k, v, a in planted + plain]
    got = {x.doc_id: x.found for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, kind string"), models).collect()}
    for a in ALPHABETS:
        ids = [k for k, _, kind in planted if kind == a]
        assert sum(bool(got[k]) for k in ids) >= 0.95 * len(ids), a
    assert sum(bool(got[k]) for k, _, _ in plain) <= 0.005 * len(plain)


def test_model_spans_against_plain_python(spark, world):
    df, models = world
    r = random.Random(7)
    pool = [identifier(r) for _ in range(30)] + ["".join(r.choice(ALPHABETS["base62"]) for _ in range(24)) for _ in range(20)] + ["=" * 20, "-" * 40, "é" * 20, "token=abcdEFGH1234", "0123456789abcdef01"]
    rows = [" ".join(r.choice(pool) for _ in range(r.randint(0, 12))) for _ in range(200)] + [None, ""]
    docs = spark.createDataFrame([(k % 150, t) for k, t in enumerate(rows)], "doc_id long, text string")
    want = []
    for k, t in enumerate(rows):
        t = t or ""
        base = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN.replace("(?i:", "(?:"), t, re.I) if len(m[2]) >= 12]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{16,}", t)]
        extra = [(m.start(), 3, m.end()) for m in re.finditer(secrets.CANDIDATE, t) if mean_ratio(m[0], models) > models.threshold]
        extra = [x for x in extra if not any(b[0] < x[2] and x[0] < b[2] for b in base)]
        want.append((k % 150, ",".join(f"{secrets.KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(base + extra))))
    assert sorted((x.doc_id, x.spans) for x in secrets.scan(docs, models).collect()) == sorted(want)


def test_training_counts_and_threshold(spark):
    """Ratios by plain counting; held-out identifiers set the threshold and are not counted."""
    rows = [("abab", 1), ("zz9z", 1)] + [(f"name{k}name{k}name{k}name", 0) for k in range(40)]
    df = spark.createDataFrame(rows, "value string, label int")
    held = {x.value for x in df.where("label = 0 and pmod(xxhash64(value), 5) = 0").collect()}
    models = secrets.train(df, secrets.Threshold(alarms=0.0, least=-99.0))
    counts = {0: {}, 1: {}}
    for v, label in rows:
        if v not in held:
            for p in zip(v, v[1:], strict=False):
                counts[label][p] = counts[label].get(p, 0) + 1
    def log(label, a, b):
        return math.log((counts[label].get((a, b), 0) + 1) / (sum(n for (x, _), n in counts[label].items() if x == a) + 66))
    for a, b in ("ab", "ba", "na", "am", "z9", "qq"):
        assert models.ratios[ord(a) * 128 + ord(b)] == pytest.approx(log(1, a, b) - log(0, a, b))
    assert held and models.threshold == pytest.approx(max(mean_ratio(v, models) for v in held), abs=1e-5)


def test_samples_and_empty_tables(spark, world):
    rows = [" ".join(f"word{chr(97 + k)}{chr(97 + j)}" for j in range(20)) for k in range(20)] + ["copies of one text"] * 50
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {x.value for x in secrets.labelled_samples(df).where("label = 0").collect()}
    assert {w for t in rows for w in t.split() if len(w) >= 3} <= got
    docs, models = world
    small = secrets.Threshold(samples=100)
    assert secrets.labelled_samples(docs, rules=small).where("label = 1").count() <= 100
    empty = docs.limit(0)
    assert secrets.scan(empty).count() == 0 and secrets.redact(empty).count() == 0
    assert secrets.redact(docs, models).columns == docs.columns
    long_text = "word " * 200_000 + "AKIA" + "Q" * 16
    one = spark.createDataFrame([(1, long_text)], "doc_id long, text string")
    assert secrets.scan(one, models).first().spans == f"access:{len(long_text) - 20}:{len(long_text)}"


def test_running_results(spark):
    from pyspark.sql import functions as F

    from newslake.llm.common import running

    r = random.Random(4)
    rows = [[r.randrange(-9, 10) for _ in range(n)] for n in (0, 1, 2, 255, 256, 257, 512, 1000)]
    df = spark.createDataFrame([(x,) for x in rows], "x array<int>")
    got = df.select("x", running(F.col("x"), lambda a, b: a + b, F.lit(0)).alias("sums"), running(F.col("x"), F.greatest, F.lit(-99)).alias("most")).collect()
    for x in got:
        assert x.sums == [sum(x.x[: i + 1]) for i in range(len(x.x))] and x.most == [max(x.x[: i + 1]) for i in range(len(x.x))]


def test_many_spans_of_one_text(spark, world):
    """Time follows the number of spans, of fixed patterns and of the models alike."""
    import time

    _, models = world
    r = random.Random(9)
    took = {}
    for n in (2000, 8000):
        parts = [f"{r.getrandbits(64):016x}" if i % 2 else "".join(r.choice(ALPHABETS["base62"]) for _ in range(24)) for i in range(n)]
        docs = spark.createDataFrame([(1, " ".join(parts))], "doc_id long, text string")
        secrets.scan(docs, models).collect()
        began = time.time()
        row = secrets.scan(docs, models).first()
        took[n] = time.time() - began
        assert row.n_hex == n // 2 and len(row.found) > 0.95 * n
    assert took[8000] < 8 * took[2000] + 2
