"""The quadratic discriminant and the compression bands against plain versions; odd tables."""

import math
import random
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from newslake.llm import quality_classifier as Q
from newslake.llm import quality_rules as R


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))


def docs_and_labels(spark, n=160):
    r = random.Random(1)
    rows, labels = [(0, None), (1, "")], []
    for i in range(2, n):
        good = r.random() < 0.5
        t = prose(r, r.randint(30, 90))
        rows.append((i, t if good else t.replace("a", "a%%").upper() + " !! 77" * 3))
        labels.append((i, int(good), 0))
    return rows, labels, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_discriminant_against_numpy(spark):
    """Densities by the plain formula: determinants and inverses of the shrunk covariances."""
    rows, labels, docs, known = docs_and_labels(spark)
    rules, held = Q.Discriminant(), lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    x = {i: np.array(Q.statistics(t or "")) for i, t in rows}
    by = {y: np.stack([x[i] for i, q, _ in labels if q == y and not held(i)]) for y in (0, 1)}
    n = {y: len(v) for y, v in by.items()}
    cov = {y: np.cov(v.T, bias=True) for y, v in by.items()}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    scale = np.sqrt(np.diag(pooled) + 1e-9)
    logs = {}
    for y in (0, 1):
        m = ((1 - rules.shrink) * cov[y] + rules.shrink * pooled) / np.outer(scale, scale)
        m = (1 - rules.ridge) * m + rules.ridge * np.trace(m) / len(m) * np.eye(len(m)) + 1e-9 * np.eye(len(m))
        inverse, log_det = np.linalg.inv(m), np.linalg.slogdet(m)[1]
        logs[y] = {i: -0.5 * (((v - by[y].mean(0)) / scale) @ inverse @ ((v - by[y].mean(0)) / scale) + log_det) + math.log(n[y] / (n[0] + n[1])) for i, v in x.items()}
    got = Q.classify(docs, known, F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()
    assert len(got) == len(rows)
    for g in got:
        want = 1 / (1 + math.exp(-min(60, max(-60, (logs[1][g.doc_id] - logs[0][g.doc_id]) / rules.flatten))))
        assert g.score == pytest.approx(want, abs=1e-6) and g.held_out == held(g.doc_id) and g.predicted == int(g.score >= 0.7)


def test_classifier_tables(spark):
    rows, labels, docs, known = docs_and_labels(spark, 60)
    odd = docs.select("doc_id", "text", F.lit("q").alias("quality"), F.lit(1).alias("score"), F.lit(True).alias("label"))
    odd = odd.union(odd.where("doc_id < 4")).union(spark.createDataFrame([(None, "word " * 300_000, "q", 1, True)], odd.schema))
    got = Q.classify(odd, known.union(known.limit(3)), F.lit(False))
    assert got.count() == 60 + 4 + 1 and got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert Q.classify(odd.limit(0), known, F.lit(False)).count() == 0
    assert {g.score for g in Q.classify(docs, known.where("quality = 1"), F.lit(False)).collect()} == {0.5}


def plain_verdict(t, rules):
    """The bands written out: whole ratio by length, then the share of full chunks that are out of band."""
    data, press = t.encode(), zstandard.ZstdCompressor(level=rules.level)
    ratio = lambda x: len(press.compress(x)) / len(x)
    band = None
    for b in rules.bands:
        band = b if len(data) >= b[0] else band
    if band and not band[1] <= ratio(data) <= band[2]:
        return False
    full = [data[i : i + rules.chunk_bytes] for i in range(0, len(data), rules.chunk_bytes)]
    full = [x for x in full if len(x) == rules.chunk_bytes]
    out = [x for x in full if not rules.chunk_least <= ratio(x) <= rules.chunk_greatest]
    return not full or len(out) <= rules.chunk_share * len(full)


def test_bands_against_a_plain_version(spark):
    r = random.Random(5)
    noise = lambda n: "".join(chr(r.randrange(33, 127)) + (" " if k % 7 == 6 else "") for k in range(n))
    rows = [None, "", prose(r, 20)]
    for n in (20, 60, 150, 400, 900, 2500, 6000):
        text = prose(r, n)
        rows += [text, noise(6 * n), " ".join(f"{w} {prose(r, 1)}" for w in ["steady words come again and"] * (n // 5)), text + noise(5 * n), "é" * 9 + text]
        rows.append(" ".join(x for k in range(n) for x in (prose(r, 9), f"k{k % 3}")))
    df = spark.createDataFrame([(k, t, True, "x") for k, t in enumerate(rows)], "doc_id long, text string, kept boolean, reason string")
    got = {x.doc_id: x for x in R.quality_rules(df).collect()}
    assert len(got) == len(rows)
    for k, t in enumerate(rows):
        assert got[k].kept == (not got[k].base_failed and plain_verdict(t or "x", R.Bands())), (k, got[k])
    verdicts = [x.reason for x in got.values()]
    assert {"", "base", "incompressible", "repetitive"} <= set(verdicts)
    assert sorted(x.doc_id for x in R.keep_good(df).collect()) == sorted(k for k, x in got.items() if x.kept)


def test_each_band_has_both_ends():
    """Just inside and just outside of each band, by rules whose limits are set around a text's own ratio."""
    r = random.Random(6)
    press = zstandard.ZstdCompressor(level=3)
    for size in (128, 256, 512, 1024, 2048, 4096, 16384):
        data = prose(r, size).encode()[:size]
        ratio = len(press.compress(data)) / size
        for low, high, want in ((ratio - 0.01, ratio + 0.01, ""), (ratio + 0.01, 2.0, "repetitive"), (0.0, ratio - 0.01, "incompressible")):
            rules = R.Bands(bands=((size, low, high),), chunk_least=0.0, chunk_greatest=9.0)
            assert R.compression(data, rules, press)[3] == want
            assert R.compression(data[:-1], rules, press)[3] == ""  # too short for the band


def test_rules_tables(spark):
    df = spark.createDataFrame([(1, "word " * 300_000, 1), (1, "a b", 2), (1, "a b", 2), (None, None, None)], "doc_id long, text string, n_words int")
    assert sorted(x.n_words for x in R.quality_rules(df).collect()) == [0, 2, 2, 300_000]
    assert R.quality_rules(df.limit(0)).count() == 0 and R.keep_good(df.limit(0)).columns == df.columns
