"""Exact dedup by Bloom filters against a plain dictionary."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newslake.llm import exact_dedup
from newslake.llm.common import TO_LOWER


def sha(text):
    return hashlib.sha256((text or "").encode().translate(TO_LOWER)).hexdigest()


def plain(rows):
    """(doc_id, keep_id, group_size, text_sha256) of (doc_id, text); null ids are the smallest."""
    by = collections.defaultdict(list)
    for i, t in rows:
        by[sha(t)].append(i)
    key = lambda i: (i is not None, i or 0)
    return sorted((repr((i, max(by[sha(t)], key=key), len(by[sha(t)]), sha(t))) for i, t in rows))


def texts(n, seed=3):
    r = random.Random(seed)
    base = [None, "", "Straße É", "straße É", "STRASSE", "a\x00b", "A\x00B", "long " * 50_000, "LONG " * 50_000]
    base += [f"text {r.randrange(n)}" for _ in range(n)] + ["Copies"] * (n // 3)
    r.shuffle(base)
    return list(enumerate(base, -5))


@pytest.mark.parametrize("rules", [exact_dedup.Bloom(), exact_dedup.Bloom(most_bits=16, bits_per_row=100, hot_groups=2), exact_dedup.Bloom(most_bits=16, bits_per_row=1)])
def test_groups_equal_plain(spark, rules):
    rows = texts(1500) + [(None, "null id"), (None, "null id"), (7, "Null Id"), (3, "same row"), (3, "same row")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sha string, row int").repartition(7)
    got = exact_dedup.groups(docs, rules).collect()
    assert sorted(repr((x.doc_id, x.keep_id, x.group_size, x.text_sha256)) for x in got) == plain(rows)
    kept = collections.Counter(x.text_sha256 for x in got if x.kept)
    assert set(kept.values()) == {1} and set(kept) == {sha(t) for _, t in rows}
    assert all(x.doc_id == x.keep_id for x in got if x.kept)


def test_drop_copies(spark):
    rows = texts(600)
    docs = spark.createDataFrame([(t, "x", i, {"k": i}) for i, t in rows], "text string, sha string, doc_id long, h map<string,int>").repartition(5)
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    best = {}
    for i, t in rows:
        best[sha(t)] = max(best.get(sha(t), -9), i)
    assert sorted(x.doc_id for x in got.collect()) == sorted(best.values())
    assert all(x.h["k"] == x.doc_id for x in got.collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.groups(docs).count() == 0 and exact_dedup.drop_copies(docs).count() == 0


def test_few_rows_that_are_not_repeated_are_shuffled(spark):
    hashes = spark.range(60_000, numPartitions=9).select(F.xxhash64("id").alias("h"))
    bits, slices = exact_dedup._size(60_300, exact_dedup.Bloom())
    assert (bits, slices) == (1 << 19, 1)
    more = hashes.union(spark.range(300).select(F.xxhash64("id")))  # the second rows of 300 hashes, in other tasks
    maybe = exact_dedup.held(more, "again", bits)
    assert hashes.where(maybe("h")).count() < 300 + 1500
    assert spark.range(300).select(F.xxhash64("id").alias("h")).where(~maybe("h")).count() == 0


def test_size_and_positions():
    assert exact_dedup._size(0, exact_dedup.Bloom()) == (1 << 16, 1)
    assert exact_dedup._size(10**9, exact_dedup.Bloom()) == (1 << 30, 8)
    at = exact_dedup._positions(np.arange(1000, dtype=np.uint64), 1 << 16)
    assert all(len(set(x)) == 4 for x in at.T.tolist())
