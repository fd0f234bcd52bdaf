"""Importance resampling against plain Python; the table's hashes against the libraries'."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from newslake.llm import importance
from newslake.llm.common import TO_LOWER
from newslake.llm.importance import Resampling
from newslake.llm.ngram_table import PADDING, Table, xxhash64


def features(text, longest=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(TO_LOWER).decode())
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain(rows, target, rules):
    """(doc_id, n_features, weight, score, rank) of rows (doc_id, text), ids distinct."""
    bucket = lambda f: zlib.crc32(f.encode()) % rules.buckets
    s = collections.Counter(bucket(f) for _, t in rows for f in features(t, rules.longest)[1])
    b = collections.Counter(bucket(f) for t in target for f in features(t, rules.longest)[1])
    gain = lambda k: math.floor(1000 * math.log((b[k] + 1) * (s.total() + rules.buckets) / ((s[k] + 1) * (b.total() + rules.buckets))))
    out, able = [], []
    for i, t in rows:
        words, fs = features(t, rules.longest)
        weight = sum(gain(bucket(f)) for f in fs) // max(len(fs), 1)
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
        able += [out[-1]] * (len(words) >= rules.least_words)
    able.sort(key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    rank = {x[0]: k for k, x in enumerate(able[: rules.share * len(able) // 100], 1)}
    return sorted(repr((*x, rank.get(x[0]))) for x in out)


def texts(n, seed=2):
    r = random.Random(seed)
    words = ["W%d" % i for i in range(300)] + ["Straße", "É", "x" * 70, "日本", "a" * 31, "b" * 32, "c" * 33]
    out = [None, "", " \n--", "one", "UPPER lower", "y" * 3000, "-".join(r.choice(words) for _ in range(4000))]
    return out + ["".join(r.choice(words) + r.choice([" ", ", ", "\n", "--"]) for _ in range(r.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("rules", [Resampling(), Resampling(batch_bytes=50), Resampling(longest=3, buckets=50, share=60, least_words=3, batch_bytes=700)])
def test_resample_equals_plain(spark, rules):
    rows = list(enumerate(texts(150), 10)) + [(None, "w1 " * 30)]
    target = [t for t in texts(20, 9)][2:]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, weight int, bucket int").repartition(6)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(docs, bench, rules).collect()
    want = plain(rows, target, rules)
    assert sorted(repr((x.doc_id, x.n_features, x.weight, x.score, x.rank)) for x in got) == want
    kept = importance.drawn(docs, bench, rules)
    assert kept.columns == docs.columns and sorted(map(str, (x.doc_id for x in kept.collect()))) == sorted(str(x.doc_id) for x in got if x.rank)


def test_empty_tables_and_repeats(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(none, bench).count() == importance.drawn(none, bench).count() == 0
    rows = [(5, "w " * 25)] * 9 + [(6, None)]
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted(x.rank for x in got if x.rank) == [1, 2] and len(got) == 10 and [x.weight for x in got if x.doc_id == 6] == [0]


def test_hashes_are_the_library_s():
    r = random.Random(1)
    data = [bytes(r.randrange(256) for _ in range(n)) for n in [*range(70), 200, 1000]]
    size = np.array([len(x) for x in data])
    start = np.cumsum(size) - size
    buffer = np.frombuffer(b"".join(data) + bytes(PADDING), np.uint8)
    assert xxhash64(buffer, start, size).tolist() == [xxhash.xxh64_intdigest(x) for x in data]


def test_table_verifies_bytes(monkeypatch):
    words = [b"alpha", b"beta", b"alphb", b"alpha", b"", b"beta", b"alph", b"alpha", b"a" * 9, b"a" * 8 + b"b", b"a" * 9]
    size = np.array([len(x) for x in words])
    buffer, start = np.frombuffer(b"".join(words) + bytes(PADDING), np.uint8), np.cumsum(size) - size
    for same_key in (False, True):  # all strings of one key, too
        if same_key:
            monkeypatch.setattr("newslake.llm.ngram_table.xxhash64", lambda b, s, n: np.full(len(s), 3, np.uint64))
        table = Table(buffer, start, size, 7)
        assert [[words[i] for i in np.flatnonzero(table.slot == s)] for s in dict.fromkeys(table.slot.tolist())] == [[w] * words.count(w) for w in dict.fromkeys(words)]
        assert table.count[table.slot].tolist() == [words.count(w) for w in words]
        assert table.bucket[table.slot].tolist() == [zlib.crc32(w) % 7 for w in words]
        assert table.by_bucket(7).sum() == len(words)
