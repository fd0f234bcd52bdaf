"""Vector codes against plain Python integers."""

import collections
import math
import random

import numpy as np
import pytest

from newslake.llm import vector_codes
from newslake.llm.vector_codes import Quantiser, exact_product, limbs_of

SCHEMA = "vec_id long, embedding array<double>, label int, code string, _label int, wide int"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(vec_id, code, error, label_error) of (vec_id, vector, label), and the codebooks, by loops over Python integers."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = lambda x: math.floor(x * scale) if abs(x) < 2**40 else int(x) * scale
    w = len(rows[0][1]) // parts
    cut = [[[whole(x) for x in v[p * w : p * w + w]] for p in range(parts)] for _, v, _ in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
        return [[min((far(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        own = collections.defaultdict(list)
        for c, at in zip(cut, assign(), strict=True):
            for p in range(parts):
                own[p, at[p][1]].append(c[p])
        for (p, k), vs in own.items():
            books[p] = [*books[p][:k], [sum(x) // len(vs) for x in zip(*vs, strict=True)], *books[p][k + 1 :]]
    out, total = [], collections.Counter()
    for (i, _, label), at in zip(rows, assign(), strict=True):
        e = sum(d for d, _ in at)
        out.append((i, "".join(f"{k:02x}" for _, k in at), e, label))
        total[label] += e
    long_ = lambda x: x if x < 2**63 else None
    wide = {x[3] for x in out if x[2] >= 2**63}
    return sorted(repr((i, code, long_(e), None if y in wide else long_(total[y]))) for i, code, e, y in out), books


def vectors(n, seed=1, size=1.0, width=16):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, size) if r.random() < 0.7 else r.choice([0.0, -size, size]) for _ in range(width)], r.choice([1, 1, 1, 2, None])) for i in range(n)]
    rows += [rows[3], rows[3], (None, rows[4][1], 5), (None, rows[5][1], 5), (1000, None, 1), (1001, [1.0] * (width - 1) + [None], 1), (1002, [math.nan] * width, 1), (-7, [math.inf] * width, 1)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [0.2, 3e5, 4e9, 1e40])  # one limb, several, Python integers, beyond a long
def test_codes_equal_plain(spark, size):
    rows = vectors(90, size=size)
    want, books = plain(rows)
    table = spark.createDataFrame([(*x, "x", 1, 2) for x in rows], SCHEMA).repartition(5)
    got, found = vector_codes.compress(table)
    assert found.tolist() == books
    assert sorted(repr((x.vec_id, x.code, x.error, x.label_error)) for x in got.collect()) == want
    assert (size < 1e9) == all(x.error is not None for x in got.collect())


def test_few_vectors_ties_and_other_lengths(spark):
    rows = [(1, [0.5] * 8, 1), (2, [0.5] * 8, 1), (3, [0.1] * 8, None), (4, [0.25] * 16, 1), (5, [], 1)]
    got = {x.vec_id: x for x in vector_codes.compress(spark.createDataFrame([(*x, "x", 1, 2) for x in rows], SCHEMA))[0].collect()}
    assert got[1].code == got[2].code == "00" * 8 and got[3].code == "02" * 8 and got[3].label_error == 0
    assert got[4].code is got[5].code is got[4].error is got[4].label_error is None and len(got) == 5
    assert vector_codes.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [0.5] * 9, 1, "x", 1, 2)], SCHEMA))


def test_many_labels_are_joined(spark):
    rows = [(i, [float(i % 5)] * 8, None if i % 3 == 0 else i) for i in range(60)]
    table = spark.createDataFrame([(*x, "x", 1, 2) for x in rows], SCHEMA)
    got = vector_codes.compress(table, Quantiser(entries=2, hot_labels=4))[0].collect()
    assert sorted(repr((x.vec_id, x.code, x.error, x.label_error)) for x in got) == plain(rows, entries=2)[0]


def test_exact_product():
    r = np.random.default_rng(5)
    for most, inner in ((10, 1), (2**20, 8), (2**29, 8), (2**29, 3000), (2**45, 7), (2**61, 3)):
        a, b = r.integers(-most, most + 1, (2, 4, inner)), r.integers(-most, most + 1, (2, inner, 5))
        assert (exact_product(a, b) == np.matmul(a.astype(object), b.astype(object))).all()
    x = np.array([0, -1, 5, -(2**40), 2**40 - 1])
    parts = limbs_of(x, 12)
    assert len(parts) > 1 and sum(p.astype(np.int64) << (12 * i) for i, p in enumerate(parts)).tolist() == x.tolist()
    assert all(abs(p).max() < 2**12 for p in parts)
