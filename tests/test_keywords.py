"""The automaton against a scan for each keyword."""

import random

import pytest
from pyspark.sql import functions as F

from newslake import config
from newslake.functions import keywords, text


def test_places(spark):
    r = random.Random(2)
    names = ("ai", "said", "a", "blockchain", "chain", "chai", "é", "x y", "zz")
    rows = ["".join(r.choice("aidschnbloké xyz") for _ in range(r.randint(0, 60))) for _ in range(300)] + [None, "", "blockchain", "x" * 100_000 + "zz"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id long, t string")
    got = {x.id: x.p for x in df.select("id", keywords.places(F.col("t"), names).alias("p")).collect()}
    assert got == {i: [k for k, n in enumerate(names) if t and n in t] for i, t in enumerate(rows)}
    with pytest.raises(ValueError):
        keywords.places(F.col("t"), ("a", "a"))


def test_a_keyword_of_two_classes_counts_for_both(spark):
    word = config.NON_TECH[0]
    score = lambda extra: spark.range(1).select(text.tech_score(F.lit(word), F.lit(None), F.lit(""), F.lit("x"), extra)).first()[0]
    assert score(()) == 0.0 and score((word,)) == pytest.approx(1 / 30)
