"""Empty tables, equal and null ids, repeated rows, very long texts and clashing names: scoring, join, decontamination, pipeline."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from newslake.llm import common, decontaminate, lm_scoring, ngram_join

LONG = "long text of words " * 60_000


def odd(spark, *texts):
    rows = [(1, t, "x", 5, "y") for t in texts] + [(None, t, None, None, None) for t in texts[:2]] + [(7, LONG, "x", 1, "z"), (8, None, "x", 1, "z"), (8, "", "x", 1, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, node string, n_words int, component string")


def test_lm_scores(spark):
    df = odd(spark, "a b c", "a b c", "d e")
    got = lm_scoring.lm_scores(df, F.lit(False))[0].collect()
    assert len(got) == 8 and sorted(x.n_tokens for x in got) == [1, 1, 3, 4, 4, 4, 4, 240_001]
    same = [round(x.score, 9) for x in got if x.n_tokens == 4]
    assert len(set(same)) == 1


def test_ngram_join(spark):
    r = random.Random(1)
    prose = [" ".join(f"w{r.randrange(10**6)}" for _ in range(40)) for _ in range(3)]
    got = ngram_join.similar_groups(odd(spark, prose[0], prose[0], prose[1])).collect()
    assert len(got) == 8 and sorted(x.n_shingles for x in got) == [0, 0, 4, 36, 36, 36, 36, 36]
    assert {x.n_links for x in got if x.n_shingles == 36} == {3, 0} and max(x.n_links for x in got) == 3


def test_decontamination_tells_rows_apart(spark):
    leak = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, leak), (2, "zz"), (2, "zz")], "item_id long, text string")
    df = odd(spark, f"x {leak} y", "clean", f"x {leak} y")
    got = decontaminate.digest(decontaminate.hits(df, bench)).collect()
    assert len(got) == 8 and sorted((x.n_words, x.n_hit) for x in got) == [(0, 0), (0, 0), (1, 0), (1, 0), (12, 10), (12, 10), (12, 10), (240_000, 0)]
    kept = decontaminate.drop_contaminated(df, bench).collect()
    assert sorted(str((x.doc_id, (x.text or "")[:5])) for x in kept) == sorted(map(str, [(1, "clean"), (None, "clean"), (7, "long "), (8, ""), (8, "")]))
    assert decontaminate.hits(df.limit(0), bench).count() == 0
    join = decontaminate.hits(df, bench, decontaminate.Decontamination(most_broadcast=0))
    assert sorted(x.n_hit for x in join.collect()) == [0, 0, 0, 0, 0, 10, 10, 10]


def test_table_grows_with_the_windows(spark):
    windows = spark.range(5000).select(F.xxhash64("id").alias("probe"))
    table, slots = decontaminate._bit_table(windows, 5000)
    assert slots == 1 << (18 - 6)
    assert windows.where(decontaminate._may_match((table, slots), F.col("probe"))).count() == 5000
    other = spark.range(5000, 25_000).select(F.xxhash64("id").alias("probe"))
    assert other.where(decontaminate._may_match((table, slots), F.col("probe"))).count() < 1000
    assert decontaminate._bit_table(windows, 10**9)[1] == 1 << (24 - 6)


def test_pipeline_of_odd_tables(spark, tmp_path):
    r = random.Random(4)
    prose = " ".join("".join(r.choice("abcdefghijklmnopqrst") for _ in range(7)) for _ in range(60))
    schema = "doc_id long, text string, lang string, source string, n_chars long, bucket int, length int"
    rows = [(1, prose, "en", "s", 1, 2, 3)] * 2 + [(None, prose[::-1], None, None, None, None, None), (3, None, "en", "s", 0, 0, 0), (4, LONG, "en", "s", 1, 1, 1)]
    bench = spark.createDataFrame([(1, "never there at all")], "item_id long, text string")
    for name, some in (("full", rows), ("empty", rows[:0])):
        spark.createDataFrame(some, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        bench.write.parquet(str(tmp_path / name / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "full" / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path / "full"))
        assert docs.columns == [x.split()[0] for x in schema.split(", ")]
    assert sorted(x.doc_id or 0 for x in docs.collect()) == [0, 1]
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path / "full")).collect()} == {None, 1}
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_shuffle_files_go_where_the_session_does_not_say_so(spark):
    assert common._CLEANUP not in dict(spark.sparkContext.getConf().getAll())
    before = spark.conf.get(common._CLEANUP)
    with common.tidy(spark):
        assert spark.conf.get(common._CLEANUP) == "true"
        with common.tidy(spark):
            assert spark.conf.get(common._CLEANUP) == "true"
        assert spark.conf.get(common._CLEANUP) == "true"
    assert spark.conf.get(common._CLEANUP) == before
