"""The day-partitioned store and the keyed tables: which files are touched, and what a stop in the middle leaves."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newslake.sources import files, store
from newslake.streaming.keyed import KeyedTable, upsert_available

NOW = dt.datetime(2024, 5, 10, 12)


@pytest.fixture
def stored(spark, tmp_path):
    rows = [(i, NOW - dt.timedelta(hours=7 * i), float(i), None) for i in range(40)] + [(99, None, 1.0, None)]
    path = str(tmp_path / "store")
    store.append(spark.createDataFrame(rows, "article_id long, published_at timestamp, score double, cluster_id string"), path)
    return path, rows


def listing(path):
    import pathlib

    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("*.parquet")}


def test_window_reads_its_days_only(spark, stored):
    path, rows = stored
    got = store.window(spark, path, F.lit(NOW), 72)
    assert {r.article_id for r in got.collect()} == {i for i, at, *_ in rows if at and at >= NOW - dt.timedelta(hours=72)}
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(published_day" in plan and "published_day#" in plan.split("PartitionFilters:")[1].split("]")[0] and "2024-05-07" in plan.split("PartitionFilters:")[1]


def test_update_leaves_other_days_alone(spark, stored):
    path, rows = stored
    before = listing(path)
    changes = spark.createDataFrame([(0, -1.0), (1, -2.0), (20, -3.0), (99, -4.0), (12345, 0.0)], "article_id long, score double")
    days = store.update(spark, path, changes, "article_id", ["score"])
    want = {rows[i][1].date() if rows[i][1] else None for i in (0, 1, 20, 40)}
    assert set(days) == want and len(days) == len(want)
    after = listing(path)
    touched = {k.split("/")[0] for k in set(before) ^ set(after)}
    assert touched == {f"published_day={d or '__HIVE_DEFAULT_PARTITION__'}" for d in want}
    new = {0: -1.0, 1: -2.0, 20: -3.0, 99: -4.0}
    assert {r.article_id: r.score for r in spark.read.parquet(path).collect()} == {i: new.get(i, s) for i, _, s, _ in rows}
    assert store.update(spark, path, changes.where("article_id > 12000"), "article_id", ["score"]) == []
    with pytest.raises(ValueError):
        store.update(spark, path, changes, "article_id", ["published_at"])


def test_expiry_drops_whole_days(spark, stored):
    path, rows = stored
    before, cut = listing(path), NOW - dt.timedelta(days=5)
    assert store.expire(spark, path, F.lit(cut)) == sum(at is None or at < cut for _, at, *_ in rows)
    assert {r.article_id for r in spark.read.parquet(path).collect()} == {i for i, at, *_ in rows if at and at >= cut}
    kept = {k: v for k, v in before.items() if k.split("=")[1][:10] > str(cut.date()) and "HIVE" not in k}
    assert kept and kept.items() <= listing(path).items()


SCHEMA = "k long, v string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_a_batch_writes_its_own_size(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, SCHEMA, ["k"], buckets=4, every=5)
    table.write(frame(spark, [(i, "x" * 50) for i in range(5000)]), 0)
    want = {i: "x" * 50 for i in range(5000)}
    for n in range(1, 4):
        table.write(frame(spark, [(n, f"b{n}"), (10**6 + n, "new")]), n)
        want |= {n: f"b{n}", 10**6 + n: "new"}
        import pathlib

        size = lambda m: sum(p.stat().st_size for p in pathlib.Path(f"{path}/delta/{m}").rglob("*.parquet"))
        assert size(n) < size(0) / 10
        assert {r.k: r.v for r in table.read().collect()} == want
    table.write(frame(spark, [(5, "five")]), 4)  # the fifth delta: compacted
    want[5] = "five"
    assert table.manifest()["deltas"] == {} and {r.k: r.v for r in table.read().collect()} == want
    table.write(frame(spark, [(5, "again")]), 4)  # a batch that is in the base is not taken twice
    assert {r.k: r.v for r in table.read().collect()} == want
    for n in range(5, 16):
        table.write(frame(spark, [(n, "late")]), n)
        want[n] = "late"
    assert {r.k: r.v for r in table.read().collect()} == want
    assert len(files.names(spark, f"{path}/delta")) <= 2 * 5 and len(set(table.manifest()["base"].values())) <= 4


@pytest.mark.parametrize("at", ["delta", "commit", "compaction"])
def test_a_stop_in_mid_batch_loses_nothing(spark, tmp_path, monkeypatch, at):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "t", "c"))
    land = lambda rows: frame(spark, rows).coalesce(1).write.mode("append").parquet(source)
    counts = lambda: spark.readStream.schema(SCHEMA).parquet(source).groupBy("k").agg(F.count("*").alias("n"))
    run = lambda: upsert_available(counts(), path, ["k"], checkpoint, buckets=3, every=2)
    land([(1, "a"), (2, "a")])
    run()
    land([(1, "b"), (3, "b")])
    stop = {"delta": "_stored", "commit": "_commit", "compaction": "compact"}[at]
    with monkeypatch.context() as m:
        whole = getattr(KeyedTable, stop)

        def fails(self, *args):
            if at == "delta":
                whole(self, *args)  # written, and not yet named
            raise RuntimeError("stopped here")

        m.setattr(KeyedTable, stop, fails)
        with pytest.raises(Exception, match="stopped here"):
            run()
    table = run()
    land([(1, "c")])
    run()
    assert {r.k: r.n for r in table.read().collect()} == {1: 3, 2: 1, 3: 1}


def test_reading_an_empty_table(spark, tmp_path):
    assert KeyedTable(spark, str(tmp_path / "none"), SCHEMA, ["k"]).read().count() == 0
