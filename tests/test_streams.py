"""Stream forms against their batch twins, over several runs with new files."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from newslake.operators import engagement, notify, runs
from newslake.operators import dedupe
from newslake.streaming import ingest, streams
from newslake.streaming.keyed import upsert_available

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id long, event_type string, props string, ts timestamp"


@pytest.fixture
def landed(spark, tmp_path):
    r = random.Random(1)
    kinds = ("view", "purchase", "signup", "error")
    rows = [(i, r.randrange(5), r.choice(kinds), f'{{"k": {r.randrange(8)}}}', START + dt.timedelta(seconds=60 * i + r.randrange(50))) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)

    def land(part):
        df.where(f"event_id % 400 >= {part * 200} and event_id % 400 < {part * 200 + 200}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    return df, land, stream, tmp_path


def _key():
    return F.regexp_extract("props", "[0-9]+", 0).cast("long")


def test_cooldown(spark, landed):
    df, land, stream, tmp = landed
    for part in (0, 1):
        land(part)
        streams.append_available(streams.cooldown(stream().select(F.col("user_id").alias("key"), "ts"), 1800), str(tmp / "sent"), str(tmp / "c1"))
    got = sorted((r.key, r.epoch) for r in spark.read.parquet(str(tmp / "sent")).collect())
    assert got == sorted((r.key, r.epoch) for r in notify.cooldown(df.select(F.col("user_id").alias("key"), "ts"), 1800).collect()) and got


def test_read_history(spark, landed):
    df, land, stream, tmp = landed
    reads = lambda x: x.where("event_type = 'view'").select("user_id", _key().alias("article_id"), F.col("ts").alias("read_at"))
    for part in (0, 1):
        land(part)
        table = upsert_available(streams.read_history(reads(stream()), 4), str(tmp / "history"), ["user_id", "pos"], str(tmp / "c2"))
    got = sorted((r.user_id, r.article_id, r.pos) for r in table.read().collect())
    assert got == sorted((r.user_id, r.article_id, r.pos) for r in engagement.read_history(reads(df), 4).collect())


def test_counters_marks_and_owners(spark, landed):
    df, land, stream, tmp = landed
    marks = lambda x: x.where("event_type = 'purchase'").select("user_id", _key().alias("article_id"))
    op = F.when(F.col("event_type") == "signup", "register").otherwise("unregister")
    tokens = lambda x: x.where("event_type in ('signup', 'error')").select(_key().alias("token"), "user_id", op.alias("op"), "ts", "event_id")
    for part in (0, 1):
        land(part)
        tables = {
            "n": upsert_available(streams.counters(stream()), str(tmp / "n"), ["article_id"], str(tmp / "c3"), every=2),
            "m": upsert_available(streams.bookmark_state(marks(stream())), str(tmp / "m"), ["user_id", "article_id"], str(tmp / "c4")),
            "o": upsert_available(streams.token_owner(tokens(stream())), str(tmp / "o"), ["token"], str(tmp / "c5")),
        }
    last = lambda name: {tuple(r) for r in tables[name].read().collect()}
    n = df.groupBy(_key().alias("article_id")).agg(F.count_if(F.col("event_type") == "view"), F.count_if(F.col("event_type") == "purchase"))
    assert last("n") == {tuple(r) for r in n.collect()}
    assert last("m") == {tuple(r) for r in engagement.bookmark_state(marks(df)).collect()}
    assert {x for x in last("o") if x[1] is not None} == {tuple(r) for r in engagement.token_owner(tokens(df)).collect()}


def test_quota_and_late_rows(spark, landed):
    df, land, stream, tmp = landed
    land(0)
    land(1)
    table = upsert_available(streams.quota(stream(), 2), str(tmp / "q"), ["user_id", "window_start"], str(tmp / "c6"))
    got = {tuple(r) for r in table.read().collect()}
    assert got == {tuple(r) for r in runs.quota(df, 2).select("user_id", "window_start", "n", "blocked").collect()}
    # events after the window's watermark are left out
    spark.createDataFrame([(1000, 1, "view", "{}", START)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp / "in"))
    upsert_available(streams.quota(stream(), 2), str(tmp / "q"), ["user_id", "window_start"], str(tmp / "c6"))
    assert {tuple(r) for r in table.read().collect()} == got


def test_dedupe_on_one_key(spark, landed):
    df, land, stream, tmp = landed
    land(0)
    land(1)
    keyed = lambda x: x.select("props", F.col("ts").alias("published_at"))
    streams.append_available(streams.dedupe(keyed(stream()), "props"), str(tmp / "d"), str(tmp / "c7"))
    assert spark.read.parquet(str(tmp / "d")).count() == df.select("props").distinct().count()


def test_trailing_rate(spark, landed):
    """Events of the last minutes, in any order, over several runs; the last, far ahead, moves the watermark past all."""
    _, _, _, tmp = landed
    r = random.Random(8)
    rows = [(i, r.randrange(3), "view", "{}", START + dt.timedelta(seconds=i + r.uniform(-40, 40))) for i in range(300)]
    for part in range(3):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp / "rate"))
        run = lambda: streams.append_available(streams.trailing_rate(spark.readStream.schema(SCHEMA).parquet(str(tmp / "rate")), late="3 minutes"), str(tmp / "r"), str(tmp / "c8"))
        run()
    assert spark.read.parquet(str(tmp / "r")).count() < 300
    spark.createDataFrame([(1000, u, "view", "{}", START + dt.timedelta(days=1)) for u in range(3)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp / "rate"))
    run()
    want = {(x.event_id, x.user_id, x.rate) for x in runs.trailing_rate(spark.createDataFrame(rows, SCHEMA)).collect()}
    got = spark.read.parquet(str(tmp / "r")).collect()
    assert {tuple(x) for x in got} == want and len(got) == 300


def test_cooldown_starts_after_a_successful_send(spark, tmp_path):
    rows = [(u, START + dt.timedelta(minutes=m), ok) for u in (1, 2) for m, ok in ((0, False), (5, u == 1), (12, True), (14, False), (40, False), (41, True), (50, True), (75, False), (76, False))]
    kind = "key long, ts timestamp, ok boolean"
    events, outcome = spark.createDataFrame(rows, kind), {(k, ts): ok for k, ts, ok in rows}
    source, results, out = (str(tmp_path / x) for x in ("in", "results", "sent"))
    spark.createDataFrame([], kind).write.parquet(results)
    known, late = set(), START + dt.timedelta(minutes=13)
    for step in range(9):  # the later candidates come while sends of the earlier ones are under way
        if step in (0, 1):
            events.where((F.col("ts") > late) == bool(step)).drop("ok").coalesce(1).write.mode("append").parquet(source)
        read = lambda path, schema: spark.readStream.schema(schema).parquet(path)
        streams.append_available(streams.confirmed_cooldown(read(source, "key long, ts timestamp"), read(results, kind), 1800), out, str(tmp_path / "c"))
        sent = {(r.key, r.ts) for r in spark.read.parquet(out).collect()}
        if sent == known:
            break
        spark.createDataFrame([(k, ts, outcome[k, ts]) for k, ts in sent - known], kind).coalesce(1).write.mode("append").parquet(results)
        known = sent
    want = {(r.key, r.epoch) for r in notify.cooldown(events, 1800).collect()}
    assert {(k, int(ts.replace(tzinfo=dt.UTC).timestamp())) for k, ts in known} == want
    assert len(want) == 10 and notify.cooldown(events.drop("ok"), 1800).count() == 6


def test_ingest_equals_the_batch_verdict(spark, tmp_path):
    r = random.Random(6)
    words = [f"word{i}" for i in range(9)]

    def title():
        w = list(words)
        if r.random() < 0.7:
            w[r.randrange(9)] = f"other{r.randrange(4)}"
        return " ".join(w)

    kind = "article_id long, title string, content string, source_url string, published_at timestamp"
    rows = [(i, title(), f"text {r.randrange(30)}", f"https://s.com/{r.randrange(40)}", START) for i in range(60)]
    rows += [(60 + i, rows[i * 5][1], rows[i * 5][2], f"https://s.com/new{i}", START) for i in range(6)]
    old = [(100 + i, t, c, u, at) for i, (_, t, c, u, at) in enumerate(rows[:3])]
    stream = lambda: spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for part in (rows[:25], rows[25:26], rows[26:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.ingest_available(stream(), out, str(tmp_path / "c"), F.lit(START + dt.timedelta(days=6)))
    want = {x.article_id: (x.match_type, x.matched_id) for x in dedupe.verdicts(dedupe.keyed(spark.createDataFrame(rows, kind))).collect()}
    found = lambda: {x.article_id: (x.match_type, x.matched_id) for x in spark.read.parquet(f"{out}/verdicts").collect()}
    assert found() == want and len({k for k, _ in want.values()}) == 4
    # a week later what was accepted is beyond the horizon
    spark.createDataFrame(old, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.ingest_available(stream(), out, str(tmp_path / "c"), F.lit(START + dt.timedelta(days=8)))
    assert found()[100] == ("none", None)
