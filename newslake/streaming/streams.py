"""Structured Streaming forms of the stateful operators; each has a batch twin in operators.

The cooldowns, trailing_rate and read_history keep state by key and need Spark's RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def dedupe(stream: DataFrame, key: str = "fingerprint", ts: str = "published_at", horizon: str = "7 days") -> DataFrame:
    return stream.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([key])


def counters(stream: DataFrame) -> DataFrame:
    """(article_id, view_count, bookmark_count), in update mode."""
    key = F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("article_id")
    return stream.groupBy(key).agg(F.count_if(F.col("event_type") == "view").alias("view_count"), F.count_if(F.col("event_type") == "purchase").alias("bookmark_count"))


def quota(stream: DataFrame, most: int, width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    n = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.col("w.start").alias("window_start"), "n", (F.col("n") > most).alias("blocked"))


class _Trailing(StatefulProcessor):
    """Of each event the number of the user's events in the `seconds` before its second and in that second. State: of each
    second the count and, until they are told, the ids; seconds that no open one needs are removed.

    A second's events are told once the watermark has passed it, as no more can come; a timer wakes the key then.
    """

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "at long", "n long, ids array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, list[int]] = {}
        for part in rows:
            for at, ids in part.groupby("at")["event_id"]:
                new.setdefault(int(at), []).extend(ids.tolist())
        for at, ids in new.items():
            n, before = self.held.getValue((at,)) if self.held.containsKey((at,)) else (0, [])
            self.held.updateValue((at,), (n + len(ids), [*before, *ids]))
            self.handle.registerTimer((at + 1) * 1000)
            self.handle.registerTimer((at + self.seconds + 2) * 1000)  # by then no event can need it
        yield pd.DataFrame({"event_id": [], "user_id": [], "rate": []}, dtype="int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        held = sorted((k[0], v[0], list(v[1] or [])) for k, v in self.held.iterator())
        at, total = np.array([x[0] for x in held], np.int64), np.r_[0, np.cumsum([x[1] for x in held], dtype=np.int64)]
        out: list[tuple[int, int]] = []
        for i, (second, n, ids) in enumerate(held):
            if ids and second < passed:
                out += [(e, int(total[i + 1] - total[np.searchsorted(at, second - self.seconds)])) for e in ids]
                self.held.updateValue((second,), (n, []))
            if second < passed - self.seconds:
                self.held.removeKey((second,))
        yield pd.DataFrame({"event_id": [e for e, _ in out], "user_id": [key[0]] * len(out), "rate": [r for _, r in out]}, dtype="int64")

    def close(self) -> None:
        pass


def trailing_rate(stream: DataFrame, seconds: int = 60, late: str = "1 hour") -> DataFrame:
    """(event_id, user_id, rate): the user's requests of the last `seconds`, those of the event's own second included; in
    append mode, an event once the watermark has passed its second. The batch twin is runs.trailing_rate."""
    rows = stream.withWatermark("ts", late).select("event_id", "user_id", "ts", F.unix_timestamp("ts").alias("at"))
    return rows.groupBy("user_id").transformWithStateInPandas(_Trailing(seconds), "event_id long, user_id long, rate long", "Append", "EventTime")


def bookmark_state(stream: DataFrame) -> DataFrame:
    return stream.groupBy("user_id", "article_id").agg((F.count("*") % 2 == 1).alias("bookmarked"))


def token_owner(stream: DataFrame) -> DataFrame:
    """(token, user_id): its last registering user, null once it was unregistered last; in update mode, so that a table
    of owners drops the tokens whose user becomes null."""
    last = stream.groupBy("token").agg(F.max_by(F.struct("user_id", "op"), F.struct("ts", "event_id")).alias("last"))
    return last.select("token", F.when(F.col("last.op") == "register", F.col("last.user_id")).alias("user_id"))


class _Cooldown(StatefulProcessor):
    """Of a key's candidates in order of time, those `seconds` or more after the last sent one. State: that one's time.

    A micro-batch is taken in time order; a candidate older than the last sent one is not sent.
    """

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sent = handle.getValueState("sent", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(int(t) for part in rows for t in part["at"])
        last = self.sent.get()[0] if self.sent.exists() else None
        out = []
        for at in times:
            if last is None or at - last >= self.seconds * 1_000_000:
                out.append(at)
                last = at
        if out:
            self.sent.update((last,))
            yield pd.DataFrame({"key": [key[0]] * len(out), "epoch": [at // 1_000_000 for at in out]})

    def close(self) -> None:
        pass


def cooldown(stream: DataFrame, seconds: int = 3600) -> DataFrame:
    """(key, epoch) of the candidates (key, ts) that are sent; in append mode. The batch twin is notify.cooldown."""
    rows = stream.where("ts is not null").select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("key").transformWithStateInPandas(_Cooldown(seconds), f"key {kind}, epoch long", "Append", "None")


class _Confirmed(StatefulProcessor):
    """Candidates and send results of a key. A candidate that is told waits for its result; those that come meanwhile queue.
    A success starts the cooldown, a failure leaves the next candidate free. State: the last success, the time under way,
    the queue."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "success long, way long")
        self.queue = handle.getListState("queue", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        success, way = self.state.get() if self.state.exists() else (None, None)
        queue = [x[0] for x in self.queue.get()] if self.queue.exists() else []
        results: dict[int, bool] = {}
        for part in rows:
            for at, ok in zip(part["at"].tolist(), part["ok"].tolist(), strict=True):
                if ok is None or ok != ok:
                    queue.append(int(at))
                else:
                    results[int(at)] = results.get(int(at), False) or bool(ok)
        queue.sort()
        told = []
        while True:
            if way is not None:
                if way not in results:
                    break
                success, way = (way, None) if results[way] else (success, None)
            start = 0 if success is None else bisect.bisect_left(queue, success + self.seconds * 1_000_000)
            queue = queue[start:]
            if not queue:
                break
            way = queue.pop(0)
            told.append(way)
        self.state.update((success, way))
        if queue:
            self.queue.put([(x,) for x in queue])
        else:
            self.queue.clear()
        yield pd.DataFrame({"key": [key[0]] * len(told), "at": told})

    def close(self) -> None:
        pass


def confirmed_cooldown(candidates: DataFrame, results: DataFrame, seconds: int = 3600) -> DataFrame:
    """(key, ts) of the candidates (key, ts) to be sent, given the results (key, ts of the candidate, ok) of those sent
    before; in append mode. One send of a key is under way at a time. Candidates of one time are taken one by one, and have
    one result. The batch twin is notify.cooldown with ok."""
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    rows = candidates.where("ts is not null").select("key", at, F.lit(None).cast("boolean").alias("ok"))
    rows = rows.union(results.where("ts is not null").select("key", at, F.coalesce("ok", F.lit(False))))
    kind = dict(rows.dtypes)["key"]
    out = rows.groupBy("key").transformWithStateInPandas(_Confirmed(seconds), f"key {kind}, at long", "Append", "None")
    return out.select("key", F.timestamp_micros("at").alias("ts"))


class _History(StatefulProcessor):
    """A reader's latest read of each article, the `most` newest. State: one row an article."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reads = handle.getMapState("reads", "article_id long", "read_at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: v[0] for k, v in self.reads.iterator()}
        for part in rows:
            for article, at in zip(part["article_id"], part["read_at"], strict=True):
                held[int(article)] = max(int(at), held.get(int(article), int(at)))
        kept = sorted(held, key=lambda a: (-held[a], a))[: self.most]
        for article in set(held) - set(kept):
            if self.reads.containsKey((article,)):
                self.reads.removeKey((article,))
        for article in kept:
            self.reads.updateValue((article,), (held[article],))
        yield pd.DataFrame({"user_id": [key[0]] * len(kept), "article_id": kept, "pos": range(1, len(kept) + 1)})

    def close(self) -> None:
        pass


def read_history(stream: DataFrame, most: int = 100) -> DataFrame:
    """(user_id, article_id, pos) of every reader with new reads (user_id, article_id, read_at timestamp), the whole list
    each time; in update mode. The batch twin is engagement.read_history."""
    rows = stream.select("user_id", "article_id", F.unix_micros(F.col("read_at").cast("timestamp")).alias("read_at"))
    return rows.groupBy("user_id").transformWithStateInPandas(_History(most), "user_id long, article_id long, pos long", "Update", "None")


def on_time(stream: DataFrame, as_of, ts: str = "published_at", late: str = "72 hours") -> DataFrame:
    """Invalid event times become as_of before the watermark."""
    from newslake.functions.text import normalize_date

    return stream.withColumn(ts, normalize_date(F.col(ts), as_of)).withWatermark(ts, late)


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "update") -> None:
    """Reads what is there since the last run and stops; offsets in the checkpoint make it incremental."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def append_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """The same into Parquet files, each row once; for streams in append mode."""
    q = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
