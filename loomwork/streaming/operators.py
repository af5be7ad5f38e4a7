"""Stateful operators as Structured Streaming jobs, each with a batch twin on the same rows.

Streams work on event time. The default watermark is ten minutes; rows later than it are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from loomwork.operators.running import running_sum
from loomwork.session import written

WATERMARK = "10 minutes"


def sessions(calls: DataFrame, keys: list[str], gap: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """(keys, first, last, n): rows of a key with less than `gap` between them. A stream needs a watermark."""
    rows = calls.withWatermark("ts", watermark) if watermark else calls
    s = rows.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select(*keys, F.col("w.start").alias("first"), F.col("w.end").alias("last"), "n")


def failure_counts(calls: DataFrame, length: str = "1 hour", slide: str = "5 minutes", watermark: str | None = None) -> DataFrame:
    """(start, n, errors) of sliding windows."""
    rows = calls.withWatermark("ts", watermark) if watermark else calls
    w = rows.groupBy(F.window("ts", length, slide).alias("w")).agg(F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"))
    return w.select(F.col("w.start").alias("start"), "n", "errors")


def usage_daily(calls: DataFrame, key: str = "user_id", watermark: str | None = None) -> DataFrame:
    rows = calls.withWatermark("ts", watermark) if watermark else calls
    w = rows.groupBy(key, F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("calls"))
    return w.select(key, F.col("w.start").alias("day"), "calls")


def latency_guard(calls: DataFrame, limit: float, length: str = "5 minutes", slide: str = "1 minute", least: int = 10, open_for: str = "2 minutes", watermark: str | None = None) -> DataFrame:
    """(opened, closes, p95, n): sliding windows with enough samples whose 95th percentile is over the limit; the guard is open from a window's end."""
    rows = calls.withWatermark("ts", watermark) if watermark else calls
    w = rows.groupBy(F.window("ts", length, slide).alias("w")).agg(F.percentile_approx("value", 0.95, 10000).alias("p95"), F.count("*").alias("n"))
    bad = w.where((F.col("n") >= least) & (F.col("p95") > limit))
    return bad.select(F.col("w.end").alias("opened"), (F.col("w.end") + F.expr(f"interval {open_for}")).alias("closes"), "p95", "n")


def open_intervals(openings: DataFrame) -> DataFrame:
    """(opened, closes): the times in which the guard is open, overlapping and touching openings of latency_guard as one. Batch.

    Openings are at most one a slide, far fewer than calls; they are ordered within their day, and days that touch are joined after that.
    """
    def merge(rows: DataFrame, keys: list[str]) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("opened", "closes") if keys else Window.orderBy("opened", "closes")
        before = F.max("closes").over(order.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("new", F.coalesce((F.col("opened") > before).cast("int"), F.lit(1)))
        rows = rows.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return rows.groupBy(*keys, "part").agg(F.min("opened").alias("opened"), F.max("closes").alias("closes"))

    by_day = merge(openings.select(F.to_date("opened").alias("day"), "opened", "closes"), ["day"])
    return merge(by_day.select("opened", "closes"), []).select("opened", "closes")


def access_counters(calls: DataFrame, key: str = "k") -> DataFrame:
    """(key, retrievals, last): counts and newest times, an updating aggregate on streams."""
    return calls.where(F.col("event_type").isin("view", "click")).groupBy(key).agg(F.count("*").alias("retrievals"), F.max("ts").alias("last"))


#: Calls of a key that one task folds; a key with more is split at its pauses.
HOT_CALLS = 1_000_000


def rate_limit(calls: DataFrame, key: str = "user_id", limit: int = 3, seconds: int = 60, time: str = "ts", order: str = "event_id", hot: int = HOT_CALLS) -> DataFrame:
    """(key, order, admitted, remaining, retry_after): sliding-log admission in order of time; rejected calls don't count.

    Batch twin: a fold in Python over each key's calls, since whether a call counts depends on those before. The state is the log of
    admitted times, at most `limit` of them. A pause of `seconds` empties the log, so keys with more than `hot` calls are split there, exactly, into
    parts that are folded apart. retry_after: seconds, rounded up, until a rejected call would be admitted; else 0.
    """
    rows = calls.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("place"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, log = None, []
        for b in batches:
            out = []
            for k, part, place, at in zip(b["key"], b["part"], b["place"], b["at"]):
                if (k, part) != now:
                    now, log = (k, part), []
                ok, log = admit(log, at, limit, seconds)
                out.append((k, place, ok, limit - len(log), 0 if ok else wait(log, at, seconds)))
            yield pd.DataFrame(out, columns=LIMIT_COLUMNS)

    large = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key")
    parts = rows.withColumn("part", F.lit(0).cast("long"))
    if large.limit(1).count():
        large = written(large, "hot-keys")
        parts = parts.join(large, "key", "left_anti").unionByName(split_at_pauses(rows.join(large, "key", "left_semi"), seconds))
    out = parts.repartition("key", "part").sortWithinPartitions("key", "part", "at", "place").mapInPandas(fold, LIMIT_FIELDS)
    return out.withColumnsRenamed({"key": key, "place": order})


def split_at_pauses(rows: DataFrame, seconds: int) -> DataFrame:
    """rows(key, place, at in microseconds) with `part`: how many pauses of `seconds` or more the key had up to there.

    A key's calls are sorted by ranges over many tasks. A range finds its own pauses; the time before its first call, and the pauses before it, come from
    one row for each key and range.
    """
    ranged = rows.repartitionByRange("key", "at", "place").withColumn("range", F.spark_partition_id())
    ranged = written(ranged, "by-time")
    ends = ranged.groupBy("key", "range").agg(F.max("at").alias("last"))
    ends = ends.select("key", "range", F.lag("last").over(Window.partitionBy("key").orderBy("range")).alias("before"))
    inside = F.lag("at").over(Window.partitionBy("key", "range").orderBy("at", "place"))
    known = ranged.join(ends, ["key", "range"]).withColumn("gap", F.col("at") - F.coalesce(inside, "before"))
    known = known.withColumn("pause", F.coalesce(F.col("gap") >= seconds * 1_000_000, F.lit(False)).cast("long"))
    known = running_sum(known, ["key"], F.col("range"), [F.col("at"), F.col("place")], F.col("pause"), "paused")
    return known.select("key", "place", "at", (F.col("paused") + F.col("pause")).alias("part"))


def admit(log: list[int], at: int, limit: int, seconds: int) -> tuple[bool, list[int]]:
    """Whether a call at this time (microseconds) is admitted, and the log after it."""
    log = [t for t in log if t > at - seconds * 1_000_000]
    return (True, [*log, at]) if len(log) < limit else (False, log)


LIMIT_COLUMNS = ["key", "place", "admitted", "remaining", "retry_after"]
LIMIT_FIELDS = "key long, place long, admitted boolean, remaining long, retry_after long"


def wait(log: list[int], at: int, seconds: int) -> int:
    """Whole seconds until the oldest call of a full log leaves the window."""
    return -(-(min(log) + seconds * 1_000_000 - at) // 1_000_000) if log else seconds


def rate_limit_stream(calls: DataFrame, key: str = "user_id", limit: int = 3, seconds: int = 60, watermark: str = WATERMARK) -> DataFrame:
    """The stream twin of rate_limit: keyed state holds the log; a key idle past the window and the watermark is dropped.

    A micro-batch's calls of a key are taken in order of time.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    rows = calls.withWatermark("ts", watermark).select(F.col(key).cast("long").alias("key"), F.col("event_id").cast("long").alias("place"), "ts", F.unix_micros("ts").alias("at"))

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        out = []
        for place, at in pd.concat(list(frames)).sort_values(["at", "place"])[["place", "at"]].itertuples(index=False):
            ok, log = admit(log, int(at), limit, seconds)
            out.append((k[0], place, ok, limit - len(log), 0 if ok else wait(log, int(at), seconds)))
        state.update((log,))
        if log:
            state.setTimeoutTimestamp(max(max(log) // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=LIMIT_COLUMNS)

    out = rows.groupBy("key").applyInPandasWithState(step, LIMIT_FIELDS, "log array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumnsRenamed({"key": key, "place": "event_id"})


def turn_batches(turns: DataFrame, n: int = 5) -> DataFrame:
    """(conv_id, batch, turns, full): turns in batches of n, the rest of a conversation being flushed as it goes idle."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = turns.withColumn("batch", F.floor(place / n))
    return rows.groupBy("conv_id", "batch").agg(F.sort_array(F.collect_list("turn")).alias("turns")).withColumn("full", F.size("turns") == n)


def turn_batches_stream(turns: DataFrame, n: int = 5, idle: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """The stream twin of turn_batches on turns(ts, conv_id, turn): a batch leaves once it has n turns, the rest once the conversation was idle in event time.

    State is the buffer, fewer than n turns, and the number of the next batch. A conversation that goes on after its rest was flushed begins at batch 0 again.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    fields = "conv_id long, batch long, turns array<long>, full boolean"
    wait_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = turns.withWatermark("ts", watermark).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "ts", F.unix_millis("ts").alias("at"))

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["conv_id", "batch", "turns", "full"])

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, batch, last = state.get if state.exists else ([], 0, 0)
        held = list(held)
        if state.hasTimedOut:
            state.remove()
            if held:
                yield frame([(k[0], batch, held, False)])
            return
        new = pd.concat(list(frames)).sort_values("turn")
        held, last, out = held + [int(t) for t in new["turn"]], max(last, int(new["at"].max())), []
        while len(held) >= n:
            out.append((k[0], batch, held[:n], True))
            held, batch = held[n:], batch + 1
        state.update((held, batch, last))
        state.setTimeoutTimestamp(max(last + wait_ms, state.getCurrentWatermarkMs() + 1))
        yield frame(out)

    return rows.groupBy("conv_id").applyInPandasWithState(step, fields, "held array<long>, batch long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def topic_shift(messages: DataFrame, limit: float = 0.4) -> DataFrame:
    """(user_id, vec_id, distance, shifted): cosine distance to the message before; a user's first one counts as a shift."""
    from loomwork.operators.vectors import dot, unit

    rows = messages.withColumn("v", unit(F.col("embedding")))
    rows = rows.withColumn("before", F.lag("v").over(Window.partitionBy("user_id").orderBy("vec_id")))
    distance = F.round(1 - dot(F.col("v"), F.col("before")), 6)
    return rows.select("user_id", "vec_id", distance.alias("distance"), F.coalesce(distance > limit, F.lit(True)).alias("shifted"))


def topic_shift_stream(messages: DataFrame, limit: float = 0.4, keep: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """The stream twin of topic_shift on messages(ts, user_id, vec_id, embedding): state is a user's last unit vector, forgotten when idle for `keep`.

    A micro-batch's messages of a user are taken in order of time, then of vec_id; the first one after a pause counts as a shift.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    from loomwork.operators.vectors import unit

    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = messages.withWatermark("ts", watermark).select(F.col("user_id").cast("long").alias("user_id"), "vec_id", "ts", F.unix_millis("ts").alias("at"), unit(F.col("embedding")).alias("v"))

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before, last = state.get if state.exists else (None, 0)
        out = []
        for i, at, v in pd.concat(list(frames)).sort_values(["at", "vec_id"])[["vec_id", "at", "v"]].itertuples(index=False):
            if v is None:  # as in the batch twin: it has no distance, and neither has the message after it
                out.append((k[0], i, None, True))
                before, last = None, max(last, int(at))
                continue
            if before is not None and at - last > keep_ms:
                before = None
            distance = None if before is None else round(1 - sum(a * b for a, b in zip(v, before)), 6)
            out.append((k[0], i, distance, distance is None or distance > limit))
            before, last = [float(x) for x in v], max(last, int(at))
        state.update((before, last))
        state.setTimeoutTimestamp(max(last + keep_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "vec_id", "distance", "shifted"])

    fields = "user_id long, vec_id long, distance double, shifted boolean"
    return rows.groupBy("user_id").applyInPandasWithState(step, fields, "v array<double>, last long", "append", GroupStateTimeout.EventTimeTimeout)


def topic_changes(messages: DataFrame, topics: DataFrame, window: int = 5, drop: float = 0.4, arrive: float = 0.5) -> DataFrame:
    """(user_id, message_id, departed, arrived, confidence): how a message's topics differ from their means over the window - 1 messages before it.

    messages(user_id, message_id) in order of message_id; topics(message_id, topic, score), one row a topic and message. departed: the mean is more
    than `drop` above the message's score; arrived: new in the window and above `arrive`. Messages without either, and a user's first, have no row.
    A score is sent to the few messages that it counts for, so that all meets by equality; nothing of a user is gathered.
    """
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("message_id"))
    placed = messages.select("user_id", "message_id", place.alias("place"))
    scores = topics.select("message_id", "topic", "score").join(placed, "message_id")
    sent = scores.select("user_id", "topic", "score", "place", F.explode(F.sequence(F.lit(0), F.lit(window - 1))).alias("ahead"))
    mean = F.sum(F.when(F.col("ahead") > 0, F.col("score")))
    now = F.max(F.when(F.col("ahead") == 0, F.col("score")))
    met = sent.groupBy("user_id", (F.col("place") + F.col("ahead")).alias("place"), "topic").agg(mean.alias("total"), now.alias("now"))
    before = F.col("total") / F.least(F.col("place") - 1, F.lit(window - 1))
    departed = F.round(before - F.coalesce("now", F.lit(0.0)), 6) > drop
    arrived = F.col("total").isNull() & (F.col("now") > arrive)
    changed = met.where("place > 1").where(departed | arrived).select("user_id", "place", F.when(departed, F.col("topic")).alias("d"), F.when(arrived, F.col("topic")).alias("a"))
    rows = changed.groupBy("user_id", "place").agg(F.sort_array(F.collect_set("d")).alias("departed"), F.sort_array(F.collect_set("a")).alias("arrived"))
    rows = rows.join(placed, ["user_id", "place"])
    return rows.select("user_id", "message_id", "departed", "arrived", F.when(F.size("arrived") > 0, 0.8).otherwise(0.7).alias("confidence"))


def gap_markers_stream(calls: DataFrame, key: str = "user_id", longest: int = 600, watermark: str = WATERMARK, keep_days: int = 90) -> DataFrame:
    """The stream twin of gap_markers: keyed state holds the last time; rows that are late within the watermark are taken as they come.

    A key without a call for keep_days of event time is forgotten, and its next call starts anew, without a marker.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    rows = calls.withWatermark("ts", watermark).select(F.col(key).cast("long").alias("key"), F.col("event_id").cast("long").alias("place"), "ts", F.unix_micros("ts").alias("at"))

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for place, at in pd.concat(list(frames)).sort_values(["at", "place"])[["place", "at"]].itertuples(index=False):
            gap = None if last is None else at // 1_000_000 - last // 1_000_000
            if gap is not None and gap > longest:
                out.append((k[0], place, gap))
            last = at if last is None else max(last, at)
        state.update((int(last),))
        state.setTimeoutTimestamp(max(int(last) // 1000 + keep_days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "place", "gap_seconds"])

    out = rows.groupBy("key").applyInPandasWithState(step, "key long, place long, gap_seconds long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumnsRenamed({"key": key, "place": "event_id"})


def incremental_hashes(texts: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """A stream of texts(ts, raw) without those whose content was seen within the watermark; feed it to incremental_dedup by foreachBatch."""
    from loomwork.operators.dedup import content_hash

    return texts.withColumn("hash", content_hash(F.col("raw"))).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["hash"])


#: Fixed directions against which held vectors are sliced by angle; each takes three slices of a search at most.
DIRECTIONS = 2


def reach_cells(vector: Column, least: float, directions: int = DIRECTIONS, seed: int = 11) -> Column:
    """array<struct<cell, own>>: the cells in which a vector as similar as `least` can lie, and which of them is the vector's own.

    A cell is a slice of angles to each of some fixed directions, as wide as the angle that `least` allows. Two vectors differ in
    their angle to anything by no more than the angle between them, so a pair that reaches `least` meets in one cell: nothing is lost.
    """
    width = float(np.arccos(min(1.0, max(-1.0, least)))) + 1e-6

    @F.pandas_udf("array<struct<cell: string, own: boolean>>")
    def cells(vs):
        fixed, out = {}, []
        for v in vs:
            v = np.asarray(v, float)
            if len(v) not in fixed:
                r = np.random.default_rng(seed).normal(size=(len(v), directions))
                fixed[len(v)] = r / np.linalg.norm(r, axis=0, keepdims=True)
            angles = np.arccos(np.clip(v @ fixed[len(v)], -1, 1))
            own = tuple(np.floor(angles / width).astype(int))
            sides = [range(int(max(0, a - width) // width), int(min(np.pi, a + width) // width) + 1) for a in angles]
            out.append([{"cell": ".".join(map(str, c)), "own": c == own} for c in product(*sides)])
        return pd.Series(out)

    return cells(vector)


class CellSearch(StatefulProcessor):
    """Holds the vectors of one user's cell and gives, for each vector that looks in, the most similar of them and of those that came with it."""

    OUT = "new_id long, new_auto boolean, own boolean, held long, old_id long, old_auto boolean, similarity double"

    def __init__(self, least: float) -> None:
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "id long, v array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows), ignore_index=True).sort_values("memory_id", ignore_index=True)
        old = list(self.held.get())
        mine = new[new["own"]]
        if len(mine):
            self.held.appendList([(int(i), [float(x) for x in v]) for i, v in zip(mine["memory_id"], mine["v"])])
        out = pd.DataFrame({"new_id": new["memory_id"], "new_auto": new["auto"].astype(bool), "own": new["own"], "held": len(old), "old_id": None, "old_auto": None, "similarity": None})
        ids = np.array([r[0] for r in old] + list(mine["memory_id"]), dtype=np.int64)
        if len(ids):
            s = np.round(np.vstack(list(new["v"])) @ np.vstack([r[1] for r in old] + list(mine["v"])).T, 6)
            s[new["memory_id"].to_numpy()[:, None] == ids[None, :]] = -2
            order = np.argsort(ids, kind="stable")  # of the most similar the smallest id
            best = order[s[:, order].argmax(axis=1)]
            autos = [None] * len(old) + [bool(x) for x in mine["auto"]]
            for i, (k, top) in enumerate(zip(best, s[np.arange(len(new)), best])):
                if top >= self.least:
                    out.loc[i, ["old_id", "old_auto", "similarity"]] = [int(ids[k]), autos[k], float(top)]
        yield out[out["own"] | out["old_id"].notna()].astype({"old_id": "Int64", "old_auto": "boolean", "similarity": "float64"})

    def close(self) -> None:
        pass


def dedup_stream(memories: DataFrame, folder: str, rejected: DataFrame, least: float = 0.8, watermark: str = WATERMARK) -> DataStreamWriter:
    """Near-duplicates of a stream of memories(ts, memory_id, user_id, raw, v unit vector, auto) as they arrive; start() it with a checkpoint of its own.

    Contents seen within the watermark are dropped; each other memory's nearest one, among all held before and those beside it, is
    judged as in dedup.incremental_dedup. Vectors are held in keyed state, by user and cell of reach_cells, so a micro-batch reads the cells
    that its own vectors reach and no others; the state is in RocksDB, in the stream's checkpoint. folder/actions and folder/held (the ids that
    came in) get one subfolder a micro-batch, overwritten when it is run again, so that a restart neither loses nor doubles rows. Rows with a null vector are dropped.
    """
    from loomwork.operators.dedup import incremental_dedup

    spark = memories.sparkSession
    # keyed state of this kind is kept in RocksDB only
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = incremental_hashes(memories.where(F.col("v").isNotNull()), watermark)
    looks = rows.select("memory_id", "user_id", "v", "auto", F.inline(reach_cells(F.col("v"), least)))
    found = looks.groupBy("user_id", "cell").transformWithStateInPandas(CellSearch(least), CellSearch.OUT, "Append", "None")

    def step(batch: DataFrame, n: int) -> None:
        batch = written(batch, "found")
        batch.where("own").select(F.col("new_id").alias("memory_id")).write.mode("overwrite").parquet(f"{folder}/held/batch={n}")
        best = batch.where("old_id is not null").groupBy("new_id", "new_auto").agg(F.min_by(F.struct("old_id", "old_auto", "similarity"), F.struct(-F.col("similarity"), "old_id")).alias("b")).select("new_id", "new_auto", "b.*")
        # of two that came together the larger id is the new one
        swap = F.col("old_auto").isNotNull() & (F.col("new_id") < F.col("old_id"))
        turned = lambda a, b, name: F.when(swap, F.col(b)).otherwise(F.col(a)).alias(name)
        pairs = best.select(turned("new_id", "old_id", "new_id"), turned("old_id", "new_id", "old_id"), "similarity", turned("new_auto", "old_auto", "auto")).distinct()
        safety = pairs.select(F.col("new_id").alias("memory_id"), "auto").distinct()
        incremental_dedup(pairs.drop("auto"), rejected, safety, least).write.mode("overwrite").parquet(f"{folder}/actions/batch={n}")

    return found.writeStream.foreachBatch(step)
