"""Streams give what their batch twins give on the same rows."""

import pytest
from pyspark.sql import functions as F

from loomwork.operators import timelines
from loomwork.streaming import operators as O

DATA = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def calls(spark):
    return spark.read.parquet(DATA).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k")).orderBy("ts")


@pytest.fixture
def stream(spark, calls, tmp_path):
    calls.coalesce(1).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(calls.schema).parquet(f"{tmp_path}/in")


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def same(a, b, columns):
    rows = lambda df: sorted(map(str, df.select(columns).collect()))
    assert rows(a) == rows(b) and rows(b)


def test_rate_limit(spark, calls, stream):
    batch = O.rate_limit(calls, limit=2, seconds=40000)
    assert batch.where("not admitted").count() > 0
    same(run(spark, O.rate_limit_stream(stream, limit=2, seconds=40000), "rates"), batch, ["user_id", "event_id", "admitted", "remaining"])


def test_rate_limit_against_a_loop(calls):
    rows = {(r.user_id, r.event_id): (r.admitted, r.remaining) for r in O.rate_limit(calls, limit=2, seconds=40000).collect()}
    logs = {}
    for r in calls.orderBy("ts", "event_id").collect():
        at = int(r.ts.timestamp() * 1_000_000)
        ok, logs[r.user_id] = O.admit(logs.get(r.user_id, []), at, 2, 40000)
        assert rows[r.user_id, r.event_id][0] == ok


@pytest.mark.parametrize("hot", [0, 40])
def test_rate_limit_splits_hot_keys_at_pauses(spark, hot):
    import random

    rng, at, rows = random.Random(3), 1_700_000_000, []
    for i in range(900):
        at += rng.choice([0, 1, 2, 5, 20, 60, 61, 300])
        rows.append((i, 1 if i % 30 else i, at))
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts")).repartition(3)
    shape = lambda x: sorted(map(tuple, x.collect()))
    assert shape(O.rate_limit(df, limit=2, hot=hot)) == shape(O.rate_limit(df, limit=2))
    parts = O.split_at_pauses(df.select(F.col("user_id").alias("key"), F.col("event_id").alias("place"), F.unix_micros("ts").alias("at")).where("key = 1"), 60)
    assert parts.select("part").distinct().count() == 1 + sum(b - a >= 60 for a, b in zip(*(lambda t: (t, t[1:]))([s for _, u, s in rows if u == 1])))
    assert parts.repartition(4, "key", "part").select(F.spark_partition_id()).distinct().count() > 1


def test_topic_shift_stream_with_null_vectors(spark, tmp_path):
    rows = [(1, i, None if i in (2, 5) else [1.0, float(i)]) for i in range(8)]
    df = spark.createDataFrame(rows, "user_id long, vec_id long, embedding array<double>").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("vec_id")))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    same(run(spark, O.topic_shift_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 0.1), "nullshifts"), O.topic_shift(df, 0.1), ["user_id", "vec_id", "distance", "shifted"])


def test_gap_markers(spark, calls, stream):
    batch = timelines.gap_markers(calls, ["user_id"], longest=20000)
    same(run(spark, O.gap_markers_stream(stream, longest=20000), "gaps"), batch, ["user_id", "event_id", "gap_seconds"])


def test_aggregates(spark, calls, stream):
    same(run(spark, O.access_counters(stream), "access", "complete"), O.access_counters(calls), ["k", "retrievals", "last"])
    same(run(spark, O.usage_daily(stream), "usage", "complete"), O.usage_daily(calls), ["user_id", "day", "calls"])
    same(run(spark, O.failure_counts(stream), "failures", "complete"), O.failure_counts(calls), ["start", "n", "errors"])
    same(run(spark, O.sessions(stream, ["user_id"]), "sessions", "complete"), O.sessions(calls, ["user_id"]), ["user_id", "first", "last", "n"])


def test_hashes(spark, calls, stream):
    texts = stream.select("ts", F.concat(F.lit(" T"), F.col("event_id") % 7).alias("raw"))
    assert run(spark, O.incremental_hashes(texts, "40 days"), "hashes").count() == 7


def test_routes(spark, calls, stream):
    from loomwork.operators.predicates import route_events

    subs = spark.createDataFrame([(1, "view", None, None, 0.5), (2, "click", ["a"], None, None), (3, "error", None, ["t1"], None)], "subscription_id int, event_type string, filter_layers array<string>, filter_tags array<string>, min_importance double")
    shape = lambda df: df.select("event_id", "event_type", F.when(F.col("k") % 2 == 0, "a").otherwise("b").alias("layer"), F.array(F.concat(F.lit("t"), F.col("k") % 3)).alias("tags"), (F.col("k") / 100).alias("importance"))
    same(run(spark, route_events(shape(stream), subs), "routes"), route_events(shape(calls), subs), ["event_id", "subscription_id"])


def test_dedup_stream(spark, tmp_path):
    import datetime

    schema = "ts timestamp, memory_id long, user_id long, raw string, v array<double>, auto boolean"
    at = lambda n: datetime.datetime(2024, 1, 1, 0, n)
    one = [(at(0), 1, 7, "a", [1.0, 0.0], True), (at(0), 2, 7, "b", [0.0, 1.0], True), (at(1), 3, 7, " A", [1.0, 0.0], True)]
    two = [(at(2), 4, 7, "c", [0.96, 0.28], True), (at(2), 5, 7, "d", [0.28, 0.96], False), (at(2), 6, 8, "e", [1.0, 0.0], True), (at(2), 7, 8, "f", [0.96, 0.28], True)]
    for n, rows in enumerate((one, two)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        rejected = spark.createDataFrame([(2, 1)], "new_id long, old_id long")
        q = O.dedup_stream(stream, f"{tmp_path}/out", rejected, watermark="1 hour").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    found = sorted((r.new_id, r.old_id, r.similarity, r.action) for r in spark.read.parquet(f"{tmp_path}/out/actions").collect())
    kept = {r.memory_id for r in spark.read.parquet(f"{tmp_path}/out/held").collect()}
    assert len(kept & {1, 3}) == 1 and kept - {1, 3} == {2, 4, 5, 6, 7}
    assert found == [(4, (kept & {1, 3}).pop(), 0.96, "merge"), (5, 2, 0.96, "queue"), (7, 6, 0.96, "merge")]



def test_dedup_stream_equals_its_batch_twin_over_restarts_and_reads_its_cells_only(spark, tmp_path):
    import datetime

    import numpy as np

    rng, rows = np.random.default_rng(2), []
    for i in range(160):
        v = rng.normal(size=8) if i % 3 else np.array(rows[rng.integers(0, len(rows))][4]) + 0.2 * rng.normal(size=8) if rows else rng.normal(size=8)
        rows.append((datetime.datetime(2024, 1, 1, 0, i // 4), i, i % 2, f"text {i}", [float(x) for x in v / np.linalg.norm(v)], i % 5 != 0))
    schema = "ts timestamp, memory_id long, user_id long, raw string, v array<double>, auto boolean"
    rejected = spark.createDataFrame([(5, 4)], "new_id long, old_id long")
    for n in range(4):
        part = rows[n * 40 : (n + 1) * 40]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        O.dedup_stream(stream, f"{tmp_path}/out", rejected, 0.9, "1 hour").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    want = set()
    for n in range(4):
        part, before = rows[n * 40 : (n + 1) * 40], rows[: (n + 1) * 40]
        for r in part:
            found = sorted((-round(float(np.dot(r[4], o[4])), 6), o[1]) for o in before if o[1] != r[1] and o[2] == r[2])
            if found and -found[0][0] >= 0.9:
                s, other = -found[0][0], found[0][1]
                new, old = (max(r[1], other), min(r[1], other)) if other >= n * 40 else (r[1], other)
                if (new, old) != (5, 4):
                    want.add((new, old, "merge" if new % 5 else "queue"))
    got = {(r.new_id, r.old_id, r.action) for r in spark.read.parquet(f"{tmp_path}/out/actions").collect()}
    assert want and got == want
    # what a vector reaches is a part of all cells, and its own is among them
    cells = spark.createDataFrame([(r[1], r[4]) for r in rows], "id long, v array<double>").select("id", O.reach_cells(F.col("v"), 0.9).alias("cells")).collect()
    assert all(sum(c.own for c in r.cells) == 1 for r in cells)
    own = {r.id: next(c.cell for c in r.cells if c.own) for r in cells}
    reach = {r.id: {c.cell for c in r.cells} for r in cells}
    pairs = [(a[1], b[1]) for a in rows for b in rows if np.dot(a[4], b[4]) >= 0.9]
    assert all(own[b] in reach[a] for a, b in pairs)
    assert sum(own[b] in reach[a] for a in own for b in own) < 0.8 * len(own) ** 2


def test_turn_batches(spark, tmp_path):
    turns = [(c, t) for c, n in ((1, 12), (2, 5), (3, 3)) for t in range(n)]
    at = lambda t: F.timestamp_seconds(F.lit(1_700_000_000) + t)
    rows = spark.createDataFrame(turns, "conv_id long, turn long").withColumn("ts", at(F.col("turn") * 10))
    for i, part in enumerate((rows.where("turn < 4"), rows.where("turn >= 4"), spark.createDataFrame([(9, 0)], "conv_id long, turn long").withColumn("ts", at(F.lit(90_000))))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    found = run(spark, O.turn_batches_stream(stream), "batches").where("conv_id < 9")
    same(found, O.turn_batches(rows), ["conv_id", "batch", "turns", "full"])
    assert found.where("not full").count() == 2


def test_topic_shift(spark, tmp_path):
    rows = spark.read.parquet(DATA.replace("events", "embeddings")).select(F.col("label").cast("long").alias("user_id"), F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("vec_id")).alias("ts"))
    rows.orderBy("vec_id").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    same(run(spark, O.topic_shift_stream(stream, 0.9), "shifts"), O.topic_shift(rows, 0.9), ["user_id", "vec_id", "distance", "shifted"])


def test_topic_changes_against_a_loop(spark):
    import random

    r = random.Random(5)
    scores = {(u, m): {t: r.choice([0.3, 0.6, 0.9]) for t in "abc" if r.random() < 0.5} for u in range(3) for m in range(40)}
    messages = spark.createDataFrame([(u, u * 100 + m) for u, m in scores], "user_id long, message_id long")
    topics = spark.createDataFrame([(u * 100 + m, t, s) for (u, m), ts in scores.items() for t, s in ts.items()], "message_id long, topic string, score double")
    want = {}
    for u, m in scores:
        past = [scores[u, x] for x in range(max(0, m - 4), m)]
        if past:
            means = {t: sum(p.get(t, 0) for p in past) / len(past) for t in "abc" if any(t in p for p in past)}
            gone = sorted(t for t in means if round(means[t] - scores[u, m].get(t, 0), 6) > 0.4)
            new = sorted(t for t, s in scores[u, m].items() if t not in means and s > 0.5)
            if gone or new:
                want[u, u * 100 + m] = (gone, new, 0.8 if new else 0.7)
    assert {(x.user_id, x.message_id): (x.departed, x.arrived, x.confidence) for x in O.topic_changes(messages, topics).collect()} == want and want
