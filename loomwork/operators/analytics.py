"""Counts, shares, health figures and reports over memory tables. "Now" is always a parameter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.running import global_rank

INTERVALS = ("hour", "day", "week", "month")
LAYERS = ("IDENTITY", "PROJECT", "SESSION", "TASK", "INSIGHT")
TYPES = ("CONSTRAINT", "PREFERENCE", "FACT", "TASK", "EVENT", "LESSON")


def at(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """Per cent, 0 where the whole is 0."""
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), digits)


def hours_before(now: str, time: Column) -> Column:
    return (F.unix_timestamp(at(now)) - F.unix_timestamp(time.cast("timestamp"))) / 3600.0


def volume(df: DataFrame, interval: str, time: str = "created_at", key: str = "user_id") -> DataFrame:
    """(key, bucket, n, cumulative) for each bucket that has rows."""
    if interval not in INTERVALS:
        raise ValueError(f"interval must be one of {INTERVALS}")
    n = df.groupBy(key, F.date_trunc(interval, time).alias("bucket")).agg(F.count("*").alias("n"))
    return n.withColumn("cumulative", F.sum("n").over(Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))


def type_breakdown(df: DataFrame, interval: str = "week", types: tuple[str, ...] = TYPES) -> DataFrame:
    """A row for each bucket: a count for each type, the total (untyped rows too), and the most frequent type."""
    counts = [count_if(F.col("memory_type") == t).alias(f"n_{t.lower()}") for t in types]
    rows = df.groupBy(F.date_trunc(interval, "created_at").alias("bucket")).agg(F.count("*").alias("total"), *counts)
    best = F.greatest(*[F.col(f"n_{t.lower()}") for t in types])
    dominant = F.coalesce(*[F.when((F.col(f"n_{t.lower()}") == best) & (best > 0), F.lit(t)) for t in types])
    return rows.withColumn("dominant", dominant)


def layer_distribution(df: DataFrame, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """(user_id, layer, n, percent) with every layer for every user."""
    rows = df.groupBy("user_id").agg(F.count("*").alias("total"), *[count_if(F.col("layer") == x).alias(x) for x in layers])
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("layer"), F.col(x).alias("n")) for x in layers])).alias("e")
    return rows.select("user_id", "total", each).select("user_id", "e.layer", "e.n", share(F.col("e.n"), F.col("total")).alias("percent"))


def summary(df: DataFrame, now: str) -> DataFrame:
    """(user_id, total, today, this_week, avg_importance); weeks start on Sunday."""
    today = F.date_trunc("day", at(now))
    sunday = today - F.make_dt_interval(F.dayofweek(today) - 1)
    return df.groupBy("user_id").agg(
        F.count("*").alias("total"), count_if(F.col("created_at") >= today).alias("today"),
        count_if(F.col("created_at") >= sunday).alias("this_week"), F.round(F.avg("importance"), 6).alias("avg_importance"),
    )


def dashboard(df: DataFrame, now: str) -> DataFrame:
    """A single row: totals and last week against the week before; a change from nothing is the count itself."""
    age = hours_before(now, F.col("created_at")) / 24
    week, before = (age >= 0) & (age < 7), (age >= 7) & (age < 14)
    rows = df.agg(
        F.count("*").alias("memories"), F.countDistinct("user_id").alias("users"), count_if(week).alias("this_week"), count_if(before).alias("last_week"),
        F.countDistinct(F.when(week, F.col("user_id"))).alias("active_users"), F.countDistinct(F.when(before, F.col("user_id"))).alias("active_before"),
        share(count_if(F.col("memory_type").isNotNull()), F.count("*")).alias("typed_percent"),
    )

    def change(new: str, old: str) -> Column:
        return F.when(F.col(old) == 0, F.col(new).cast("double")).otherwise(F.round(F.try_divide((F.col(new) - F.col(old)) * 100.0, F.col(old)), 2))

    return rows.withColumns({"change": change("this_week", "last_week"), "user_change": change("active_users", "active_before")})


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def users_report(df: DataFrame, page: int, size: int) -> DataFrame:
    """A page of users by number of memories. The ranking is a sort by ranges, however many users there are."""
    rows = df.groupBy("user_id").agg(F.count("*").alias("memories"), F.round(F.avg("importance"), 6).alias("avg_importance"), F.max(F.unix_timestamp("created_at")).alias("last_seen"))
    ranked = global_rank(rows, [F.col("memories").desc(), F.col("user_id")]).withColumn("rank", F.col("rank").cast("int"))
    return ranked.where(F.col("rank").between((page - 1) * size + 1, page * size))


def band(value: Column, bands: list[tuple[float, str]], last: str) -> Column:
    """The name of the first band whose bound the value reaches."""
    out = F.lit(last)
    for bound, name in reversed(bands):
        out = F.when(value >= bound, name).otherwise(out)
    return out


# Lower bounds and names of the health index.
HEALTH_BANDS = [(90, "CLEAR"), (75, "LIGHT_HAZE"), (60, "HAZY"), (40, "FOGGY"), (20, "DENSE")]


def health_index(df: DataFrame, pending: DataFrame, now: str, last_run_hours: float, run_failed: bool) -> DataFrame:
    """(user_id, six parts of 0 to 100, index, band) from one pass over memories and one over pending duplicates(user_id)."""
    age = lambda c: hours_before(now, F.col(c)) / 24
    touched = F.least(age("created_at"), F.coalesce(age("last_retrieved_at"), F.lit(1e9)))
    per_user = df.groupBy("user_id").agg(
        F.count("*").alias("n"), count_if(touched <= 7).alias("fresh"), count_if(F.col("embedding_status") == "DONE").alias("embedded"),
        count_if(F.col("effective") < 0.2).alias("decayed"), F.countDistinct("layer").alias("layers"),
    ).join(pending.groupBy("user_id").agg(F.count("*").alias("pending")), "user_id", "left")
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    run = max(0.0, 100.0 if last_run_hours <= 24 else 100 - (last_run_hours - 24) * 2) * (0.5 if run_failed else 1)
    parts = per_user.withColumns({
        "freshness": clip(2 * F.col("fresh") * 100.0 / F.col("n")), "coverage": F.col("embedded") * 100.0 / F.col("n"),
        "dedup": clip(100 - 5.0 * F.coalesce("pending", F.lit(0))), "run": F.lit(run),
        "vitality": clip(100 - 2.5 * F.col("decayed") * 100.0 / F.col("n")), "breadth": F.col("layers") * 20.0,
    })
    weights = {"freshness": 25, "coverage": 20, "dedup": 15, "run": 20, "vitality": 10, "breadth": 10}
    index = F.round(reduce(lambda a, b: a + b, [F.col(k) * w for k, w in weights.items()]) / 100, 1)
    rows = parts.withColumn("health", index)
    return rows.select("user_id", *[F.round(k, 2).alias(k) for k in weights], "health", band(F.col("health"), HEALTH_BANDS, "BLIND").alias("band"))


def health_metrics(df: DataFrame, now: str) -> DataFrame:
    """(metric, value, status): vector coverage, share of exact duplicates and share of stale rows, against their bounds."""
    by_hash = df.groupBy(F.sha2(F.lower(F.trim(F.coalesce("raw", F.lit("")))), 256).alias("h")).agg(
        F.count("*").alias("c"), count_if(F.col("embedding_status") == "DONE").alias("e"),
        count_if(F.coalesce(F.col("last_retrieved_at"), F.col("created_at")) < at(now) - F.expr("interval 20 days")).alias("s"),
    )
    one = by_hash.agg(F.sum("c").alias("n"), F.sum("e").alias("e"), F.sum(F.col("c") - 1).alias("d"), F.sum("s").alias("s"))
    low = lambda v, ok, warn: F.when(v >= ok, "ok").when(v >= warn, "warning").otherwise("critical")
    high = lambda v, ok, warn: F.when(v <= ok, "ok").when(v <= warn, "warning").otherwise("critical")
    values = [("coverage", share(F.col("e"), F.col("n")), low, 95, 80), ("duplicates", share(F.col("d"), F.col("n")), high, 5, 15), ("stale", share(F.col("s"), F.col("n")), high, 20, 40)]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value"), f(v, ok, warn).alias("status")) for k, v, f, ok, warn in values])).alias("m")
    return one.select(each).select("m.*")


def composite_health(parts: DataFrame) -> DataFrame:
    """Adds composite = .35 coverage + .25 (100 - duplicates) + .2 (100 - stale) + .2 completeness."""
    return parts.withColumn("composite", F.round(0.35 * F.col("coverage") + 0.25 * (100 - F.col("duplicates")) + 0.2 * (100 - F.col("stale")) + 0.2 * F.col("completeness"), 4))


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """For each key the row that is last in order, by aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def alerts(calls: DataFrame, failures: int = 10, drop: int = 100, critical: int = 50, warning: int = 10) -> DataFrame:
    """(bucket, kind, level, n): hours with too many failures, and with a count far below the hour before.

    One row an hour is windowed.
    """
    hours = calls.groupBy(F.date_trunc("hour", "ts").alias("bucket")).agg(F.count("*").alias("n"), count_if(F.col("event_type") == "error").alias("errors"))
    hours = hours.withColumn("delta", F.col("n") - F.lag("n").over(Window.orderBy("bucket")))
    failing = hours.where(F.col("errors") > failures).select("bucket", F.lit("failures").alias("kind"), F.when(F.col("errors") > critical, "critical").otherwise("warning").alias("level"), F.col("errors").alias("n"))
    dropped = hours.where(F.col("delta") < -drop).select("bucket", F.lit("drop").alias("kind"), F.lit("critical").alias("level"), F.col("delta").alias("n"))
    return failing.unionAll(dropped)


def vector_coverage(vectors: DataFrame, memories: DataFrame, key: str = "vec_id") -> DataFrame:
    """(model_id, n, percent) of distinct memories that have a vector of the model."""
    total = memories.agg(F.countDistinct(key).alias("total"))  # a single row
    return vectors.groupBy("model_id").agg(F.countDistinct(key).alias("n")).crossJoin(F.broadcast(total)).select("model_id", "n", share(F.col("n"), F.col("total")).alias("percent"))


def missing_vectors(memories: DataFrame, vectors: DataFrame, models: list[str], key: str = "vec_id") -> DataFrame:
    """(key, model_id) for each memory and model without a vector."""
    wanted = memories.select(key).distinct().withColumn("model_id", F.explode(F.array(*map(F.lit, models))))
    return wanted.join(vectors.select(key, "model_id"), [key, "model_id"], "left_anti")


def session_summary(calls: DataFrame, session: list[str]) -> DataFrame:
    """Created, accessed and distinct rows of each session, and its length in seconds."""
    made, used = F.col("event_type") == "signup", F.col("event_type").isin("view", "click")
    return calls.groupBy(*session).agg(
        count_if(made).alias("created"), count_if(used).alias("accessed"), F.countDistinct("k").alias("distinct_keys"),
        F.countDistinct(F.when(used, F.col("k"))).alias("distinct_accessed"),
        (F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))) - F.min(F.unix_timestamp(F.col("ts").cast("timestamp")))).alias("seconds"),
    )


def attribution(calls: DataFrame, n: int = 100) -> DataFrame:
    """(user_id, k, accesses, agents, last_accesses): who made the last n accesses of each row, newest first."""
    ranked = latest(calls, ["user_id", "k"], [F.col("ts").desc(), F.col("event_id").desc()], n)
    newest = F.transform(F.sort_array(F.collect_list(F.struct("rank", "event_id"))), lambda r: r["event_id"])
    return ranked.groupBy("user_id", "k").agg(F.count("*").alias("accesses"), F.countDistinct("agent_id").alias("agents"), newest.alias("last_accesses"))


def status_counts(df: DataFrame) -> DataFrame:
    """(user_id, counts of rows by state)."""
    return df.groupBy("user_id").agg(
        F.count("*").alias("total"), count_if(F.col("embedding_status") == "DONE").alias("embedded"), count_if(F.col("consolidated_into").isNotNull()).alias("consolidated"),
        count_if(F.col("deleted_at").isNotNull()).alias("deleted"), count_if(F.col("superseded_by").isNotNull()).alias("superseded"), count_if(F.col("origin") == "CONSOLIDATION").alias("derived"),
    )


def unit_stats(units: DataFrame, memories: DataFrame) -> DataFrame:
    """(user_id, level, n, total, last_updated): units of memories that are neither deleted nor hidden; total and last_updated are the user's.

    units(memory_id, level, updated_at) meet memories(memory_id, user_id, deleted_at, user_hidden) by id; the window runs over counts.
    """
    live = memories.where(F.col("deleted_at").isNull() & ~F.coalesce("user_hidden", F.lit(False))).select("memory_id", "user_id")
    n = units.select("memory_id", "level", "updated_at").join(live, "memory_id").groupBy("user_id", "level").agg(F.count("*").alias("n"), F.max("updated_at").alias("last"))
    w = Window.partitionBy("user_id")
    return n.select("user_id", "level", "n", F.sum("n").over(w).alias("total"), F.max("last").over(w).alias("last_updated"))


def sync_status(df: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, total, synced, pending, last_synced): of memories that aren't deleted; last_synced looks at deleted ones too."""
    live = F.col("deleted_at").isNull()
    n = df.groupBy(key).agg(count_if(live).alias("total"), count_if(live & F.col("synced_at").isNotNull()).alias("synced"), F.max("synced_at").alias("last_synced"))
    return n.withColumn("pending", F.col("total") - F.col("synced"))


def consolidation_stats(df: DataFrame, least: int = 3) -> DataFrame:
    """(user_id, total, session, identity, project, consolidated, potential): live rows by layer, consolidated ones of all, and how many clusters of `least` the session rows could be."""
    live = F.col("deleted_at").isNull()
    layers = [count_if(live & (F.col("layer") == x.upper())).alias(x) for x in ("session", "identity", "project")]
    n = df.groupBy("user_id").agg(count_if(live).alias("total"), *layers, count_if(F.col("consolidated_into").isNotNull()).alias("consolidated"))
    return n.withColumn("potential", F.floor(F.col("session") / least))


def embedding_status(df: DataFrame, most: int = 5) -> DataFrame:
    """(user_id, done, without, failed, pending, queued, exhausted) of live rows.

    without: rows with no vector, whatever their state. queued: rows with attempts (null: not in the retry queue); exhausted: those with `most` or more.
    """
    live, state, tries = df.where("deleted_at is null"), F.col("embedding_status"), F.col("attempts")
    return live.groupBy("user_id").agg(
        count_if(state == "DONE").alias("done"), count_if(F.col("embedding_id").isNull()).alias("without"), count_if(state == "FAILED").alias("failed"),
        count_if(state == "PENDING").alias("pending"), count_if(tries.isNotNull()).alias("queued"), count_if(tries >= most).alias("exhausted"),
    )


def usage_meter(calls: DataFrame, limit: int) -> DataFrame:
    """(user_id, day, calls, remaining, over): calls of each day against the plan's limit."""
    n = calls.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"))
    return n.withColumns({"remaining": F.greatest(F.lit(0), limit - F.col("calls")), "over": F.col("calls") > limit})


def prefetch_quality(calls: DataFrame) -> DataFrame:
    """(topic, precision, recall, f1, p50, p95): views are prefetches, clicks uses; latency by sorted[floor(p * n)]."""
    per = calls.groupBy("topic").agg(
        count_if(F.col("event_type") == "view").alias("fetched"), count_if(F.col("event_type") == "click").alias("used"), F.count("*").alias("n"),
        F.sort_array(F.collect_list("value")).alias("v"),
    )
    precision, recall = F.try_divide(F.col("used").cast("double"), F.col("fetched")), F.try_divide(F.col("used").cast("double"), F.col("n"))
    at_share = lambda p: F.get("v", F.least(F.size("v") - 1, F.floor(F.lit(p) * F.size("v")).cast("int")))
    return per.select(
        "topic", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"),
        F.round(F.try_divide(2 * precision * recall, precision + recall), 6).alias("f1"), at_share(0.5).alias("p50"), at_share(0.95).alias("p95"),
    )


def propensity(ranked: DataFrame, keys: list[str], rank: str = "rank", k: int = 60) -> DataFrame:
    """Adds the share that a row's 1 / (k + rank) has of its list; ranks count from 0."""
    one = 1.0 / (k + F.col(rank))
    return ranked.withColumn("propensity", F.round(one / F.sum(one).over(Window.partitionBy(*keys)), 6))


def strategy_weights(outcomes: DataFrame, key: str, success: Column, least: int = 20, default: float = 0.5) -> DataFrame:
    """(key, total, weight): the share of successes, or the default where there are too few."""
    rows = outcomes.groupBy(key).agg(F.count("*").alias("total"), count_if(success).alias("good"))
    return rows.select(key, "total", F.when(F.col("total") >= least, F.round(F.col("good") / F.col("total"), 6)).otherwise(F.lit(default)).alias("weight"))


def insight_feedback(items: DataFrame, feedback: DataFrame) -> DataFrame:
    """(item, kind, adjustment): the sum of a reaction's step on its item, and half of it on items of the same kind without any.

    items(item, kind); feedback(item, reaction): dismissed -0.1, acted 0.15, useful 0.1.
    """
    step = F.when(F.col("reaction") == "dismissed", -0.1).when(F.col("reaction") == "acted", 0.15).when(F.col("reaction") == "useful", 0.1).otherwise(0.0)
    own = feedback.groupBy("item").agg(F.sum(step).alias("own"))
    rows = items.join(own, "item", "left")
    kinds = rows.groupBy("kind").agg(F.sum("own").alias("all"))
    return rows.join(kinds, "kind").select("item", "kind", F.round(F.coalesce("own", F.coalesce(F.col("all"), F.lit(0.0)) / 2), 6).alias("adjustment"))


def promotion_check(metrics: DataFrame, samples: int = 100, contribution: float = 0.05, correlation: float = 0.95) -> DataFrame:
    """Adds passed and reasons, the checks that failed."""
    reasons = F.array_compact(F.array(
        F.when(F.col("samples") < samples, "too few samples"), F.when(F.col("contribution") < contribution, "adds too little"),
        F.when(F.col("correlation") > correlation, "too alike"),
    ))
    return metrics.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def score_bands(df: DataFrame, score: str = "effective") -> DataFrame:
    """(user_id, low, middle, high): rows under 0.3, under 0.6, and the rest."""
    s = F.col(score)
    return df.groupBy("user_id").agg(count_if(s < 0.3).alias("low"), count_if((s >= 0.3) & (s < 0.6)).alias("middle"), count_if(s >= 0.6).alias("high"))


def drift(old: DataFrame, new: DataFrame, flag: float = 0.15) -> DataFrame:
    """(model_id, n, avg_drift, max_drift, flagged): 1 - cosine of each memory's two unit vectors of a model; old and new(vec_id, model_id, v)."""
    from loomwork.operators.vectors import dot

    rows = old.join(new.withColumnRenamed("v", "w"), ["vec_id", "model_id"]).withColumn("d", F.round(1 - dot(F.col("v"), F.col("w")), 6))
    return rows.groupBy("model_id").agg(F.count("*").alias("n"), F.round(F.avg("d"), 5).alias("avg_drift"), F.max("d").alias("max_drift"), count_if(F.col("d") > flag).alias("flagged"))


def completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """(user_id, field, share): how many of a user's rows have each field."""
    per = df.groupBy("user_id").agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in fields])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.round(F.col(c) / F.col("n"), 6).alias("share")) for c in fields])).alias("f")
    return per.select("user_id", each).select("user_id", "f.*")


def user_detail(df: DataFrame, calls: DataFrame) -> DataFrame:
    """(user_id, memories, layers, calls, last_call as epoch seconds) of two tables; users without calls stay."""
    m = df.groupBy("user_id").agg(F.count("*").alias("memories"), F.countDistinct("layer").alias("layers"))
    c = calls.groupBy("user_id").agg(F.count("*").alias("calls"), F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("last_call"))
    return m.join(c, "user_id", "left").fillna(0, ["calls"])
