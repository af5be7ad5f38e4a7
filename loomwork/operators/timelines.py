"""Calendars, gaps and arcs over dated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calendar(keys: DataFrame, start: str, end: str) -> DataFrame:
    """Every day from start to end for each row of keys."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return keys.distinct().withColumn("day", F.explode(days))


def gaps(df: DataFrame, key: str, start: str, end: str, time: str = "created_at") -> DataFrame:
    """(key, day, n, gap): days without rows are absolute gaps, those under half the key's daily mean sparse ones."""
    n = df.groupBy(key, F.to_date(time).alias("day")).agg(F.count("*").alias("n"))
    days = calendar(df.select(key), start, end).join(n, [key, "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bound = F.greatest(F.lit(1), F.floor(F.avg("n").over(Window.partitionBy(key)) / 2))
    return days.withColumn("gap", F.when(F.col("n") == 0, "absolute").when(F.col("n") < bound, "sparse").otherwise("none"))


def coverage(days: DataFrame, key: str) -> DataFrame:
    """(key, days, covered, percent) of gaps()."""
    return days.groupBy(key).agg(F.count("*").alias("days"), F.count(F.when(F.col("n") > 0, 1)).alias("covered"), F.round(F.count(F.when(F.col("n") > 0, 1)) * 100.0 / F.count("*"), 2).alias("percent"))


def trace(df: DataFrame, key: str, per_key: int = 100) -> DataFrame:
    """(key, day, ids): the newest per_key rows of each key by day."""
    newest = df.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.col("created_at").desc(), "memory_id"))).where(F.col("r") <= per_key)
    return newest.groupBy(key, F.to_date("created_at").alias("day")).agg(F.sort_array(F.collect_list("memory_id")).alias("ids"))


def duration_text(seconds: Column) -> Column:
    """45s, 12m, 3h 5m or 2d 4h."""
    part = lambda unit, of=None: F.format_string("%d", F.floor((seconds % of if of else seconds) / unit))
    return (
        F.when(seconds < 60, F.concat(part(1), F.lit("s"))).when(seconds < 3600, F.concat(part(60), F.lit("m")))
        .when(seconds < 86400, F.concat(part(3600), F.lit("h "), part(60, 3600), F.lit("m"))).otherwise(F.concat(part(86400), F.lit("d "), part(3600, 86400), F.lit("h")))
    )


def gap_markers(df: DataFrame, keys: list[str], time: str = "ts", id_col: str = "event_id", longest: int = 600) -> DataFrame:
    """(keys, id, gap_seconds, gap_text): rows that come more than `longest` seconds after the one before."""
    seconds = F.unix_timestamp(F.col(time).cast("timestamp"))
    rows = df.withColumn("gap_seconds", seconds - F.lag(seconds).over(Window.partitionBy(*keys).orderBy(time, id_col)))
    return rows.where(F.col("gap_seconds") > longest).select(*keys, id_col, "gap_seconds", duration_text(F.col("gap_seconds")).alias("gap_text"))


def arcs(days: DataFrame, n: int = 3) -> DataFrame:
    """(agent_id, arc, days, first, last, best, mean, title, top_days) from days(agent_id, arc, day, score, title)."""
    order = F.reverse(F.sort_array(F.collect_list(F.struct("score", "day"))))
    rows = days.groupBy("agent_id", "arc").agg(
        F.count("*").alias("days"), F.min("day").alias("first"), F.max("day").alias("last"), F.max("score").alias("best"), F.round(F.avg("score"), 6).alias("mean"),
        F.max_by("title", F.struct("score", "day")).alias("title"), order.alias("o"),
    )
    return rows.withColumn("top_days", F.transform(F.slice("o", 1, n), lambda x: x["day"])).drop("o")


def day_buckets(df: DataFrame, since: str) -> DataFrame:
    """(agent_id, day, n, members): the rows of each agent and UTC day since the last run, in order; a null agent is `default`."""
    rows = df.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    members = F.transform(F.sort_array(F.collect_list(F.struct("created_at", "memory_id"))), lambda x: x["memory_id"])
    return rows.groupBy(F.coalesce("agent_id", F.lit("default")).alias("agent_id"), F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), members.alias("members"))


def close_arc(days: DataFrame, arc: str, first: str, last: str) -> DataFrame:
    """days with the arc's name on those from first to last that have none yet."""
    inside = F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & F.col("arc").isNull()
    return days.withColumn("arc", F.when(inside, arc).otherwise(F.col("arc")))
