"""Queries of loomwork.operators.timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import timelines as T
from loomwork.plans.registry import query
from loomwork.sources.views import view, view_sql

M, C = view_sql("memories"), view_sql("calls")
_DAYS = ", n as (select user_id, created_at::date as day, count(*) as n from memories group by 1, 2), cal as (select user_id, unnest(generate_series(date '2024-01-01', date '2024-01-30', interval 1 day))::date as day from (select distinct user_id from memories)), g as (select cal.user_id, cal.day, coalesce(n.n, 0) as n from cal left join n on n.user_id = cal.user_id and n.day = cal.day), b as (select *, greatest(1, floor(avg(n) over (partition by user_id) / 2)) as bound from g)"


def _text(df):
    return df.withColumn("day", F.col("day").cast("string"))


@query(M + _DAYS + " select user_id, day::varchar as day, n, case when n = 0 then 'absolute' when n < bound then 'sparse' else 'none' end as gap from b")
def day_gaps(spark, d):
    return _text(T.gaps(view(spark, d, "memories"), "user_id", "2024-01-01", "2024-01-30"))


@query(M + _DAYS + " select user_id, count(*) as days, count(*) filter (n > 0) as covered, round(count(*) filter (n > 0) * 100.0::double / count(*), 2) as percent from b group by 1")
def day_coverage(spark, d):
    return T.coverage(T.gaps(view(spark, d, "memories"), "user_id", "2024-01-01", "2024-01-30"), "user_id")


@query(M + ", r as (select *, row_number() over (partition by user_id order by created_at desc, memory_id) as r from memories) select user_id, created_at::date::varchar as day, list(memory_id order by memory_id) as ids from r where r <= 100 group by 1, 2")
def trace_timeline(spark, d):
    return _text(T.trace(view(spark, d, "memories"), "user_id"))


@query(C + ", s as (select user_id, event_id, floor(epoch(ts))::bigint as t, ts from calls), g as (select user_id, event_id, t - lag(t) over (partition by user_id order by ts, event_id) as s from s) select user_id, event_id, s as gap_seconds, case when s < 60 then s || 's' when s < 3600 then (s // 60) || 'm' when s < 86400 then (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' else (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h' end as gap_text from g where s > 600")
def gap_markers(spark, d):
    return T.gap_markers(view(spark, d, "calls"), ["user_id"])


_ARC = ", d as (select agent_id, 'arc' || (user_id % 5) as arc, ts::date as day, sum(k)::double as score, min(event_type) as title from calls group by 1, 2, 3)"


def _days(spark, d):
    c = view(spark, d, "calls")
    return c.groupBy("agent_id", F.concat(F.lit("arc"), F.col("user_id") % 5).alias("arc"), F.to_date("ts").alias("day")).agg(F.sum("k").cast("double").alias("score"), F.min("event_type").alias("title"))


@query(C + _ARC + " select agent_id, arc, count(*) as days, min(day)::varchar as first, max(day)::varchar as last, max(score) as best, round(avg(score), 6) as mean, arg_max(title, (score, day)) as title, list(day::varchar order by score desc, day desc)[1:3] as top_days from d group by 1, 2")
def arc_search(spark, d):
    rows = T.arcs(_days(spark, d))
    return rows.withColumns({"first": F.col("first").cast("string"), "last": F.col("last").cast("string"), "top_days": F.col("top_days").cast("array<string>")})


@query(C + _ARC + " select agent_id, day::varchar as day, score, case when day between date '2024-01-05' and date '2024-01-09' and arc = 'arc3' then 'closed' when arc = 'arc3' then null else arc end as arc from d")
def close_arc(spark, d):
    days = _days(spark, d).withColumn("arc", F.when(F.col("arc") != "arc3", F.col("arc")))
    return _text(T.close_arc(days, "closed", "2024-01-05", "2024-01-09")).select("agent_id", "day", "score", "arc")


@query(M + " select agent_id, created_at::date::varchar as day, count(*) as n, list(memory_id order by created_at, memory_id) as members from memories where created_at >= timestamp '2024-01-10' group by 1, 2")
def day_buckets(spark, d):
    return _text(T.day_buckets(view(spark, d, "memories"), "2024-01-10"))
