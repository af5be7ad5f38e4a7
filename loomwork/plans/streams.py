"""Queries of the batch twins in loomwork.streaming.operators; tests hold the streams against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.plans.registry import query
from loomwork.sources.views import view, view_sql
from loomwork.streaming import operators as O

C, V, M = view_sql("calls"), view_sql("vectors"), view_sql("memories")


def calls(spark, d):
    c = view(spark, d, "calls")
    return c.withColumn("ts", F.col("ts").cast("timestamp"))


def _micros(df, *names):
    return df.withColumns({n: F.unix_micros(n) for n in names})


@query(C + ", g as (select *, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 1 hour then 1 else 0 end as new from calls), s as (select *, sum(new) over (partition by user_id order by ts, event_id) as s from g) select user_id, epoch_us(min(ts)) as first, epoch_us(max(ts) + interval 1 hour) as last, count(*) as n from s group by user_id, s")
def sessionise(spark, d):
    return _micros(O.sessions(calls(spark, d), ["user_id"]), "first", "last")


@query(C + ", w as (select date_trunc('minute', ts) - to_minutes((extract(minute from ts) % 5)::int) as b, event_type from calls), x as (select b - to_minutes((5 * i)::int) as start, event_type from w, (select unnest(range(0, 12)) as i)) select epoch_us(start) as start, count(*) as n, count(*) filter (event_type = 'error') as errors from x group by 1")
def failure_counts(spark, d):
    return _micros(O.failure_counts(calls(spark, d)), "start")


@query(C + " select user_id, epoch_us(date_trunc('day', ts)) as day, count(*) as calls from calls group by 1, 2")
def usage_daily(spark, d):
    return _micros(O.usage_daily(calls(spark, d)), "day")


_GUARD = C + ", w as (select time_bucket(interval 5 minute, ts) - to_minutes((5 * i)::int) + interval 30 minute as opened, value from calls, (select unnest(range(0, 6)) as i)), g as (select opened, opened + interval 2 minute as closes, quantile_disc(value, 0.95) as p95, count(*) as n from w group by 1), bad as (select * from g where n >= 5 and p95 > 30)"


@query(_GUARD + " select epoch_us(opened) as opened, epoch_us(closes) as closes, p95, n from bad")
def latency_guard(spark, d):
    return _micros(O.latency_guard(calls(spark, d), 30.0, "30 minutes", "5 minutes", 5), "opened", "closes")


@query(_GUARD.replace("interval 2 minute", "interval 7 minute") + ", m as (select *, max(closes) over (order by opened rows between unbounded preceding and 1 preceding) as b from bad), s as (select *, sum(case when opened <= b then 0 else 1 end) over (order by opened) as part from m) select epoch_us(min(opened)) as opened, epoch_us(max(closes)) as closes from s group by part")
def open_intervals(spark, d):
    return _micros(O.open_intervals(O.latency_guard(calls(spark, d), 30.0, "30 minutes", "5 minutes", 5, "7 minutes")), "opened", "closes")


@query(C + " select k, count(*) as retrievals, epoch_us(max(ts)) as last from calls where event_type in ('view', 'click') group by 1")
def access_counters(spark, d):
    return _micros(O.access_counters(calls(spark, d)), "last")


_LIMIT = (
    C + ", o as (select user_id, event_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as n from calls), f as (with recursive r as (select user_id, 0::bigint as n, 0::bigint as event_id, 0::bigint as us, []::bigint[] as log, true as ok from (select distinct user_id from o)"
    " union all select user_id, n, event_id, us, case when len(kept) < 2 then list_append(kept, us) else kept end, len(kept) < 2 from (select o.*, list_filter(r.log, lambda t: t > o.us - 14400000000) as kept from r join o on o.user_id = r.user_id and o.n = r.n + 1)) select * from r where n > 0)"
)


@query(_LIMIT + " select user_id, event_id, ok as admitted, 2 - len(log) as remaining, case when ok then 0 else ceil((list_min(log) + 14400000000 - us) / 1000000.0)::bigint end as retry_after from f")
def rate_limit(spark, d):
    return O.rate_limit(calls(spark, d), limit=2, seconds=14400)


@query("with p as (select *, (row_number() over (partition by conv_id order by turn) - 1) // 5 as batch from conversations) select conv_id, batch::bigint as batch, list(turn order by turn) as turns, count(*) = 5 as full from p group by 1, 2".replace(" as full", ' as "full"'))
def turn_batches(spark, d):
    return O.turn_batches(spark.read.parquet(f"{d}/conversations.parquet"))


@query(V + ", p as (select *, lag(embedding) over (partition by user_id order by vec_id) as b from vectors), s as (select user_id, vec_id, round(1 - list_cosine_similarity(embedding::double[], b::double[]), 6) as distance from p) select *, coalesce(distance > 0.9, true) as shifted from s")
def topic_shift(spark, d):
    return O.topic_shift(view(spark, d, "vectors"), 0.9)


_TOPICS = ", h as (select memory_id, word, least(count(*) / 4.0, 1.0)::double as score from (select memory_id, unnest(regexp_split_to_array(lower(raw), '[^a-z0-9]+')) as word from memories) where word in ('the', 'and', 'que', 'der', 'of', 'les') group by 1, 2), p as (select user_id, memory_id, row_number() over (partition by user_id order by memory_id) as place from memories)"


@query(M + _TOPICS + ", s as (select user_id, place, word, score from h join p using (memory_id)), b as (select m.user_id, m.place, s.word, sum(s.score) / least(m.place - 1, 4) as before from p m join s on s.user_id = m.user_id and s.place between m.place - 4 and m.place - 1 group by m.user_id, m.place, s.word), j as (select coalesce(b.user_id, s.user_id) as user_id, coalesce(b.place, s.place) as place, coalesce(b.word, s.word) as word, before, score from b full join s on s.user_id = b.user_id and s.place = b.place and s.word = b.word), k as (select user_id, place, case when round(before - coalesce(score, 0), 6) > 0.4::double then word end as d, case when before is null and score > 0.5::double and place > 1 then word end as a from j), g as (select user_id, place, list(d order by d) filter (d is not null) as departed, list(a order by a) filter (a is not null) as arrived from k group by 1, 2) select user_id, memory_id as message_id, coalesce(departed, []) as departed, coalesce(arrived, []) as arrived, case when arrived is null then 0.7 else 0.8 end::double as confidence from g join p using (user_id, place) where departed is not null or arrived is not null")
def topic_changes(spark, d):
    m = view(spark, d, "memories")
    words = m.select("memory_id", F.explode(F.split(F.lower("raw"), "[^a-z0-9]+")).alias("topic")).where(F.col("topic").isin("the", "and", "que", "der", "of", "les"))
    topics = words.groupBy(F.col("memory_id").alias("message_id"), "topic").agg(F.least(F.count("*") / 4, F.lit(1.0)).alias("score"))
    return O.topic_changes(m.select("user_id", F.col("memory_id").alias("message_id")), topics)
