"""Queries of loomwork.operators.analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import analytics as A
from loomwork.plans.registry import query
from loomwork.sources.views import NOW, view, view_sql

M, C, V, K = view_sql("memories"), view_sql("calls"), view_sql("vectors"), view_sql("tasks")
EPOCH = "epoch(date_trunc('{}', {}))::bigint"


def _bucket(df):
    return df.withColumn("bucket", F.unix_timestamp(F.col("bucket").cast("timestamp")))


@query(M + ", n as (select user_id, date_trunc('day', created_at) as b, count(*) as n from memories group by all) select user_id, epoch(b)::bigint as bucket, n, sum(n) over (partition by user_id order by b)::bigint as cumulative from n")
def volume_by_day(spark, d):
    return _bucket(A.volume(view(spark, d, "memories"), "day"))


@query(C + ", n as (select user_id, date_trunc('hour', ts) as b, count(*) as n from calls group by all) select user_id, epoch(b)::bigint as bucket, n, sum(n) over (partition by user_id order by b)::bigint as cumulative from n")
def volume_by_hour(spark, d):
    return _bucket(A.volume(view(spark, d, "calls"), "hour", "ts"))


_COUNTS = ", ".join(f"count(*) filter (memory_type = '{t}') as n_{t.lower()}" for t in A.TYPES)
_BEST = "greatest(" + ", ".join(f"n_{t.lower()}" for t in A.TYPES) + ")"


@query(M + f", n as (select date_trunc('week', created_at) as b, count(*) as total, {_COUNTS} from memories group by all) select * exclude (b), epoch(b)::bigint as bucket, case " + " ".join(f"when n_{t.lower()} = {_BEST} and {_BEST} > 0 then '{t}'" for t in A.TYPES) + " end as dominant from n")
def type_breakdown(spark, d):
    return _bucket(A.type_breakdown(view(spark, d, "memories")))


@query(M + ", u as (select user_id, count(*) as total from memories group by all), l as (select unnest(['IDENTITY','PROJECT','SESSION','TASK','INSIGHT']) as layer), n as (select user_id, layer, count(*) as n from memories group by all) select u.user_id, l.layer, coalesce(n.n, 0) as n, round(coalesce(n.n, 0) * 100.0::double / total, 2) as percent from u cross join l left join n on n.user_id = u.user_id and n.layer = l.layer")
def layer_distribution(spark, d):
    return A.layer_distribution(view(spark, d, "memories"))


@query(M + f" select user_id, count(*) as total, count(*) filter (created_at >= timestamp '{NOW}') as today, count(*) filter (created_at >= timestamp '2024-01-28') as this_week, round(avg(importance), 6) as avg_importance from memories group by user_id")
def memory_summary(spark, d):
    return A.summary(view(spark, d, "memories"), NOW)


@query(M + f""", a as (select *, epoch(timestamp '{NOW}' - created_at) / 86400 as age from memories),
r as (select count(*) as memories, count(distinct user_id) as users, count(*) filter (age >= 0 and age < 7) as this_week, count(*) filter (age >= 7 and age < 14) as last_week,
count(distinct user_id) filter (age >= 0 and age < 7) as active_users, count(distinct user_id) filter (age >= 7 and age < 14) as active_before, round(count(memory_type) * 100.0::double / count(*), 2) as typed_percent from a)
select *, case when last_week = 0 then this_week::double else round((this_week - last_week) * 100.0::double / last_week, 2) end as change, case when active_before = 0 then active_users::double else round((active_users - active_before) * 100.0::double / active_before, 2) end as user_change from r""")
def dashboard_stats(spark, d):
    return A.dashboard(view(spark, d, "memories"), NOW)


@query(M + " select user_id, memory_id, rank::int as rank from (select *, row_number() over (partition by user_id order by created_at desc, memory_id) as rank from memories) where rank <= 10")
def latest_memories(spark, d):
    return A.latest(view(spark, d, "memories"), ["user_id"], [F.col("created_at").desc(), F.col("memory_id")], 10).select("user_id", "memory_id", "rank")


@query(M + ", r as (select user_id, count(*) as memories, round(avg(importance), 6) as avg_importance, epoch(max(created_at))::bigint as last_seen from memories group by user_id) select * from (select *, row_number() over (order by memories desc, user_id)::int as rank from r) where rank between 6 and 10")
def users_report(spark, d):
    return A.users_report(view(spark, d, "memories"), 2, 5)


@query(M + f""", u as (select user_id, count(*) as n, count(*) filter (least(epoch(timestamp '{NOW}' - created_at) / 86400, coalesce(epoch(timestamp '{NOW}' - last_retrieved_at) / 86400, 1e9)) <= 7) as fresh,
count(*) filter (embedding_status = 'DONE') as embedded, count(*) filter (effective < 0.2) as decayed, count(distinct layer) as layers, count(is_duplicate_of) as pending from memories group by user_id),
p as (select user_id, least(100, 2 * fresh * 100.0::double / n) as freshness, embedded * 100.0::double / n as coverage, greatest(0, 100 - 5.0::double * pending) as dedup, 88.0::double as run, greatest(0, 100 - 2.5::double * decayed * 100.0::double / n) as vitality, layers * 20.0::double as breadth from u),
h as (select *, round((freshness * 25 + coverage * 20 + dedup * 15 + run * 20 + vitality * 10 + breadth * 10) / 100, 1) as health from p)
select user_id, round(freshness, 2) as freshness, round(coverage, 2) as coverage, round(dedup, 2) as dedup, round(run, 2) as run, round(vitality, 2) as vitality, round(breadth, 2) as breadth, health,
case when health >= 90 then 'CLEAR' when health >= 75 then 'LIGHT_HAZE' when health >= 60 then 'HAZY' when health >= 40 then 'FOGGY' when health >= 20 then 'DENSE' else 'BLIND' end as band from h""")
def health_index(spark, d):
    m = view(spark, d, "memories")
    return A.health_index(m, m.where("is_duplicate_of is not null"), NOW, 30.0, False)


@query(M + f""", h as (select sha256(lower(trim(coalesce(raw, '')))) as h, count(*) as c, count(*) filter (embedding_status = 'DONE') as e, count(*) filter (coalesce(last_retrieved_at, created_at) < timestamp '{NOW}' - interval 20 day) as s from memories group by 1),
o as (select sum(c) as n, sum(e) as e, sum(c - 1) as d, sum(s) as s from h),
v as (select 'coverage' as metric, round(e * 100.0::double / n, 2) as value from o union all select 'duplicates', round(d * 100.0::double / n, 2) from o union all select 'stale', round(s * 100.0::double / n, 2) from o)
select metric, value, case when metric = 'coverage' then case when value >= 95 then 'ok' when value >= 80 then 'warning' else 'critical' end when metric = 'duplicates' then case when value <= 5 then 'ok' when value <= 15 then 'warning' else 'critical' end
else case when value <= 20 then 'ok' when value <= 40 then 'warning' else 'critical' end end as status from v""")
def health_metrics(spark, d):
    return A.health_metrics(view(spark, d, "memories"), NOW)


@query(M + f", u as (select user_id, count(*) filter (embedding_status = 'DONE') * 100.0::double / count(*) as coverage, count(is_duplicate_of) * 100.0::double / count(*) as duplicates, count(*) filter (retrieval_count = 0) * 100.0::double / count(*) as stale, count(memory_type) * 100.0::double / count(*) as completeness from memories group by user_id) select user_id, round(0.35::double * coverage + 0.25::double * (100 - duplicates) + 0.2::double * (100 - stale) + 0.2::double * completeness, 4) as composite from u")
def health_snapshot(spark, d):
    pc = lambda c: A.count_if(c) * 100.0 / F.count("*")
    parts = view(spark, d, "memories").groupBy("user_id").agg(
        pc(F.col("embedding_status") == "DONE").alias("coverage"), pc(F.col("is_duplicate_of").isNotNull()).alias("duplicates"),
        pc(F.col("retrieval_count") == 0).alias("stale"), pc(F.col("memory_type").isNotNull()).alias("completeness"),
    )
    return A.composite_health(parts).select("user_id", "composite")


@query(C + ", h as (select date_trunc('hour', ts) as b, count(*) as n, count(*) filter (event_type = 'error') as errors from calls group by 1), l as (select *, n - lag(n) over (order by b) as delta from h) select epoch(b)::bigint as bucket, 'failures' as kind, case when errors > 4 then 'critical' else 'warning' end as level, errors as n from l where errors > 2 union all select epoch(b)::bigint, 'drop', 'critical', delta from l where delta < -8")
def monitoring_alerts(spark, d):
    return _bucket(A.alerts(view(spark, d, "calls"), failures=2, drop=8, critical=4))


@query(V + " select model_id, count(distinct vec_id) as n, round(count(distinct vec_id) * 100.0::double / (select count(distinct vec_id) from vectors), 2) as percent from vectors group by model_id")
def vector_coverage(spark, d):
    v = view(spark, d, "vectors")
    return A.vector_coverage(v, v)


@query(V + ", w as (select distinct vec_id, unnest(['m0', 'm1', 'm2']) as model_id from vectors) select vec_id, model_id from w where not exists (select 1 from vectors v where v.vec_id = w.vec_id and v.model_id = w.model_id)")
def missing_vectors(spark, d):
    v = view(spark, d, "vectors")
    return A.missing_vectors(v, v, ["m0", "m1", "m2"])


@query(C + " select user_id, agent_id, count(*) filter (event_type = 'signup') as created, count(*) filter (event_type in ('view', 'click')) as accessed, count(distinct k) as distinct_keys, count(distinct k) filter (event_type in ('view', 'click')) as distinct_accessed, (epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))))::bigint as seconds from calls group by user_id, agent_id")
def session_summary(spark, d):
    return A.session_summary(view(spark, d, "calls"), ["user_id", "agent_id"])


@query(C + ", r as (select *, row_number() over (partition by user_id, k order by ts desc, event_id desc) as rank from calls) select user_id, k, count(*) as accesses, count(distinct agent_id) as agents, list(event_id order by rank) as last_accesses from r where rank <= 3 group by user_id, k")
def access_attribution(spark, d):
    return A.attribution(view(spark, d, "calls"), 3)


@query(M + " select user_id, count(*) as total, count(*) filter (embedding_status = 'DONE') as embedded, count(consolidated_into) as consolidated, count(deleted_at) as deleted, count(superseded_by) as superseded, count(*) filter (origin = 'CONSOLIDATION') as derived from memories group by user_id")
def status_counts(spark, d):
    return A.status_counts(view(spark, d, "memories"))


@query(M + ", u as (select memory_id, 'L' || i as level, created_at + to_hours(i::int) as updated_at from (select memory_id, created_at, unnest(range(0, memory_id % 4 + 1)) as i from memories)), n as (select user_id, level, count(*) as n, max(updated_at) as l from u join memories using (memory_id) where deleted_at is null and not user_hidden group by 1, 2) select user_id, level, n, sum(n) over w::bigint as total, epoch(max(l) over w)::bigint as last_updated from n window w as (partition by user_id)")
def unit_stats(spark, d):
    m = view(spark, d, "memories")
    units = m.select("memory_id", "created_at", F.explode(F.sequence(F.lit(0), (F.col("memory_id") % 4).cast("int"))).alias("i"))
    units = units.select("memory_id", F.concat(F.lit("L"), "i").alias("level"), F.timestamp_seconds(F.unix_timestamp("created_at") + F.col("i") * 3600).alias("updated_at"))
    return A.unit_stats(units, m).withColumn("last_updated", F.unix_timestamp("last_updated"))


@query(M + " select user_id, count(*) filter (deleted_at is null) as total, count(last_used_at) filter (deleted_at is null) as synced, count(*) filter (deleted_at is null and last_used_at is null) as pending, epoch(max(last_used_at))::bigint as last_synced from memories group by 1")
def sync_status(spark, d):
    return A.sync_status(view(spark, d, "memories").withColumn("synced_at", F.col("last_used_at"))).withColumn("last_synced", F.unix_timestamp("last_synced"))


@query(M + ", n as (select user_id, count(*) filter (deleted_at is null) as total, count(*) filter (deleted_at is null and layer = 'SESSION') as session, count(*) filter (deleted_at is null and layer = 'IDENTITY') as identity, count(*) filter (deleted_at is null and layer = 'PROJECT') as project, count(consolidated_into) as consolidated from memories group by 1) select *, session // 3 as potential from n")
def consolidation_stats(spark, d):
    return A.consolidation_stats(view(spark, d, "memories"))


_STATES = ", s as (select user_id, deleted_at, ['DONE', 'FAILED', 'PENDING', 'DUPLICATE'][memory_id % 4 + 1] as state, vec_id, case when memory_id % 4 = 1 then memory_id % 9 end as attempts from memories left join vectors on vec_id = memory_id)"


@query(M + "," + view_sql("vectors")[4:].replace("as user_id", "as vector_user") + _STATES + " select user_id, count(*) filter (state = 'DONE') as done, count(*) filter (vec_id is null) as without, count(*) filter (state = 'FAILED') as failed, count(*) filter (state = 'PENDING') as pending, count(attempts) as queued, count(*) filter (attempts >= 5) as exhausted from s where deleted_at is null group by 1")
def embedding_status(spark, d):
    k = F.col("memory_id")
    m = view(spark, d, "memories").join(view(spark, d, "vectors").select(F.col("vec_id").alias("memory_id"), F.col("vec_id").alias("embedding_id")), "memory_id", "left")
    state = F.element_at(F.array(*map(F.lit, ("DONE", "FAILED", "PENDING", "DUPLICATE"))), (k % 4 + 1).cast("int"))
    return A.embedding_status(m.withColumns({"embedding_status": state, "attempts": F.when(k % 4 == 1, k % 9)}))


@query(C + " select user_id, strftime(ts, '%Y-%m-%d') as day, count(*) as calls, greatest(0, 3 - count(*)) as remaining, count(*) > 3 as over from calls group by 1, 2")
def usage_meter(spark, d):
    return A.usage_meter(view(spark, d, "calls"), 3).withColumn("day", F.col("day").cast("string"))


@query(C + ", p as (select topic, count(*) filter (event_type = 'view') as fetched, count(*) filter (event_type = 'click') as used, count(*) as n, list(value order by value) as v from calls group by topic), q as (select *, used::double / fetched as precision, used::double / n as recall from p) select topic, round(precision, 6) as precision, round(recall, 6) as recall, round(2 * precision * recall / (precision + recall), 6) as f1, v[least(len(v), floor(0.5 * len(v))::bigint + 1)] as p50, v[least(len(v), floor(0.95 * len(v))::bigint + 1)] as p95 from q")
def prefetch_quality(spark, d):
    return A.prefetch_quality(view(spark, d, "calls"))


@query(C + ", r as (select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) - 1 as rank from calls) select user_id, event_id, round((1.0::double / (60 + rank)) / sum(1.0::double / (60 + rank)) over (partition by user_id), 6) as propensity from r")
def click_propensity(spark, d):
    c = view(spark, d, "calls")
    ranked = c.withColumn("rank", F.row_number().over(A.Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id")) - 1)
    return A.propensity(ranked, ["user_id"]).select("user_id", "event_id", "propensity")


@query(K + " select agent_id, count(*) as total, case when count(*) >= 380 then round(count(*) filter (outcome = 'SUCCESS') / count(*), 6) else 0.5::double end as weight from tasks group by agent_id")
def strategy_weights(spark, d):
    return A.strategy_weights(view(spark, d, "tasks"), "agent_id", F.col("outcome") == "SUCCESS", least=380)


@query(C + ", i as (select distinct user_id as item, concat('kind', user_id % 4) as kind from calls), f as (select user_id as item, sum(case event_type when 'error' then -0.1::double when 'click' then 0.15::double else 0.1::double end) as own from calls where user_id % 3 = 0 and event_type in ('error', 'click', 'view') group by 1), r as (select i.*, own from i left join f using (item)), a as (select kind, sum(own) as total from r group by kind) select item, r.kind, round(coalesce(own, coalesce(total, 0) / 2), 6) as adjustment from r join a using (kind)")
def insight_feedback(spark, d):
    c = view(spark, d, "calls")
    items = c.select(F.col("user_id").alias("item"), F.concat(F.lit("kind"), F.col("user_id") % 4).alias("kind")).distinct()
    reaction = F.when(F.col("event_type") == "error", "dismissed").when(F.col("event_type") == "click", "acted").when(F.col("event_type") == "view", "useful")
    # a role, not a sample: items that had no feedback of their own take half of their kind's
    feedback = c.where("user_id % 3 = 0").select(F.col("user_id").alias("item"), reaction.alias("reaction")).where("reaction is not null")
    return A.insight_feedback(items, feedback)


@query(V + ", m as (select user_id, count(*) as samples, avg(importance) / 10 as contribution, max(importance) as correlation from vectors group by user_id), r as (select *, list_filter([case when samples < 50 then 'too few samples' end, case when contribution < 0.05::double then 'adds too little' end, case when correlation > 0.99::double then 'too alike' end], lambda x: x is not null) as reasons from m) select user_id, samples, reasons, len(reasons) = 0 as passed from r")
def promotion_check(spark, d):
    m = view(spark, d, "vectors").groupBy("user_id").agg(F.count("*").alias("samples"), (F.avg("importance") / 10).alias("contribution"), F.max("importance").alias("correlation"))
    return A.promotion_check(m, 50, 0.05, 0.99).select("user_id", "samples", "reasons", "passed")


@query(M + " select user_id, count(*) filter (effective < 0.3::double) as low, count(*) filter (effective >= 0.3::double and effective < 0.6::double) as middle, count(*) filter (effective >= 0.6::double) as high from memories group by user_id")
def score_bands(spark, d):
    return A.score_bands(view(spark, d, "memories"))


@query(C + " select agent_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value from calls group by agent_id")
def latest_snapshot(spark, d):
    return A.latest_by(view(spark, d, "calls").select("agent_id", "event_id", "value", "ts"), ["agent_id"], ["ts", "event_id"]).select("agent_id", "event_id", "value")


@query(V + ", n as (select vec_id, model_id, embedding, list_transform(embedding::double[], lambda x, i: x + (case when i % 4 = 1 then 0.05::double * (vec_id % 5) else 0 end)) as moved from vectors), r as (select model_id, round(1 - list_cosine_similarity(embedding::double[], moved), 6) as d from n) select model_id, count(*) as n, round(avg(d), 5) as avg_drift, max(d) as max_drift, count(*) filter (d > 0.005::double) as flagged from r group by 1")
def embedding_drift(spark, d):
    from loomwork.operators.vectors import unit

    v = view(spark, d, "vectors")
    moved = F.transform("embedding", lambda x, i: x.cast("double") + F.when(i % 4 == 0, 0.05 * (F.col("vec_id") % 5)).otherwise(0.0))
    return A.drift(v.select("vec_id", "model_id", unit(F.col("embedding")).alias("v")), v.select("vec_id", "model_id", unit(moved).alias("v")), 0.005)


@query(M + ", p as (select user_id, count(*) as n, count(memory_type) as memory_type, count(observed_at) as observed_at, count(last_used_at) as last_used_at from memories group by 1) select user_id, unnest(['memory_type', 'observed_at', 'last_used_at']) as field, unnest([round(memory_type / n, 6), round(observed_at / n, 6), round(last_used_at / n, 6)]) as share from p")
def completeness(spark, d):
    return A.completeness(view(spark, d, "memories"), ["memory_type", "observed_at", "last_used_at"])


@query(M + ", m as (select cast(substr(user_id, 4) as bigint) as user_id, count(*) as memories, count(distinct layer) as layers from memories group by 1), c as (select user_id, count(*) as calls, floor(epoch(max(ts)))::bigint as last_call from events group by 1) select m.user_id, memories, layers, coalesce(calls, 0) as calls, last_call from m left join c on c.user_id = m.user_id")
def user_detail(spark, d):
    m = view(spark, d, "memories").withColumn("user_id", F.expr("try_cast(substring(user_id, 4) as bigint)"))
    return A.user_detail(m, view(spark, d, "calls"))
