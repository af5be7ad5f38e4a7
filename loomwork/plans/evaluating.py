"""Queries of loomwork.operators.evaluating."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import evaluating as E
from loomwork.plans.registry import query
from loomwork.sources.views import view, view_sql

H, C, K = view_sql("hits"), view_sql("calls"), view_sql("tasks")
_GOLD = ", g as (select distinct query_id, [query_id % 100, query_id * 3 % 100] as must, case when query_id % 4 <> 0 then [query_id * 7 % 100] end as should, case when query_id % 3 = 0 then [query_id * 11 % 100] end as absent, query_id % 10 = 0 as none_expected, concat('c', query_id % 5) as category from hits), v as (select query_id, doc_id, rank from hits where variant = 'v0' and query_id % 20 <> 10)"


def gold(spark, d):
    q = F.col("query_id")
    return view(spark, d, "hits").select("query_id").distinct().select(
        "query_id", F.array(q % 100, q * 3 % 100).alias("must_top5"), F.when(q % 4 != 0, F.array(q * 7 % 100)).alias("should_top20"), F.when(q % 3 == 0, F.array(q * 11 % 100)).alias("must_absent"),
        (q % 10 == 0).alias("expect_no_answer"), F.concat(F.lit("c"), q % 5).alias("category"),
    )


def results(spark, d):
    return view(spark, d, "hits").where("variant = 'v0' and query_id % 20 <> 10").select("query_id", "doc_id", "rank")


_SCORE = _GOLD + """, m as (select g.query_id, x.d, v.rank from g, unnest(list_distinct(must)) x(d) left join v on v.query_id = g.query_id and v.doc_id = x.d), sh as (select g.query_id, v.rank from g, unnest(should) x(d) left join v on v.query_id = g.query_id and v.doc_id = x.d), ab as (select g.query_id, v.rank from g, unnest(absent) x(d) left join v on v.query_id = g.query_id and v.doc_id = x.d),
sc as (select g.query_id, category, (select round(avg(coalesce((rank <= 5)::int, 0)), 6) from m where m.query_id = g.query_id) as required_at_5, (select round(avg(coalesce((rank <= 20)::int, 0)), 6) from sh where sh.query_id = g.query_id) as expected_at_20, (select round(coalesce(1.0::double / min(rank), 0), 6) from m where m.query_id = g.query_id) as mrr, (select bool_and(rank is null) from ab where ab.query_id = g.query_id) as isolated, case when none_expected then g.query_id not in (select query_id from v) end as no_answer_ok from g)"""


@query(H + _SCORE + " select * exclude (category) from sc")
def score_queries(spark, d):
    return E.score_queries(gold(spark, d), results(spark, d))


@query(H + _SCORE + ", r as (select category, count(*) as queries, round(avg(required_at_5), 6) as required_at_5, round(avg(expected_at_20), 6) as expected_at_20, round(avg(mrr), 6) as mrr, round(avg(isolated::int), 6) as isolated from sc group by 1) select *, coalesce(required_at_5, 1) >= 0.1::double and coalesce(isolated, 1) = 1 as passed from r")
def score_report(spark, d):
    g = gold(spark, d)
    return E.score_report(E.score_queries(g, results(spark, d)), g, 0.1)


@query(H + ", v as (select query_id, doc_id, score as cosine, cast((doc_id * 53) % 101 as double) / 100 as importance from hits where variant = 'v0'), g as (select distinct query_id, query_id * 3 % 100 as doc_id from hits), c as (select unnest([0.5, 0.8, 1.0])::double as weight), k as (select unnest([0.0, 0.3])::double as cutoff), r as (select weight, cutoff, query_id, doc_id, row_number() over (partition by weight, cutoff, query_id order by round(weight * cosine + (1 - weight) * importance, 9) desc, doc_id) as r from v, c, k where cosine >= cutoff) select weight, cutoff, round(count(*) / (select count(*) from g), 6) as coverage from r join g using (query_id, doc_id) where r <= 5 group by 1, 2")
def score_sweep(spark, d):
    h = view(spark, d, "hits")
    v = h.where("variant = 'v0'").select("query_id", "doc_id", F.col("score").alias("cosine"), (((F.col("doc_id") * 53) % 101).cast("double") / 100).alias("importance"))
    g = h.select("query_id", (F.col("query_id") * 3 % 100).alias("doc_id")).distinct()
    return E.score_sweep(v, g, [0.5, 0.8, 1.0], [0.0, 0.3])


@query(C + " select topic, round(quantile_cont(value, 0.5), 4) as p50, round(quantile_cont(value, 0.95), 4) as p95, max(value) as most, round(avg(k), 4) as results, round(avg(ceil(k / 4)), 4) as tokens from calls group by 1")
def ops_summary(spark, d):
    c = view(spark, d, "calls").select("topic", F.col("value").alias("latency_ms"), F.col("k").alias("result_count"), F.col("k").alias("chars"))
    return E.ops_summary(c, ["topic"])


@query(C + ", d as (select topic as suite, ts::date as day, round(count(*) filter (event_type = 'view') / count(*), 6) as recall, max(k)::double as p50 from calls group by 1, 2), r as (select *, row_number() over (partition by suite order by day desc) as r from d), g as (select suite, max(recall) filter (r = 1) as r, avg(recall) filter (r > 1 and r <= 4) as r0, max(p50) filter (r = 1) as t, avg(p50) filter (r > 1 and r <= 4) as t0 from r group by 1) select suite, round(r - r0, 6) as recall_change, round(t / t0, 6) as latency_ratio, coalesce(r - r0 < -0.05::double or t > t0 * 1.5::double, false) as regressed from g")
def eval_regression(spark, d):
    runs = view(spark, d, "calls").groupBy(F.col("topic").alias("suite"), F.to_date("ts").alias("at")).agg(
        F.round(F.count(F.when(F.col("event_type") == "view", 1)) / F.count("*"), 6).alias("recall"), F.max("k").cast("double").alias("p50"))
    return E.regression(runs)


@query("with a as (select doc_id as query_id, text, ['the', 'QUE', 'der', 'x' || (doc_id % 7), 'and'] as f from documents), s as (select query_id, round(len(list_filter(f, lambda x: contains(lower(text), lower(x)))) / 5, 6) as share from a) select query_id, share, case when share >= 0.8 then 'good' when share >= 0.6 then 'fair' when share >= 0.4 then 'poor' else 'failed' end as grade from s")
def fragment_eval(spark, d):
    f = F.array(F.lit("the"), F.lit("QUE"), F.lit("der"), F.concat(F.lit("x"), F.col("doc_id") % 7), F.lit("and"))
    return E.fragment_eval(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("query_id"), "text", f.alias("fragments")))


@query(K + " select domain as category, count(*) as n, count(*) filter (outcome = 'SUCCESS') as right, round(avg((outcome = 'SUCCESS')::int), 6) as accuracy from tasks group by 1".replace(" as right", ' as "right"'))
def accuracy_by_category(spark, d):
    return E.accuracy_by_category(view(spark, d, "tasks").select(F.col("domain").alias("category"), (F.col("outcome") == "SUCCESS").alias("correct")))


@query(H + " select query_id, round(count(*) filter (rank <= 5 and (doc_id + query_id) % 4 = 0) / 5, 6) as p_at_5, round(count(*) filter ((doc_id + query_id) % 4 = 0) / 10, 6) as p_at_10 from hits where variant = 'v1' and rank <= 10 group by 1")
def precision_at_k(spark, d):
    r = view(spark, d, "hits").where("variant = 'v1'").select("query_id", "doc_id", "rank")
    return E.precision_at(r, r.where("(doc_id + query_id) % 4 = 0"))


@query(K + ", b as (select agent_id as key, round(avg((outcome = 'SUCCESS')::int), 3) as value from tasks where task_id % 5 <> 0 and agent_id <> 'agent3' group by 1), a as (select agent_id as key, round(avg((outcome = 'SUCCESS')::int), 3) as value from tasks where task_id % 5 <> 1 and agent_id <> 'agent5' group by 1) select coalesce(a.key, b.key) as key, round(a.value - b.value, 6) as delta, case when b.value is null then 'new' when a.value is null then 'gone' when abs(round(a.value - b.value, 6)) < 0.001 then 'same' when a.value > b.value then 'better' else 'worse' end as state from a full join b on a.key = b.key")
def compare_reports(spark, d):
    t = view(spark, d, "tasks")
    report = lambda x: x.groupBy(F.col("agent_id").alias("key")).agg(F.round(F.avg((F.col("outcome") == "SUCCESS").cast("int")), 3).alias("value"))
    return E.compare_reports(report(t.where("task_id % 5 <> 0 and agent_id <> 'agent3'")), report(t.where("task_id % 5 <> 1 and agent_id <> 'agent5'")))


@query(K + ", p as (select domain, avg(duration_ms) as m from tasks group by 1), r as (select *, m / avg(m) over () as ratio from p) select domain, round(m, 6) as mean, round(ratio, 6) as ratio, case when ratio >= 1.01::double then 'high' when ratio <= 1 / 1.01::double then 'low' else 'usual' end as flag from r")
def group_insights(spark, d):
    return E.group_flags(view(spark, d, "tasks"), "domain", "duration_ms", 1.01)
