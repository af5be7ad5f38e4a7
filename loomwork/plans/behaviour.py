"""Queries of loomwork.operators.behaviour."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import behaviour as B
from loomwork.operators.vectors import unit
from loomwork.plans.registry import query
from loomwork.sources.views import NOW, view, view_sql

K, M, C = view_sql("tasks"), view_sql("memories"), view_sql("calls")
_DECAY = f"2.0::double ** (-(epoch(timestamp '{NOW}' - created_at) / 86400 / 30))"
_W = "case outcome when 'SUCCESS' then 1.0::double when 'FAILURE' then -1.5::double else -0.5::double end"


def tasks(spark, d):
    return view(spark, d, "tasks")


@query(K + f" select agent_id, domain, round((sum({_W} * {_DECAY}) / sum(abs({_W}) * {_DECAY}) + 1) / 2, 6) as trust, count(*) as n from tasks group by 1, 2")
def trust_score(spark, d):
    return B.trust_score(tasks(spark, d).withColumn("weight", B.signed(F.col("outcome"))), NOW, ["agent_id", "domain"])


@query(K + f""", p as (select *, case outcome when 'SUCCESS' then 1.0::double when 'PARTIAL' then 0.5::double else 0 end as p, {_DECAY} as d, row_number() over (partition by agent_id, domain order by created_at, task_id) as r, count(*) over (partition by agent_id, domain) as n from tasks),
g as (select agent_id, domain, round(sum(p * d) / sum(d), 6) as decayed, round(avg((outcome = 'SUCCESS')::int), 6) as success_rate, round(avg(duration_ms), 4) as avg_duration, count(*) as n, avg(p) filter (r * 2 > n) as late, avg(p) filter (r * 2 <= n) as early from p group by 1, 2)
select agent_id, domain, decayed, success_rate, avg_duration, n, case when n < 4 then 'stable' when late - early > 0.1::double then 'improving' when late - early < -0.1::double then 'declining' else 'stable' end as trend from g""")
def trust_profile(spark, d):
    return B.trust_profile(tasks(spark, d), NOW)


_HIST = f", dd as (select agent_id, created_at::date as day, sum({_W}) as s, count(*) as c from tasks group by 1, 2), h as (select agent_id, day, round(sum(s) over w / sum(c) over w, 6) as score, (sum(c) over w)::bigint as n from dd window w as (partition by agent_id order by day))"


@query(K + _HIST + " select agent_id, day::varchar as day, score, n from h")
def trust_history(spark, d):
    return B.trust_history(tasks(spark, d)).withColumn("day", F.col("day").cast("string"))


@query(K + _HIST + ", c as (select agent_id, day, round(score - lag(score) over (partition by agent_id order by day), 6) as change from h) select agent_id, day::varchar as day, change, case when abs(change) >= 0.15::double then 'large' when abs(change) >= 0.05::double then 'moderate' else 'slight' end as size, (case when abs(change) >= 0.15::double then 0.9 when abs(change) >= 0.05::double then 0.7 else 0.5 end)::double as importance from c where abs(change) >= 0.005::double")
def trust_changes(spark, d):
    return B.trust_changes(B.trust_history(tasks(spark, d))).withColumn("day", F.col("day").cast("string"))


@query(K + ", b as (select * from tasks where outcome = 'FAILURE') select 'agent' as kind, agent_id as subject, count(*) as n from b group by 2 having count(*) >= 2 union all select 'timeout', agent_id, count(*) from b where contains(reason, 'timeout') group by 2 having count(*) >= 2 union all select 'domain', domain, count(*) from b group by 2 having count(*) >= 3 and count(distinct agent_id) >= 2")
def failure_patterns(spark, d):
    return B.failure_patterns(tasks(spark, d))


_CAP = "select agent_id, domain, count(*) as successes, min(epoch(created_at))::bigint as first, max(epoch(created_at))::bigint as last from tasks where outcome = 'SUCCESS' and {} group by 1, 2 having count(*) >= 2"


@query(K + " " + _CAP.format("true"))
def capability_checkpoint(spark, d):
    return B.capability_checkpoint(tasks(spark, d))


@query(K + f", b as ({_CAP.format('task_id % 9 = 0')}), a as ({_CAP.format('task_id % 4 = 0')}) select a.agent_id, a.domain, case when b.successes is null then 'gained' else 'improved' end as change, a.successes - coalesce(b.successes, 0) as gain from a left join b on a.agent_id = b.agent_id and a.domain = b.domain where b.successes is null or a.successes > b.successes")
def capability_delta(spark, d):
    t = tasks(spark, d)
    return B.capability_delta(B.capability_checkpoint(t.where("task_id % 9 = 0")), B.capability_checkpoint(t.where("task_id % 4 = 0")))


@query(K + " select agent_id, domain, count(*) as n, round(avg((outcome = 'SUCCESS')::int), 6) as success, round(least(1.0::double, 0.3::double + 0.7::double * (1 - exp(-count(*) / 10.0::double))), 6) as confidence from tasks group by 1, 2")
def capability_profile(spark, d):
    return B.capability_profile(tasks(spark, d))


@query(K + " select agent_id, domain, count(*) filter (outcome = 'SUCCESS') as successes, round(2 - 2.0::double ** (-count(*) filter (outcome = 'SUCCESS') / 15.0::double), 6) as weight from tasks group by 1, 2")
def experience_weights(spark, d):
    return B.experience_weights(tasks(spark, d))


@query(K + ", r as (select *, avg(duration_ms) over (partition by agent_id order by created_at, task_id rows between unbounded preceding and 1 preceding) as before from tasks), g as (select agent_id, round(avg(duration_ms), 4) as avg, min(duration_ms) as least, max(duration_ms) as most, arg_max(duration_ms, (created_at, task_id)) as latest, arg_max(before, (created_at, task_id)) as before from r group by 1) select agent_id, avg, least, most, latest, case when latest > 1.05::double * before then 'up' when latest < 0.95::double * before then 'down' else 'stable' end as trend from g")
def work_style(spark, d):
    return B.work_style(tasks(spark, d))


@query(K + ", n as (select agent_id, outcome, count(*) as n from tasks group by 1, 2) select *, round(n / sum(n) over (partition by agent_id), 6) as share from n")
def outcome_frequencies(spark, d):
    return B.frequencies(tasks(spark, d), ["agent_id"], "outcome")


@query(C + ", t as (select distinct agent_id, (user_id * 100 + k) % 700 as item from calls), i as (select item, cast(item % 101 as double) / 100 as importance from (select distinct item from t)) select a.agent_id as left_agent, b.agent_id as right_agent, count(*) as shared, round(sum(importance) / count(*), 6) as importance from t a join t b on a.item = b.item and a.agent_id < b.agent_id join i on i.item = a.item group by 1, 2")
def collaboration_pairs(spark, d):
    item = (F.col("user_id") * 100 + F.col("k")) % 700
    return B.collaboration_pairs(view(spark, d, "calls").select("agent_id", item.alias("item"), ((item % 101).cast("double") / 100).alias("importance"))).withColumn("shared", F.col("shared").cast("long"))


@query(K + ", r as (select domain, agent_id, round(avg((outcome = 'SUCCESS')::int), 6) as success_rate, count(*) as n, count(*) filter (outcome = 'FAILURE') as failures from tasks group by 1, 2) select domain, agent_id, success_rate, failures, rank::int as rank from (select *, row_number() over (partition by domain order by success_rate desc, n desc, agent_id) as rank from r) where rank <= 3")
def recommend_agent(spark, d):
    return B.recommend_agent(tasks(spark, d))


@query(K + ", v as (select l_orderkey as task_id, arg_max((l_linestatus = 'O', l_quantity > 40), (l_linenumber, l_linestatus = 'O', l_quantity > 40)) as x from lineitem where l_orderkey % 4 <> 0 group by 1) select task_id, case when x is null then 'not validated' when not x[1] then 'validation failed' when x[2] then 'open checks' when outcome = 'FAILURE' then 'failed' else 'trusted' end as verdict from tasks left join v using (task_id)")
def task_trust_report(spark, d):
    line = spark.read.parquet(f"{d}/lineitem.parquet").where("l_orderkey % 4 <> 0")
    checks = F.array(F.when(F.col("l_quantity") > 40, "open").otherwise("done"))
    v = line.select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("at"), (F.col("l_linestatus") == "O").alias("passed"), checks.alias("checks"))
    return B.task_report(tasks(spark, d), v)


@query("select l_orderkey as task_id, case when l_linestatus = 'O' then 'SUCCESS' else 'FAILURE' end as signal, (case when l_linestatus = 'O' then 0.7 else 1.0 end)::double as weight from lineitem union all select l_orderkey, case when l_returnflag = 'R' then 'FAILURE' else 'SUCCESS' end, (case when l_returnflag = 'R' then 1.2 else 1.3 end)::double from lineitem where l_returnflag = 'R' or (l_returnflag = 'A' and l_quantity > 25)")
def evidence_signals(spark, d):
    line = spark.read.parquet(f"{d}/lineitem.parquet").withColumnRenamed("l_orderkey", "task_id")
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "clean").otherwise("sent")
    return B.evidence_to_signals(line.select("task_id", (F.col("l_linestatus") == "O").alias("passed")), line.select("task_id", status.alias("status"), (F.col("l_quantity") > 25).alias("verified")))


@query(K + ", r as (select delegator, outcome as state, lag(outcome) over (partition by delegator order by created_at, task_id) as from_state from tasks) select delegator, from_state, state as to_state, count(*) as n from r where from_state is not null and not (from_state = 'FAILURE' and state = 'SUCCESS') and not (from_state = 'PARTIAL' and state = 'SUCCESS') and not (from_state = 'SUCCESS' and state = 'SUCCESS') group by 1, 2, 3")
def contract_transitions(spark, d):
    allowed = [("FAILURE", "SUCCESS"), ("PARTIAL", "SUCCESS"), ("SUCCESS", "SUCCESS")]
    return B.illegal_transitions(tasks(spark, d).withColumn("state", F.col("outcome")), allowed, ["delegator"], ["created_at", "task_id"])


@query(M + f", a as (select agent_id, layer, epoch(timestamp '{NOW}' - created_at) / 3600 as age from memories), n as (select agent_id, layer, count(*) filter (age >= 0 and age < 120) as s, count(*) filter (age >= 0 and age < 720) as l from a group by 1, 2), w as (select *, sum(s) over (partition by agent_id) as ss, sum(l) over (partition by agent_id) as ll from n) select agent_id, round(sum(abs(round(s / ss, 2) - round(l / ll, 2))) / 2, 4) as distance from w where ss >= 3 and ll >= 5 group by 1")
def behaviour_drift(spark, d):
    return B.behaviour_drift(view(spark, d, "memories"), NOW, "layer", short=120)


@query(C + ", m as (select user_id, topic as entity, count(*) as n from calls group by 1, 2), s as (select *, round(n / sum(n) over (partition by user_id), 6) as share from m) select * from s where share > 0.25::double and n >= 15")
def hot_entities(spark, d):
    return B.hot_entities(view(spark, d, "calls").withColumnRenamed("topic", "entity"), 0.25, 15)


@query(M + f" select user_id, count(*) filter (created_at > timestamp '2024-01-25') as new_rows, count(*) filter (importance >= 0.7 and retrieval_count = 0 and epoch(timestamp '{NOW}' - created_at) / 86400 > 7) as forgotten, date_diff('day', min(created_at)::date, max(created_at)::date)::int as span_days from memories group by 1")
def memory_observations(spark, d):
    return B.memory_observations(view(spark, d, "memories"), NOW, "2024-01-25")


_WORK = ", w as (select *, ['SYSTEM', 'AGENT_OBSERVATION', 'AGENT_REFLECTION', 'EXPLICIT_STATEMENT'][memory_id % 16 // 4 + 1] as made_by, case when memory_id % 48 < 14 then 'Completed: ' || raw else raw end as said from memories where deleted_at is null and not user_hidden)"


def worked(spark, d):
    k = F.col("memory_id")
    origin = F.element_at(F.array(*map(F.lit, ("SYSTEM", "AGENT_OBSERVATION", "AGENT_REFLECTION", "EXPLICIT_STATEMENT"))), (F.floor(k % 16 / 4) + 1).cast("int"))
    return view(spark, d, "memories").withColumns({"origin": origin, "raw": F.when(k % 48 < 14, F.concat(F.lit("Completed: "), "raw")).otherwise(F.col("raw"))})


@query(M + _WORK + ", t as (select agent_id, memory_type, count(*) as n from w where memory_type is not null group by 1, 2), l as (select agent_id, list(memory_type order by n desc, memory_type) as types, list(n order by n desc, memory_type) as counts from t group by 1) select agent_id, count(*) as total, count(*) filter (made_by = 'SYSTEM') as completions, count(*) filter (made_by = 'AGENT_REFLECTION') as reflections, epoch(min(created_at))::bigint as active_since, any_value(types) as types, any_value(counts) as counts from w join l using (agent_id) group by agent_id")
def work_history(spark, d):
    return B.work_history(worked(spark, d)).withColumn("active_since", F.unix_timestamp("active_since"))


@query(M + _WORK + ", t as (select agent_id, count(*) filter (made_by in ('SYSTEM', 'AGENT_OBSERVATION')) as tasks, count(*) filter (made_by in ('SYSTEM', 'AGENT_OBSERVATION') and (contains(lower(said), 'success') or contains(lower(said), 'completed'))) as good, sum(importance) filter (made_by in ('SYSTEM', 'AGENT_OBSERVATION')) as s from w group by 1) select agent_id, tasks, case when tasks = 0 then 0.0::double else round(good::double / tasks, 6) end as success_rate, case when tasks = 0 then 0.0::double else round(s / tasks, 6) end as quality from t")
def portable_trust(spark, d):
    return B.portable_trust(worked(spark, d), digits=6)


@query(M + ", n as (select agent_id, tag, 'topic' as category, count(*) as n from (select agent_id, unnest(tags) as tag from memories) group by 1, 2 union all select agent_id, memory_type, 'memory_type', count(*) from memories where memory_type is not null group by 1, 2) select agent_id, category, tag as pattern, n, rank::int as rank from (select *, row_number() over (partition by agent_id order by n desc, category || ':' || tag) as rank from n where n >= 2) where rank <= 15")
def topic_and_type_patterns(spark, d):
    m = view(spark, d, "memories")
    topics = m.select("agent_id", F.explode(F.transform("tags", lambda t: F.concat(F.lit("topic:"), t))).alias("v"))
    types = m.where("memory_type is not null").select("agent_id", F.concat(F.lit("memory_type:"), "memory_type").alias("v"))
    rows = B.top_values(topics.unionAll(types), ["agent_id"], "v")
    return rows.select("agent_id", F.substring_index("v", ":", 1).alias("category"), F.expr("substring(v, instr(v, ':') + 1)").alias("pattern"), "n", "rank")


@query(M + ", n as (select agent_id, unnest(tags) as tag, count(*) as n from memories group by 1, 2) select agent_id, tag, n, rank::int as rank from (select *, row_number() over (partition by agent_id order by n desc, tag) as rank from n where n >= 2) where rank <= 15")
def behaviour_patterns(spark, d):
    return B.top_values(view(spark, d, "memories").select("agent_id", F.explode("tags").alias("tag")), ["agent_id"], "tag")


@query(K + ", g as (select agent_id, count(*) as n, round(avg((outcome = 'SUCCESS')::int), 6) as success_rate, round(avg(duration_ms), 4) as avg_duration from tasks group by 1), f as (select agent_id, reason, count(*) as c from tasks where outcome = 'FAILURE' group by 1, 2), fr as (select *, row_number() over (partition by agent_id order by c desc, reason) as r from f), fl as (select agent_id, list(reason order by r) as reasons from fr where r <= 5 group by 1), l as (select *, row_number() over (partition by agent_id order by created_at desc, task_id desc) as r from tasks), s as (select distinct agent_id from (select agent_id, reason, count(*) as c from l where r <= 5 and outcome = 'FAILURE' group by 1, 2) where c >= 3) select g.*, reasons, s.agent_id is not null as stuck from g left join fl on fl.agent_id = g.agent_id left join s on s.agent_id = g.agent_id")
def task_stats(spark, d):
    return B.task_stats(tasks(spark, d))


@query(K + ", p as (select agent_id, lower(domain) as d, least(1.0::double, 0.3::double + 0.7::double * (1 - exp(-count(*) / 10.0::double))) as c from tasks group by agent_id, domain), w as (select distinct task_id, agent_id, unnest(['urgent', 'medium', reason]) as w from tasks where task_id % 3 = 0), x as (select task_id, agent_id, unnest(regexp_split_to_array(w, '[^a-z0-9]+')) as w from w), m as (select task_id, min(c) as c from x join p using (agent_id) where length(w) > 2 and (contains(d, w) or contains(w, d)) group by 1) select task_id, round(c, 6) as lowest, c < 0.95::double as risky from m")
def capability_check(spark, d):
    t = tasks(spark, d)
    profile = t.groupBy("agent_id", "domain").agg(F.count("*").alias("n")).select("agent_id", "domain", F.least(F.lit(1.0), 0.3 + 0.7 * (1 - F.exp(-F.col("n") / 10.0))).alias("confidence"))
    asked = t.where("task_id % 3 = 0").select("task_id", "agent_id", F.concat(F.lit("urgent medium "), "reason").alias("text"))
    return B.capability_check(asked, profile, 0.95).withColumn("lowest", F.round("lowest", 6))


@query(K + " select agent_id, domain, arg_max(outcome, (created_at, task_id)) as outcome, arg_max(task_id, (created_at, task_id)) as task_id from tasks group by 1, 2")
def latest_by_area(spark, d):
    return B.latest_by(tasks(spark, d).select("agent_id", "domain", "outcome", "task_id", "created_at"), ["agent_id", "domain"], ["created_at", "task_id"]).drop("created_at")


_KEYS = [("speech", "the"), ("speech", "and"), ("travel", "que"), ("travel", "der"), ("code", "of")]


@query(M + ", k(capability, word) as (values " + ", ".join(f"('{c}', '{w}')" for c, w in _KEYS) + "), t as (select *, row_number() over (partition by agent_id order by importance desc, memory_id) as r from memories), w as (select agent_id, memory_id, unnest(list_distinct(regexp_split_to_array(lower(raw), '[^a-z0-9]+'))) as word from t where r <= 50), h as (select agent_id, capability, least(1.0::double, count(*) * 0.3::double) as s from w join k using (word) group by 1, 2) select capability, round(avg(s), 6) as score, count(*) as contributors from h group by 1")
def team_capabilities(spark, d):
    return B.team_capabilities(view(spark, d, "memories").select("agent_id", "memory_id", "raw", "importance"), spark.createDataFrame(_KEYS, "capability string, word string"))


@query(K + ", q as (select task_id as query_id, domain, array_to_string(string_split(reason, ' ')[1:3], ' ') as phrase from tasks where task_id % 20 = 0), r as (select query_id, t.task_id, row_number() over (partition by query_id order by created_at desc, t.task_id) as rank from q join tasks t on t.domain = q.domain and contains(lower(reason), lower(phrase))) select query_id, task_id, 0.5::double as similarity, rank::int as rank from r where rank <= 5")
def similar_tasks(spark, d):
    t = tasks(spark, d)
    return B.similar_tasks(t.where("task_id % 20 = 0").select(F.col("task_id").alias("query_id"), "domain", F.col("reason").alias("text")), t)


_TV = ", t as (select task_id, domain, reason, created_at, embedding from tasks left join embeddings on vec_id = task_id), q as (select task_id as query_id, domain, array_to_string(string_split(reason, ' ')[1:3], ' ') as phrase, case when task_id % 40 <> 0 then embedding end as q from t where task_id % 20 = 0), n as (select query_id, task_id, round(list_cosine_similarity(q::double[], embedding::double[]), 6) as similarity from q join t on q is not null and embedding is not null and query_id <> task_id), a as (select *, row_number() over (partition by query_id order by similarity desc, task_id) as rank from n), b as (select query_id, task_id, 0.5::double as similarity, row_number() over (partition by query_id order by created_at desc, task_id) as rank from q join t on t.domain = q.domain and contains(lower(reason), lower(phrase)) where q is null)"


@query(K + _TV + " select query_id, task_id, similarity, rank::int as rank from a where rank <= 5 union all select query_id, task_id, similarity, rank::int from b where rank <= 5")
def similar_tasks_by_vector(spark, d):
    t = tasks(spark, d).join(view(spark, d, "vectors").select(F.col("vec_id").alias("task_id"), unit(F.col("embedding")).alias("v")), "task_id", "left")
    q = t.where("task_id % 20 = 0").select(F.col("task_id").alias("query_id"), "domain", F.col("reason").alias("text"), F.when(F.col("task_id") % 40 != 0, F.col("v")).alias("q"))
    return B.similar_tasks_by_vector(q, t)
