"""Queries of loomwork.operators.scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import scoring as S
from loomwork.plans.registry import query
from loomwork.sources.views import NOW, view, view_sql

H, M, C = view_sql("hits"), view_sql("memories"), view_sql("calls")


@query(H + ", l as (select query_id, doc_id, rank, score, variant = 'v0' as is_v from hits where variant in ('v0', 'v1')) select query_id, doc_id, round(sum((case when is_v then 0.6 else 0.4 end)::double / (60 + rank)), 9) as rrf, coalesce(max(score) filter (is_v), max(score) filter (not is_v)) as score, case when count(distinct is_v) = 2 then 'hybrid' when max(is_v::int) = 1 then 'vector' else 'text' end as method from l group by query_id, doc_id")
def rrf_hybrid(spark, d):
    h = view(spark, d, "hits")
    return S.rrf_hybrid(h.where("variant = 'v0'"), h.where("variant = 'v1'"))


_REL = "round(s / max(s) over (partition by query_id), 6)"


@query(H + f", r as (select query_id, doc_id, sum(1.0::double / (60 + rank)) as s, count(distinct variant) as query_count, min(rank) as best_rank, avg(score) as a, list_sort(list(distinct variant)) as matches from hits group by 1, 2 having count(distinct variant) >= 2) select query_id, doc_id, {_REL} as fused, query_count, best_rank, round(a, 6) as avg_score, matches from r")
def rrf_variants(spark, d):
    return S.rrf(view(spark, d, "hits"), 2)


@query(H + ", v as (select query_id, count(distinct variant) as n from hits group by 1), r as (select query_id, doc_id, count(distinct variant) as c, max(score) as m from hits group by 1, 2) select query_id, doc_id, round(0.4::double * c / n + 0.6::double * m, 6) as fused from r join v using (query_id)")
def frequency_fusion(spark, d):
    return S.frequency_fusion(view(spark, d, "hits"))


@query(H + f", r as (select query_id, doc_id, sum((case source when 'original' then 2.0 when 'rules' then 1.0 else 0.8 end)::double / (60 + rank)) as s from hits group by 1, 2) select query_id, doc_id, {_REL} as fused from r")
def weighted_rrf(spark, d):
    return S.weighted_rrf(view(spark, d, "hits"))


@query(H + " select query_id, doc_id, round(least(1.0::double, max(score) + least(0.1::double, 0.02::double * count(distinct variant))), 6) as fused from hits group by 1, 2")
def max_score_fusion(spark, d):
    return S.max_score_fusion(view(spark, d, "hits"))


@query(H + " select query_id, doc_id, round(sum((case variant when 'v0' then 1.0 when 'v1' then 0.8 else 0.5 end)::double / (60 + rank)) * case when count(distinct variant) > 1 then 1 + 0.1::double * count(distinct variant) / 4 else 1 end, 9) as fused, count(distinct variant) as hit from hits group by 1, 2")
def ensemble_rrf(spark, d):
    w = F.when(F.col("variant") == "v0", 1.0).when(F.col("variant") == "v1", 0.8).otherwise(0.5)
    return S.ensemble_rrf(view(spark, d, "hits").withColumn("weight", w), 4)


@query(H + ", l as (select query_id, variant, max(rank) + 1 as absent from hits group by 1, 2), p as (select distinct query_id, doc_id from hits) select p.query_id, p.doc_id, round(sum(1.0::double / (60 + coalesce(h.rank, l.absent))), 9) as fused from p join l using (query_id) left join hits h on h.query_id = p.query_id and h.doc_id = p.doc_id and h.variant = l.variant group by 1, 2")
def rerank_rrf(spark, d):
    return S.rerank_rrf(view(spark, d, "hits"))


@query(H + ", v as (select query_id, count(distinct variant) as n from hits group by 1) select query_id, doc_id, list_sort(list(distinct variant)) as variants, round(sum(1.0::double / (60 + rank)), 9) as rrf, round(count(distinct variant) / any_value(n), 6) as frequency, case when bool_or(source = 'original') then 1.5::double else 1.0::double end as original_boost from hits join v using (query_id) group by 1, 2")
def explain_fusion(spark, d):
    return S.explain_fusion(view(spark, d, "hits"))


_W = r"""with q as (select item_id, text, list_filter(regexp_split_to_array(trim(text), '[ \t\r\n]+'), lambda w: w <> '') as w from benchmark),
k as (select item_id, least(1.0::double, (case when len(w) <= 3 then 2 else 0 end + 2 * len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]{2,}$'))) + len(list_filter(w[2:10001], lambda x: regexp_matches(x, '^[A-Z][a-z]+$')))
 + case when regexp_matches(text, '[A-Za-z]+[-_]?[0-9]+') then 3 else 0 end + case when regexp_matches(text, '"[^"]+"') then 3 else 0 end) / (len(w) + 1.0::double)) as kw from q),
t as (select item_id, least(0.8::double, 0.4::double + 0.3::double * kw) as t from k)
select item_id, round(greatest(0.2::double, 1 - t), 6) as vector_weight, round(t, 6) as text_weight from t"""


@query(_W)
def query_weights(spark, d):
    b = spark.read.parquet(f"{d}/benchmark.parquet").withColumn("w", S.query_weights(F.col("text")))
    return b.select("item_id", F.col("w.vector").alias("vector_weight"), F.col("w.text").alias("text_weight"))


_DAYS = f"(epoch(timestamp '{NOW}' - last_retrieved_at) / 86400)"
_LIVE = "deleted_at is null and superseded_by is null and searchable and not user_hidden"
_AGE = f"(epoch(timestamp '{NOW}' - created_at) / 86400)"


@query(M + f" select memory_id, (case when user_pinned then 1 when {_DAYS} <= 7 then 1 when {_DAYS} <= 30 then 0.9 when {_DAYS} <= 90 then 0.75 when retrieval_count / greatest(1, {_AGE}) > 0.1 then 0.8 else 0.6 end)::double as weight from memories")
def tier_weight(spark, d):
    return view(spark, d, "memories").select("memory_id", S.tier_weight(NOW).alias("weight"))


@query(M + f", u as (select *, used_count * 2 * exp(-ln(2.0::double) / 14 * (epoch(timestamp '{NOW}' - last_used_at) / 86400)) as u from memories) select memory_id, round(effective * 0.85::double + (case when used_count > 0 and last_used_at is not null then least(1.0::double, u / (u + 10) * case when used_count > unused_count then 1.5::double when used_count < unused_count then 0.5::double else 1 end) else 0 end) * 0.15::double, 6) as score from u")
def usage_weight(spark, d):
    days = S.hours_before(NOW, F.col("last_used_at")) / 24
    w = S.usage_weight(F.col("effective"), F.col("used_count"), days, F.col("used_count") - F.col("unused_count"))
    return view(spark, d, "memories").select("memory_id", F.round(w, 6).alias("score"))


_POL = "case when p + n = 0 then 0 when p >= n then 1 else -1 end"
_TOK = "regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+')"


@query(f"with t as (select doc_id, len(list_filter({_TOK}, lambda w: w in ('the', 'of'))) as p, len(list_filter({_TOK}, lambda w: w in ('and', 'que', 'der'))) as n from documents) select doc_id, {_POL} as polarity, case when {_POL} = 1 then 1.0::double when {_POL} = 0 then 0.75::double else 0.15::double end as penalty from t")
def sentiment_penalty(spark, d):
    # words that the generated texts have
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", S.polarity(F.col("text"), ["the", "of"], ["and", "que", "der"]).alias("polarity"))
    return rows.withColumn("penalty", S.sentiment_penalty(F.lit(1), F.col("polarity")))


@query(H + ", i as (select *, cast((doc_id * 53) % 101 as double) / 100 as imp from hits where variant = 'v0') select query_id, doc_id, round((0.85::double * score + 0.15::double * imp) * case when imp < 0.35::double then 0.4::double else 1 end, 6) as plain, round(0.85::double * (score / max(score) over (partition by query_id)) + 0.15::double * imp, 6) as reranked from i")
def final_blend(spark, d):
    h = view(spark, d, "hits").where("variant = 'v0'").withColumn("imp", ((F.col("doc_id") * 53) % 101).cast("double") / 100)
    plain, again = S.final_blend(F.col("score"), F.col("imp"), F.lit(1.0)), S.final_blend(F.col("score"), F.col("imp"), F.lit(1.0), F.col("score"))
    return h.select("query_id", "doc_id", F.round(plain, 6).alias("plain"), F.round(again, 6).alias("reranked"))


@query(M + ", w as (select memory_id, effective, importance, greatest(epoch(timestamp '2024-01-12') - epoch(coalesce(observed_at, created_at)), epoch(coalesce(observed_at, created_at)) - epoch(timestamp '2024-01-15'), 0) / 86400 as days from memories), r as (select *, case when days = 0 then 1.0::double when days <= 1 then 0.7::double when days <= 7 then 0.5::double - 0.4::double * days / 7 else 0 end as rel from w) select memory_id, round(rel, 6) as relevance, round(0.3::double * effective + 0.5::double * rel + 0.2::double * importance, 6) as score from r")
def temporal_relevance(spark, d):
    m = view(spark, d, "memories")
    rel = S.temporal_relevance(F.coalesce("observed_at", "created_at"), F.lit("2024-01-12"), F.lit("2024-01-15"))
    m = m.withColumn("rel", rel)
    return m.select("memory_id", F.round("rel", 6).alias("relevance"), F.round(S.blend_time(F.col("effective"), F.col("rel"), F.col("importance"), F.lit(True)), 6).alias("score"))


@query(C + """, q as (select distinct user_id as query_id, user_id, 1704067200 + 86400 * (5 + user_id % 15) as s, 1704067200 + 86400 * (5 + user_id % 15) + 7200 * (1 + user_id % 9) as e from calls),
w as (select query_id, user_id, e, p.pass, floor((e + s) / 2.0::double - (e - s) / 2.0::double * 2 ** p.pass)::bigint as st from q, (select unnest([0, 1, 2, 3]) as pass) p),
n as (select w.query_id, w.pass, w.st, w.e, count(c.event_id) as n from w left join calls c on c.user_id = w.user_id and floor(epoch(c.ts))::bigint between w.st and w.e group by all),
f as (select *, row_number() over (partition by query_id order by case when n >= 5 then 0 else 1 end, case when n >= 5 then pass else -pass end) as r from n)
select query_id, pass::int as pass, st as start, e::bigint as "end", n from f where r = 1""")
def adaptive_window(spark, d):
    c = view(spark, d, "calls")
    start = 1704067200 + 86400 * (5 + F.col("user_id") % 15)
    q = c.select(F.col("user_id").alias("query_id"), "user_id", start.alias("start"), (start + 7200 * (1 + F.col("user_id") % 9)).alias("end")).distinct()
    return S.adaptive_window(q, c.select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at")), "user_id")


@query(M + " select memory_id, round(effective * case when created_at between timestamp '2024-01-10' and timestamp '2024-01-20' then 1.1::double else 1 end * case when agent_id = 'agent3' then 1.2::double else 1 end, 6) as score from memories")
def soft_window_and_agent_boost(spark, d):
    s = S.soft_window_boost(F.col("effective"), F.col("created_at"), F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))
    return view(spark, d, "memories").select("memory_id", F.round(S.agent_boost(s, F.col("agent_id"), F.lit("agent3")), 6).alias("score"))


@query(H + ", a as (select query_id, doc_id, score from hits where variant = 'v0'), g as (select query_id, doc_id, score from hits where variant = 'v2') select coalesce(a.query_id, g.query_id) as query_id, coalesce(a.doc_id, g.doc_id) as doc_id, round(case when a.score is not null and g.score is not null then a.score * 1.2::double else coalesce(a.score, g.score) end, 6) as score from a full join g on a.query_id = g.query_id and a.doc_id = g.doc_id")
def graph_boost(spark, d):
    h = view(spark, d, "hits")
    return S.graph_boost(h.where("variant = 'v0'"), h.where("variant = 'v2'"))


@query(
    view_sql("hits", "memories") + f", f as (select query_id, doc_id, score from hits where variant = 'v0'), n as (select query_id, doc_id, score as sim from hits where variant = 'v3'), k as (select *, row_number() over (partition by user_id order by importance desc, created_at desc, memory_id) as r from memories where layer in ('INSIGHT', 'TASK') and importance >= 0.6 and created_at >= timestamp '{NOW}' - interval 14 day)"
    ", p as (select memory_id as doc_id, importance from k where r <= 25) select * from f union all select query_id, doc_id, round(sim + 0.3::double * importance, 6) from n join p using (doc_id) where sim > 0.3::double and not exists (select 1 from f where f.query_id = n.query_id and f.doc_id = n.doc_id)"
)
def surface_insights(spark, d):
    h = view(spark, d, "hits")
    # the given texts have no layer of insights; tasks stand in for it
    told = view(spark, d, "memories").withColumn("layer", F.when(F.col("layer") == "TASK", "INSIGHT").otherwise(F.col("layer")))
    near = h.where("variant = 'v3'").select("query_id", "doc_id", F.col("score").alias("similarity"))
    pool = near.select("query_id", "doc_id").join(S.insight_pool(told, NOW).drop("user_id"), "doc_id")
    return S.surface_insights(h.where("variant = 'v0'"), near, pool)


@query(M + ", w as (select unnest(tags) as topic, count(*) as n from memories where used_count > 3 group by 1), x as (select topic, 2 - 2.0::double ** (-(n % 40) / 15.0::double) as weight from w), p as (select memory_id, max(weight) as w from (select memory_id, unnest(tags) as topic from memories) join x using (topic) group by 1) select memory_id, round(effective * coalesce(w, 1.0::double), 6) as score from memories left join p using (memory_id)")
def experience_boost(spark, d):
    m = view(spark, d, "memories")
    counts = m.where("used_count > 3").select(F.explode("tags").alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))
    weights = counts.select("topic", S.experience_weight(F.col("n") % 40).alias("weight"))
    return S.experience_boost(m.select("memory_id", F.col("effective").alias("score"), F.col("tags").alias("topics")), weights)


@query(H + ", h as (select query_id, doc_id, rank from hits where variant = 'v0'), s as (select doc_id, (doc_id * 7 + p) % 100 as source_id, p as place from (select distinct doc_id from hits where doc_id % 5 = 0), (select unnest([1, 2, 3, 4]) as p) where p <= 3), r as (select query_id, coalesce(source_id, h.doc_id) as doc_id, rank, coalesce(place, 0) as place from h left join s on h.doc_id = s.doc_id), f as (select query_id, doc_id, min((rank, place)) as first_at from r group by 1, 2) select query_id, doc_id, (row_number() over (partition by query_id order by first_at, doc_id))::int as rank from f")
def resolve_derivatives(spark, d):
    h = view(spark, d, "hits")
    s = h.where("doc_id % 5 = 0").select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("place"))
    return S.resolve_derivatives(h.where("variant = 'v0'").select("query_id", "doc_id", "rank"), s.withColumn("source_id", (F.col("doc_id") * 7 + F.col("place")) % 100))


_Q6 = r"""with q as (select item_id as query_id, lower(array_to_string(regexp_split_to_array(text, ' ')[1:6], ' ')) as text from benchmark),
s as (select word, word || 'x' || p as synonym, p as place from (select distinct unnest(regexp_split_to_array(text, '[^a-z0-9]+')) as word from q where query_id % 2 = 0), (select unnest([1, 2, 3]) as p) where len(word) > 4 and p <= 2),
w as (select query_id, text, unnest(list_distinct(regexp_split_to_array(text, '[^a-z0-9]+'))) as word from q),
v as (select query_id, array_to_string(list_transform(regexp_split_to_array(text, '[^a-z0-9]+'), lambda x: case when x = w.word then s.synonym else x end), ' ') as variant, 1 as made from w join s on w.word = s.word union all select query_id, text, 0 from q),
b as (select query_id, array_to_string(list_sort(regexp_split_to_array(variant, '[^a-z0-9]+')), ' ') as bag, min((made, variant)) as m from v group by 1, 2),
r as (select query_id, m[1] as made, m[2] as variant from b),
n as (select query_id, (row_number() over (partition by query_id order by made, variant))::int as place, variant from r)
select * from n where place <= 7"""


@query(_Q6)
def expand_queries(spark, d):
    b = spark.read.parquet(f"{d}/benchmark.parquet")
    q = b.select(F.col("item_id").alias("query_id"), F.lower(F.array_join(F.slice(F.split("text", " "), 1, 6), " ")).alias("text"))
    words = q.where("query_id % 2 = 0").select(F.explode(F.split("text", "[^a-z0-9]+")).alias("word")).distinct().where("length(word) > 4")
    syn = words.select("word", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("place")).withColumn("synonym", F.concat("word", F.lit("x"), "place"))
    return S.expand_queries(q, syn)


@query(H + ", h as (select query_id, doc_id, least(1.0::double, score * case when doc_id % 4 = 0 then 1.5::double else 1 end) as s, 300 + doc_id * 9 as chars from hits where variant = 'v0' and score >= 0.35::double), t as (select *, max(s) over (partition by query_id) as top from h), r as (select *, row_number() over (partition by query_id order by s desc, doc_id) as rank, ceil(chars / 4.0::double)::bigint as tokens from t where s >= 0.7::double * top), c as (select *, sum(tokens) over (partition by query_id order by rank) as so_far from r where rank <= 5) select query_id, doc_id, rank::int as rank, tokens from c where so_far <= 500 or rank = 1")
def contextual_recall(spark, d):
    h = view(spark, d, "hits").where("variant = 'v0'")
    return S.contextual_recall(h.select("query_id", "doc_id", "score", (F.col("doc_id") % 4 == 0).alias("delegated"), (300 + F.col("doc_id") * 9).alias("chars")))


@query(M + """, top as (select user_id, memory_id as item, 10 + (memory_id * 7) % 90 as tokens, row_number() over (partition by user_id order by effective desc, memory_id) as place from memories)
select user_id, item from (with recursive f as (select user_id, 0::bigint as place, 0::bigint as item, 600::bigint as left_over, true as taken from (select distinct user_id from top)
union all select t.user_id, t.place, t.item, case when t.tokens <= f.left_over then f.left_over - t.tokens else f.left_over end, t.tokens <= f.left_over from f join top t on t.user_id = f.user_id and t.place = f.place + 1)
select * from f where place > 0 and taken)""")
def context_first_fit(spark, d):
    m = view(spark, d, "memories").select("user_id", F.col("memory_id").alias("item"), (10 + (F.col("memory_id") * 7) % 90).alias("tokens"), (-F.col("effective")).alias("place"))
    return S.bounded_first_fit(m, ["user_id"], 600).select("user_id", "item")


_LIVE_ROW = "m.deleted_at is null and m.superseded_by is null and m.searchable and not m.user_hidden"


@query(M + """, asked as (select user_id, min(project_id) as asked from memories group by 1),
c as (select m.user_id, layer, memory_id, ceil(length(coalesce(raw, '')) / 4.0::double)::bigint as tokens, case layer when 'IDENTITY' then 800 when 'PROJECT' then 600 else 400 end as room, case when safety_critical or (priority = 1 and layer <> 'IDENTITY') then 0 when priority = 1 then 1 else 2 end as phase, effective, confidence, priority, user_pinned, created_at from memories m join asked using (user_id)
 where deleted_at is null and superseded_by is null and searchable and not user_hidden and (layer = 'IDENTITY' or (layer = 'PROJECT' and project_id = asked) or (layer = 'SESSION' and created_at >= timestamp '""" + NOW + """' - interval 7 day))),
o as (select *, row_number() over (partition by user_id, layer order by phase, effective desc, confidence desc, priority, user_pinned desc, created_at desc, memory_id) as n from c),
f as (with recursive r as (select user_id, layer, 0::bigint as n, 0::bigint as memory_id, 0::bigint as used, 0::bigint as held, true as kept from (select distinct user_id, layer from o)
 union all select r.user_id, r.layer, r.n + 1, o.memory_id, case when phase = 0 or (phase = 1 and r.held + tokens <= 200) or r.used + tokens <= room then r.used + tokens else r.used end, case when phase = 1 and r.held + tokens <= 200 then r.held + tokens else r.held end, phase = 0 or (phase = 1 and r.held + tokens <= 200) or r.used + tokens <= room
 from r join o on o.user_id = r.user_id and o.layer = r.layer and o.n = r.n + 1) select * from r where n > 0)
select o.user_id, o.memory_id, o.layer, tokens, kept, case when not kept then lower(o.layer) || '_budget' end as reason from o join f using (memory_id)
union all select user_id, memory_id, 'AGENT', ceil(length(coalesce(raw, '')) / 4.0::double)::bigint, true, null from (select a.user_id, m.memory_id, m.raw, row_number() over (partition by a.user_id order by m.effective desc, m.priority, m.created_at desc, m.memory_id) as r
from (select user_id, min(agent_id) as agent_id from memories group by 1) a join memories m on m.agent_id = a.agent_id where m.memory_id % 3 = 0 and """ + _LIVE_ROW + ") where r <= 20")
def load_context(spark, d):
    # the given texts have no subject; every third is an agent's
    m = view(spark, d, "memories").withColumn("subject_type", F.when(F.col("memory_id") % 3 == 0, "AGENT").otherwise("USER"))
    return S.load_context(m, m.groupBy("user_id").agg(F.min("project_id").alias("project_id"), F.min("agent_id").alias("agent_id")), NOW)


def _fit(name: str, source: str, order: str, room: str) -> str:
    """SQL of a first fit of the rows of `source` in `order` within `room` tokens of their user."""
    return (
        f"{name}_o as (select *, {room} as room, row_number() over (partition by user_id order by {order}, memory_id) as n from {source}), {name} as (with recursive r as (select user_id, 0::bigint as n, 0::bigint as memory_id, 0::bigint as used, true as kept from (select distinct user_id from {name}_o)"
        f" union all select r.user_id, r.n + 1, o.memory_id, case when r.used + tokens <= room then r.used + tokens else r.used end, r.used + tokens <= room from r join {name}_o o on o.user_id = r.user_id and o.n = r.n + 1) select memory_id from r where n > 0 and kept)"
    )


@query(
    M + f", s as (select user_id, memory_id, layer, memory_type, safety_critical, created_at, ceil(length(coalesce(raw, '')) / 4.0::double)::bigint as tokens, round((0.4::double * importance + 0.3::double * effective + 0.2::double * exp(-{_AGE} / 30) + 0.1::double * least(1.0::double, ln(1.0::double + retrieval_count) / 10)) * case when memory_type in ('CONSTRAINT', 'LESSON') then 1.5::double else 1 end, 6) as score from memories where {_LIVE}),"
    " sp as (select user_id, sum(tokens)::bigint as spent from s where safety_critical group by 1), l as (select s.*, coalesce(spent, 0) as spent from s left join sp using (user_id) where memory_type in ('CONSTRAINT', 'LESSON') and not safety_critical), " + _fit("c", "l", "score desc", "1200 - spent")
    + ", s2 as (select * from s where not safety_critical and memory_id not in (select memory_id from c)), " + _fit("t", "s2", "score desc", "2000") + f", s3 as (select *, round((score + case when layer = 'IDENTITY' then 0.3::double else 0 end + case when created_at > timestamp '{NOW}' - interval 1 day then 0.2::double else 0 end) * 1000000) as late from s2 where memory_id not in (select memory_id from t)), "
    + _fit("b", "s3", "late desc", "1200") + ", k as (select memory_id, 'critical' as bucket from s where safety_critical union all select memory_id, 'critical' from c union all select memory_id, 'task' from t union all select memory_id, 'background' from b) select user_id, memory_id, bucket, tokens from k join s using (memory_id)"
)
def scoped_context(spark, d):
    m = view(spark, d, "memories").where(_LIVE)
    s = S.scoped_score(F.col("importance"), F.col("effective"), S.hours_before(NOW, F.col("created_at")) / 24, F.col("retrieval_count"), F.col("memory_type"))
    tokens = F.ceil(F.length(F.coalesce("raw", F.lit(""))) / 4.0).cast("long")
    return S.scoped_context(m.withColumns({"score": F.round(s, 6), "tokens": tokens}), NOW, 4000)


@query(M + f", s as (select memory_id, (0.4::double * importance + 0.3::double * effective + 0.2::double * exp(-{_AGE} / 30) + 0.1::double * least(1.0::double, ln(1.0::double + retrieval_count) / 10)) * case when memory_type in ('CONSTRAINT', 'LESSON') then 1.5::double else 1 end as s from memories) select memory_id, round(s, 6) as score from s")
def scoped_context_score(spark, d):
    s = S.scoped_score(F.col("importance"), F.col("effective"), S.hours_before(NOW, F.col("created_at")) / 24, F.col("retrieval_count"), F.col("memory_type"))
    return view(spark, d, "memories").select("memory_id", F.round(s, 6).alias("score"))


_ANCHOR = f"(epoch(timestamp '{NOW}' - coalesce(last_retrieved_at, created_at)) / 86400)"
_DECAY = "case layer " + " ".join(f"when '{x}' then greatest(0.1::double, 0.5::double ** ({_ANCHOR} / {h}))" for x, h in S.HALF_LIVES.items()) + " else 1 end"


@query(M + f", s as (select memory_id, safety_critical, memory_type, importance * ({_DECAY}) * (1 + 0.15::double * log2(1.0::double + used_count)) * (0.5::double + 0.5::double * confidence) + (case when {_AGE} < 7 then 0.15::double * (1 - {_AGE} / 7) else 0 end) + least(0.3::double, 0.02::double * (used_count + retrieval_count)) + (case when user_pinned then 0.5::double else 0 end) as s from memories) select memory_id, round(least(1.0::double, greatest(s, case when safety_critical then 0.6::double when memory_type = 'LESSON' then 0.7::double else 0 end)), 6) as score from s")
def effective_score(spark, d):
    return view(spark, d, "memories").select("memory_id", F.round(S.effective_score(NOW), 6).alias("score"))


@query(M + ", p as (select memory_id, layer, (case memory_id % 4 when 0 then 0 when 1 then 25 when 2 then 50 else 100 end) + (case when origin = 'CORRECTION' then 50 else 0 end) + 10 * used_count + 5 * retrieval_count as points, memory_id % 10 in (0, 9) as edge from memories) select memory_id, least(1.0::double, floor(points * (case when edge then 1.2::double else 1 end) * (case layer when 'IDENTITY' then 2.0::double when 'PROJECT' then 1.5::double when 'SESSION' then 1.0::double when 'TASK' then 0.5::double else 1.8::double end) / 300 * 100 + 0.5::double) / 100) as importance from p")
def initial_importance(spark, d):
    hint = F.element_at(F.array(*map(F.lit, S.HINT_POINTS)), (F.col("memory_id") % 4 + 1).cast("int"))
    i = S.initial_importance(hint, F.col("origin") == "CORRECTION", F.col("used_count"), F.col("retrieval_count"), (F.col("memory_id") % 10).isin(0, 9), F.col("layer"))
    return view(spark, d, "memories").select("memory_id", i.alias("importance"))


@query(C + ", e as (select k as memory_id, event_id, row_number() over (partition by k order by ts, event_id) as n, case event_type when 'view' then 1.02 when 'click' then 1.05 when 'purchase' then 1.1 when 'error' then 0.5 else 1.0 end::double as f from calls) select memory_id, round(v, 6) as importance from (with recursive r as (select memory_id, 0::bigint as n, 0.5::double as v from (select distinct memory_id from e) union all select e.memory_id, e.n, least(1.0::double, r.v * e.f) from r join e on e.memory_id = r.memory_id and e.n = r.n + 1) select memory_id, arg_max(v, n) as v from r group by 1)")
def importance_updates(spark, d):
    name = F.element_at(F.create_map(*[F.lit(x) for p in (("view", "retrieved"), ("click", "used"), ("purchase", "confirmed"), ("error", "rejected"), ("signup", "other")) for x in p]), F.col("event_type"))
    c = view(spark, d, "calls")
    return S.importance_after(c.select(F.col("k").alias("memory_id"), F.lit(0.5).alias("start"), F.struct("ts", "event_id").alias("at"), name.alias("event")))


@query(M + f" select memory_id, round((case layer " + " ".join(f"when '{x}' then exp(-{r}::double * {_AGE})" for x, r in S.DECAY_RATES.items()) + " else 1 end), 6) as factor from memories")
def layer_decay(spark, d):
    return view(spark, d, "memories").select("memory_id", F.round(S.layer_decay(F.col("layer"), S.hours_before(NOW, F.col("created_at")) / 24), 6).alias("factor"))


@query("with b as (select item_id, text, regexp_matches(lower(text), '\\b(first|earliest|originally|initially|the)\\b') as asks from benchmark) select item_id, regexp_matches(lower(text), '\\b(first|earliest|originally|initially)\\b') as first_mention from b")
def first_mention(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", S.asks_for_first(F.col("text")).alias("first_mention"))


_DIVERSE = (
    H + ", h as (select query_id, rank, doc_id, list_transform(range(0, 10), lambda i: 'w' || ((doc_id % 12) + i)) as tokens from hits where variant = 'v0' and rank <= 30), f as (with recursive r as ("
    "select query_id, 0::bigint as rank, []::varchar[][] as heads, []::bigint[] as kept, []::bigint[] as held from (select distinct query_id from h) union all"
    " select query_id, next_rank, case when old then heads else list_append(heads, tokens) end, case when old then kept else list_append(kept, doc_id) end, case when old then list_append(held, doc_id) else held end"
    " from (select r.*, h.rank::bigint as next_rank, h.doc_id, h.tokens, len(list_filter(r.heads, lambda x: len(list_intersect(x, h.tokens)) >= 0.9::double * greatest(1, len(list_distinct(list_concat(x, h.tokens)))))) > 0 as old from r join h on h.query_id = r.query_id and h.rank = r.rank + 1)"
    ") select * from r), l as (select query_id, arg_max(list_concat(kept, held), rank)[1:10] as ids from f group by 1) select query_id, generate_subscripts(ids, 1)::int as place, unnest(ids) as doc_id from l"
)


@query(_DIVERSE)
def diversify(spark, d):
    h = view(spark, d, "hits").where("variant = 'v0' and rank <= 30")
    tokens = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("w"), ((F.col("doc_id") % 12) + i).cast("string")))
    return S.diversify(h.select("query_id", "rank", "doc_id", tokens.alias("tokens")), 10)


_NAMED = "case when memory_id % 2 = 0 then concat('We are Working on ', project_id, ' now, ', raw) else raw end"


@query(M + f", t as (select user_id, lower(coalesce({_NAMED}, '')) as t from memories where layer in ('PROJECT', 'SESSION') and effective >= 0.5 and created_at >= timestamp '{NOW}' - interval 3 day), n as (select user_id, case when regexp_extract(t, '{S.PROJECT_NAME}', 1) <> '' then regexp_replace(regexp_extract(t, '{S.PROJECT_NAME}', 1), '\\s+$', '') else substring(t, 1, 50) end as name from t), c as (select user_id, name, count(*) as n from n group by 1, 2) select user_id, name as project from (select *, row_number() over (partition by user_id order by n desc, name) as r from c) where r = 1 and name <> ''")
def current_projects(spark, d):
    m = view(spark, d, "memories").withColumn("raw", F.expr(_NAMED)).withColumn("layer", F.when(F.col("layer") == "SESSION", "PROJECT").otherwise(F.col("layer")))
    return S.current_projects(m, NOW, 3)


@query(None)
def context_sections(spark, d):
    from loomwork.operators.dedup import text_near_dup, word_set_members

    m = view(spark, d, "memories")
    accesses = view(spark, d, "calls").select(F.col("k").alias("memory_id"), "ts")
    # pairs of rows that are left out anyway are not sought
    words = S.context_rows(m, accesses, NOW).select("user_id", "memory_id", F.split(F.lower("raw"), r"\W+").alias("words"))
    return S.context_sections(m, accesses, text_near_dup(words), NOW, 2000, members=word_set_members(words))
