"""Queries of loomwork.operators.lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import lifecycle as L
from loomwork.operators.analytics import count_if
from loomwork.plans.deduping import LEAST, PAIRS, near_pairs
from loomwork.plans.registry import query
from loomwork.session import written
from loomwork.sources.views import NOW, view, view_sql

M, V = view_sql("memories"), view_sql("vectors")
EPS = 0.3
_LINK = PAIRS.replace(f">= {LEAST}", f">= {EPS}") + ", nb as (select left_id as a, right_id as b from near union all select right_id, left_id from near)"
_DB = _LINK + """, core as (select a from nb group by a having count(*) >= 3), ce as (select nb.a, nb.b from nb join core c on c.a = nb.a join core d on d.a = nb.b),
reach as (select node, min(other) as cluster from (with recursive r(node, other) as (select a, a from core union select r.node, ce.b from r join ce on ce.a = r.other) select * from r) group by node),
border as (select nb.a, min(cluster) as cluster from nb join reach on reach.node = nb.b where nb.a not in (select a from core) group by 1),
scan as (select v.vec_id as id, coalesce(r.cluster, b.cluster) as cluster, case when r.cluster is not null then 'core' when b.cluster is not null then 'border' else 'noise' end as role from vectors v left join reach r on r.node = v.vec_id left join border b on b.a = v.vec_id)"""


def links(spark, d, least=EPS):
    p = written(near_pairs(spark, d, least), "pairs")
    return p.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))


def scanned(spark, d):
    p = links(spark, d)
    return L.dbscan(p.unionAll(p.select(F.col("b").alias("a"), F.col("a").alias("b"))), view(spark, d, "vectors").select(F.col("vec_id").alias("id")))


@query(V + _DB + " select * from scan")
def dbscan(spark, d):
    return scanned(spark, d)


@query(V + _DB + ", m as (select cluster, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from scan join vectors on vec_id = id where cluster is not null), a as (select cluster, i, round(avg(x::double), 5) as x from m group by 1, 2), c as (select cluster, list(x order by i) as centroid from a group by 1) select cluster, (select count(*) from scan s where s.cluster = c.cluster) as size, centroid from c")
def cluster_centroids(spark, d):
    rows = scanned(spark, d).where("cluster is not null").join(view(spark, d, "vectors").select(F.col("vec_id").alias("id"), "embedding"), "id")
    return L.cluster_centroids(rows)


@query(M + ", w as (select user_id as cluster, unnest(regexp_split_to_array(lower(raw), '[^a-z0-9]+')) as w from memories), c as (select cluster, w, count(*) as c from w where length(w) > 3 group by 1, 2), r as (select *, row_number() over (partition by cluster order by c desc, w) as r from c) select cluster, string_agg(w, ', ' order by r) as label from r where r <= 3 group by cluster")
def cluster_labels(spark, d):
    return L.cluster_labels(view(spark, d, "memories").select(F.col("user_id").alias("cluster"), "raw"))


_GROUPS = (
    V + _LINK + ", nbl as (select a, list(b) as nbs from nb group by a), o as (select vec_id as id, user_id, row_number() over (partition by user_id order by vec_id) as n, coalesce(nbs, []) as nbs from vectors left join nbl on a = vec_id),"
    " groups as (with recursive r as (select user_id, 0::bigint as n, []::bigint[] as gone, null::bigint as leader, []::bigint[] as members from (select distinct user_id from o)"
    " union all select user_id, n, case when free is null then gone when len(free) >= 2 then list_concat(list_append(gone, id), free) else list_append(gone, id) end, case when len(free) >= 2 then id end, coalesce(free, []) from (select o.user_id, o.n, o.id, r.gone, case when list_contains(r.gone, o.id) then null else list_filter(o.nbs, lambda x: not list_contains(r.gone, x)) end as free from r join o on o.user_id = r.user_id and o.n = r.n + 1))"
    " select leader, unnest(list_append(members, leader)) as id from r where leader is not null)"
)


@query(_GROUPS + " select leader, id from groups")
def cold_clusters(spark, d):
    v = view(spark, d, "vectors")
    return L.leader_groups(links(spark, d), v.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("place")), 3)


@query(_GROUPS + ", r as (select leader, g.id, importance, count(*) over (partition by leader) as size, row_number() over (partition by leader order by length(user_id::varchar) desc, importance desc, created_at desc, g.id) as r from groups g join vectors v on v.vec_id = g.id) select leader, id as canonical, size, round(least(1.0::double, importance + 0.2::double), 6) as importance from r where r = 1")
def recurring_patterns(spark, d):
    v = view(spark, d, "vectors")
    groups = L.leader_groups(links(spark, d), v.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("place")), 3)
    return L.recurring_patterns(groups, v.select(F.col("vec_id").alias("id"), F.col("user_id").cast("string").alias("raw"), "importance", "created_at"))


@query(_GROUPS + ", k as (select leader, count(*) as size from groups group by 1 having count(*) filter (id % 50 = 0) = 0) select leader, size, round(least(0.9::double, 0.5::double + 0.05::double * size), 6) as score from k where size >= 3")
def pattern_candidates(spark, d):
    v = view(spark, d, "vectors")
    groups = L.leader_groups(links(spark, d), v.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("place")), 3)
    # a role, not a sample: rows that a known pattern came from
    return L.pattern_candidates(groups, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("source_id")))


_AGO = f"(epoch(timestamp '{NOW}' - {{}}) / 86400)"
_USED, _MADE = _AGO.format("last_retrieved_at"), _AGO.format("created_at")
_TIER = f"case when user_pinned or coalesce({_USED} <= 7, false) or {_MADE} <= 2 then 'HOT' when coalesce({_USED} <= 30, false) or retrieval_count >= 3 then 'WARM' when coalesce({_USED} > 30, true) and retrieval_count < 3 and {_MADE} > 90 then 'COLD' else 'WARM' end"


@query(M + f" select memory_id, {_TIER} as tier from memories")
def tiering(spark, d):
    return view(spark, d, "memories").select("memory_id", L.tier(NOW).alias("tier"))


@query(M + f", t as (select user_id, case {_TIER} when 'HOT' then 2 when 'WARM' then 1 else 0 end - memory_id % 3 as up from memories) select user_id, count(*) filter (up > 0) as promoted, count(*) filter (up < 0) as demoted, count(*) filter (up = 0) as unchanged from t group by 1")
def tier_changes(spark, d):
    before = F.element_at(F.array(*map(F.lit, ("COLD", "WARM", "HOT"))), (F.col("memory_id") % 3 + 1).cast("int"))
    return L.tier_changes(view(spark, d, "memories").withColumns({"tier_before": before, "tier_after": L.tier(NOW)}))


_RE = f"""least(1.0::double, greatest(case when searchable then 0.35::double else 0 end, importance * (case when last_retrieved_at is null then 0.5::double else greatest(0.3::double, exp(-0.05::double * {_USED})) end) * (1 + 0.3::double * log10(greatest(1, used_count)::double))
* (case when retrieval_count = 0 then greatest(0.2::double, exp(-0.02::double * {_MADE})) else 1 end) * (case layer when 'IDENTITY' then 1.5::double when 'PROJECT' then 1.3::double when 'INSIGHT' then 1.2::double when 'SESSION' then 1.0::double else 0.8::double end)))"""


@query(M + f", s as (select memory_id, effective, {_RE} as s from memories) select memory_id, round(case when abs(s - effective) < 0.001::double then effective else s end, 6) as score from s")
def rescore(spark, d):
    return view(spark, d, "memories").select("memory_id", F.round(L.rescore(NOW), 6).alias("score"))


@query(M + f" select layer, memory_type, count(*) as n from memories where effective < 0.5 and {_MADE} > 10 and coalesce({_USED} > 5, true) and coalesce({_AGO.format('last_used_at')} > 5, true) and used_count <= 5 and not user_pinned and layer not in ('IDENTITY', 'PROJECT') group by 1, 2")
def archival_candidates(spark, d):
    return L.archival_candidates(view(spark, d, "memories"), NOW, 0.5, 10, 5).groupBy("layer", "memory_type").agg(F.count("*").alias("n"))


@query(M + ", c as (select user_id, count(*) filter (searchable and not user_hidden and memory_id % 8 <> 0) as touched, count(*) as total from memories group by 1) select *, total < 10 or touched >= floor(total * 0.9::double) as passed from c")
def sanity_gate(spark, d):
    done = F.col("searchable") & ~F.col("user_hidden") & (F.col("memory_id") % 8 != 0)
    return L.sanity_gate(view(spark, d, "memories").groupBy("user_id").agg(count_if(done).alias("touched"), F.count("*").alias("total")))


@query(M + ", r as (select case when n.memory_id is null then 'missing' when n.user_id <> o.user_id then 'wrong owner' when n.user_hidden or not n.searchable then 'hidden' when n.embedding_status <> 'DONE' then 'no vector' else 'ok' end as problem from memories o left join memories n on n.memory_id = o.consolidated_into where o.consolidated_into is not null) select problem, count(*) as n from r group by 1")
def consolidation_audit(spark, d):
    return L.consolidation_audit(view(spark, d, "memories"))


@query(M + " select memory_id, session_id, effective from memories where session_id % 3 = 0 and effective >= 0.7 and memory_id not in (select memory_id from memories where agent_id = 'agent1')")
def promote_pool(spark, d):
    m = view(spark, d, "memories")
    return L.promote_pool(m.where("session_id % 3 = 0"), m.where("agent_id = 'agent1'")).select("memory_id", "session_id", "effective")


@query(M + ", c as (select memory_id as correction_id, memory_id - 2 as original_id from memories where origin = 'CORRECTION'), r as (select correction_id, original_id, case when o.memory_id is null then 'missing' when o.deleted_at is not null then 'deleted' when o.superseded_by is not null then 'superseded' else 'applied' end as status, o.importance as i from c left join memories o on o.memory_id = original_id) select correction_id, original_id, status, case when status = 'applied' then round(least(1.0::double, i + 0.1::double), 6) end as importance from r")
def apply_corrections(spark, d):
    m = view(spark, d, "memories")
    return L.apply_corrections(m, m.where("origin = 'CORRECTION'").select(F.col("memory_id").alias("correction_id"), (F.col("memory_id") - 2).alias("original_id")))


@query(M + ", m as (select distinct user_id, 'entity:' || regexp_replace(lower(trim('Ann Lee ' || agent_id)), '[^a-z0-9]+', '-', 'g') as tag from memories where memory_id % 3 <> 2), e as (select distinct user_id, 'entity:ann-lee-agent' || memory_id % 4 as tag from memories where memory_id % 5 = 0) select * from m except select * from e")
def entity_anchors(spark, d):
    m = view(spark, d, "memories")
    kind = F.element_at(F.array(*map(F.lit, ("person", "organization", "place"))), (F.col("memory_id") % 3 + 1).cast("int"))
    mentions = m.select("user_id", F.concat(F.lit("Ann Lee "), "agent_id").alias("name"), kind.alias("kind"))
    have = m.where("memory_id % 5 = 0").select("user_id", F.array(F.concat(F.lit("entity:ann-lee-agent"), F.col("memory_id") % 4)).alias("tags"))
    return L.entity_anchors(mentions, have)
