"""Queries of loomwork.operators.graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import graphs as G
from loomwork.plans.deduping import PAIRS, near_pairs
from loomwork.plans.registry import query
from loomwork.sources.views import view, view_sql

E, M, V, C = view_sql("edges"), view_sql("memories"), view_sql("vectors"), view_sql("calls")
_ME = ", ment as (select agent_id || '-' || (memory_id % 6) as entity, memory_id, importance, effective, created_at, memory_id % 100 as days from memories), ed as (select distinct 'agent' || (memory_id % 8) || '-' || (memory_id % 6) as source_id, 'agent' || (memory_id * 3 % 8) || '-' || (memory_id * 5 % 6) as target_id, cast(1 + memory_id % 9 as double) / 10 as weight from memories where memory_id % 8 <> memory_id * 3 % 8)"


def _mentions(spark, d):
    return view(spark, d, "memories").select(F.concat("agent_id", F.lit("-"), F.col("memory_id") % 6).alias("entity"), "memory_id", "importance", "effective", "created_at", (F.col("memory_id") % 100).alias("days"))


def _edges(spark, d):
    m = view(spark, d, "memories").where("memory_id % 8 <> memory_id * 3 % 8")
    name = lambda a, b: F.concat(F.lit("agent"), a % 8, F.lit("-"), b % 6)
    i = F.col("memory_id")
    return m.select(name(i, i).alias("source_id"), name(i * 3, i * 5).alias("target_id"), ((1 + i % 9).cast("double") / 10).alias("weight")).distinct()


_BFS = ", s as (select distinct source_id as node from edges), r as (with recursive w(start_id, node, depth) as (select node, node, 0 from s union select w.start_id, e.target_id, depth + 1 from w join {0} e on e.source_id = w.node where depth < {1}) select * from w)"


@query(E + _BFS.format("edges", 2) + " select start_id, node, min(depth)::int as depth from r where node <> start_id group by 1, 2")
def traverse(spark, d):
    e = view(spark, d, "edges")
    return G.traverse(e.select(F.col("source_id").alias("node")), e, 2)


@query(E + ", both_ways as (select source_id, target_id from edges union select target_id, source_id from edges)" + _BFS.format("both_ways", 2) + " select start_id, node, min(depth)::int as depth from r where node <> start_id group by 1, 2")
def find_related(spark, d):
    e = view(spark, d, "edges").select("source_id", "target_id")
    return G.traverse(e.select(F.col("source_id").alias("node")), G.symmetric(e), 2)


@query(E + ", p as (select distinct source_id as start_id, source_id * 7 % 50 as end_id from edges), ee as (select distinct source_id, target_id from edges), w as (with recursive w(start_id, path, node) as (select start_id, [start_id], start_id from (select distinct start_id from p) union all select w.start_id, list_append(w.path, e.target_id), e.target_id from w join ee e on e.source_id = w.node where len(w.path) < 3 and not list_contains(w.path, e.target_id)) select * from w), b as (select p.start_id, p.end_id, min((len(w.path), w.path)) as m from p join w on w.start_id = p.start_id and w.node = p.end_id group by 1, 2) select start_id, end_id, (m[1] - 1)::int as hops, m[2] as path from b")
def shortest_path(spark, d):
    e = view(spark, d, "edges")
    pairs = e.select(F.col("source_id").alias("start_id"), (F.col("source_id") * 7 % 50).alias("end_id")).distinct()
    return G.shortest_paths(pairs, e, 2)


@query(M + _ME + ", t as (select *, row_number() over (partition by entity order by importance desc, created_at desc, memory_id) as r from ment), p as (select a.memory_id as low_id, b.memory_id as high_id from t a join t b on a.entity = b.entity and a.memory_id < b.memory_id where a.r <= 10 and b.r <= 10) select low_id, high_id, count(*) as shared, round(0.5::double + least(0.4::double, 0.05::double * count(*)), 6) as confidence from p group by 1, 2")
def shared_entity_edges(spark, d):
    return G.shared_entity_edges(_mentions(spark, d))


@query(E + " select source_id, target_id, edge_type from edges")
def graph_export(spark, d):
    e = view(spark, d, "edges")
    nodes = e.select(F.col("source_id").alias("node")).unionAll(e.select("target_id")).distinct()
    return G.restrict_edges(e, nodes).select("source_id", "target_id", "edge_type")


_NAMES = "names as (select distinct doc_id % 50 as profile_id, regexp_replace(array_to_string(regexp_split_to_array(lower(text), '[^a-z0-9]+')[2:3 + doc_id % 3], ' '), '^ +| +$', '', 'g') as key from documents)"


@query("with " + _NAMES + r", k as (select * from names where regexp_matches(key, '^[a-z0-9]+( [a-z0-9]+)+$')), t as (select doc_id as memory_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''), ' ') || ' ' as t from documents) select memory_id, profile_id, 0.9::double as confidence from t join k on contains(t.t, ' ' || key || ' ') group by all")
def mention_detect(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet")
    key = F.regexp_replace(F.array_join(F.slice(F.split(F.lower("text"), "[^a-z0-9]+"), F.lit(2), (F.col("doc_id") % 3 + 2).cast("int")), " "), "^ +| +$", "")
    names = t.select((F.col("doc_id") % 50).alias("profile_id"), key.alias("name"), F.lit(0.9).alias("confidence")).distinct()
    return G.mention_detect(t.select(F.col("doc_id").alias("memory_id"), F.col("text").alias("raw")), names.where(F.col("name").rlike("^[a-z0-9]+( [a-z0-9]+)+$")))


@query(M + ", me as (select memory_id, memory_id % 10 as p, confidence as s from memories where memory_id % 3 <> 0), ne as (select memory_id, memory_id % 10 as p, effective as s from memories), u as (select memory_id, p, 0 as o, s from me union all select memory_id, p, 1, s from ne), f as (select * from u where s >= 0.75 and memory_id % 7 <> 0), b as (select memory_id, p, min((o, -s)) as m from f group by 1, 2) select memory_id, p as profile_id, case when m[1] = 0 then 'mention' else 'vector' end as method, -m[2] as score from b")
def attach_profiles(spark, d):
    m = view(spark, d, "memories").withColumn("profile_id", F.col("memory_id") % 10)
    mentions = m.where("memory_id % 3 <> 0").select("memory_id", "profile_id", "confidence")
    return G.attach_profiles(mentions, m.select("memory_id", "profile_id", F.col("effective").alias("similarity")), m.where("memory_id % 7 = 0").select("memory_id", "profile_id"))


_ENT = ", en as (select distinct 'Ann Lee' || (memory_id % 40) as name, case when memory_id % 2 = 0 then 'person' else 'organization' end as kind, memory_id % 40 as id from memories where memory_id % 3 = 0), mn as (select distinct case memory_id % 4 when 0 then 'Ann Lee' || (memory_id % 40) when 1 then 'AL' || (memory_id % 40) when 2 then 'Ann Lex' || (memory_id % 40) else 'Bob' || (memory_id % 40) end as name, case when memory_id % 2 = 0 then 'person' else 'organization' end as kind from memories)"


@query(M + _ENT + ", c as (select mn.name, mn.kind, en.id, 0 as tier from mn join en on en.name = mn.name and en.kind = mn.kind union all select mn.name, mn.kind, en.id, 1 from mn join en on 'AL' || en.id = mn.name and en.kind = mn.kind union all select mn.name, mn.kind, en.id, 2 from mn join en on split_part(en.name, ' ', 1) = split_part(mn.name, ' ', 1) and en.kind = mn.kind and levenshtein(en.name, mn.name) <= 2 and length(split_part(mn.name, ' ', 1)) > 2), b as (select name, kind, min((tier, id)) as m from c group by 1, 2) select mn.name, mn.kind, m[2] as entity_id, coalesce(['exact', 'alias', 'similar'][m[1] + 1], 'new') as how from mn left join b on b.name = mn.name and b.kind = mn.kind")
def resolve_entities(spark, d):
    m = view(spark, d, "memories")
    i, kind = F.col("memory_id") % 40, F.when(F.col("memory_id") % 2 == 0, "person").otherwise("organization")
    # a role, not a sample: the entities that are known already
    ent = m.where("memory_id % 3 = 0").select(i.alias("entity_id"), F.concat(F.lit("Ann Lee"), i).alias("entity_name"), kind.alias("kind"), F.array(F.concat(F.lit("AL"), i)).alias("aliases")).distinct()
    stem = F.element_at(F.array(*map(F.lit, ("Ann Lee", "AL", "Ann Lex", "Bob"))), (F.col("memory_id") % 4 + 1).cast("int"))
    return G.resolve_entities(m.select(F.concat(stem, i).alias("name"), kind.alias("kind")), ent)


@query(C + ", s as (select user_id % 20 as a, k % 20 as b, case when event_type = 'view' then 'KNOWS' else 'USES' end as t, (ts, event_id) as seen_at, cast(k as double) / 100 as w from calls where user_id % 20 <> k % 20), u as (select * from s union all select b, a, t, seen_at, w from s where t = 'KNOWS'), r as (select *, row_number() over (partition by a, b, t order by seen_at desc, w desc) as late, count(*) over (partition by a, b, t) as n from u) select a as source_id, b as target_id, t as edge_type, round(sum(w * 0.8::double ** (late - 1) * case when late = n then 1 else 0.2::double end), 6) as weight, count(*) as n from r group by 1, 2, 3")
def upsert_relationships(spark, d):
    c = view(spark, d, "calls")
    seen = c.select((F.col("user_id") % 20).alias("source_id"), (F.col("k") % 20).alias("target_id"), F.when(F.col("event_type") == "view", "KNOWS").otherwise("USES").alias("edge_type"), F.struct("ts", "event_id").alias("at"), (F.col("k").cast("double") / 100).alias("weight"))
    return G.upsert_relationships(seen, ["KNOWS"])


@query(M + _ME + ", s as (select source_id, target_id from ed union all select target_id, source_id from ed), r as (select source_id as entity, count(distinct target_id) as relations from s group by 1), n as (select entity, count(*) as mentions from ment group by 1) select coalesce(n.entity, r.entity) as entity, coalesce(mentions, 0) as mentions, coalesce(relations, 0) as relations from n full join r on n.entity = r.entity")
def entity_stats(spark, d):
    return G.entity_stats(_edges(spark, d), _mentions(spark, d))


_QE = ", qe as (select memory_id as query_id, 'agent' || (memory_id % 8) || '-' || (memory_id % 6) as entity from memories where memory_id % 20 = 1)"


def _asked(spark, d):
    return view(spark, d, "memories").where("memory_id % 20 = 1").select(F.col("memory_id").alias("query_id"), F.concat("agent_id", F.lit("-"), F.col("memory_id") % 6).alias("entity"))


@query(M + _ME + _QE + ", s as (select distinct source_id, target_id from (select source_id, target_id from ed union all select target_id, source_id from ed)), b as (select query_id, entity from qe union select query_id, target_id from qe join s on s.source_id = entity), h as (select query_id, memory_id, count(*) as hits from b join (select distinct entity, memory_id from ment) using (entity) group by 1, 2), r as (select query_id, memory_id, round(least(1.0::double, 0.7::double + 0.1::double * (hits - 1)), 6) as score from h) select query_id, memory_id, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, memory_id) as rank from r) where rank <= 10")
def graph_recall(spark, d):
    return G.graph_recall(_asked(spark, d), _edges(spark, d), _mentions(spark, d))


@query(M + _ME + _QE + ", n as (select query_id, target_id as near, max(weight) as w from qe join ed on ed.source_id = entity group by 1, 2), s as (select query_id, near, memory_id, round(w * effective * greatest(0.1::double, 1 - days / 90), 6) as salience from n join ment on ment.entity = near), b as (select *, row_number() over (partition by query_id, near order by salience desc, memory_id) as r from s where salience >= 0.3), g as (select query_id, memory_id, max(salience) as salience from b where r = 1 group by 1, 2) select query_id, memory_id, salience from (select *, row_number() over (partition by query_id order by salience desc, memory_id) as r from g) where r <= 3")
def radiate(spark, d):
    return G.radiate(_asked(spark, d), _edges(spark, d), _mentions(spark, d))


_SIM = PAIRS + ", sim as (select left_id as source_id, right_id as target_id, similarity from near union all select right_id, left_id, similarity from near)"
_LINKS = ", links as (select source_id, target_id, similarity from (select *, row_number() over (partition by source_id order by similarity desc, target_id) as r from sim where similarity >= 0.36 and similarity < 0.5) where r <= 2)"


def _similar(spark, d):
    p = near_pairs(spark, d).select(F.col("left_id").alias("source_id"), F.col("right_id").alias("target_id"), "similarity")
    return p.unionAll(p.select(F.col("target_id"), F.col("source_id"), "similarity"))


@query(V + _SIM + _LINKS + " select * from links")
def related_links(spark, d):
    return G.related_links(_similar(spark, d), 0.36, 0.5, 2)


@query(V + _SIM + ", l as (select * from sim where source_id % 2 = 0), n as (select source_id as node, count(*) as near from sim where similarity >= 0.35 and similarity < 0.45 group by 1) select node, near from n where node not in (select source_id from l union select target_id from l)")
def link_audit(spark, d):
    s = _similar(spark, d)
    return G.unlinked(view(spark, d, "vectors").select(F.col("vec_id").alias("node")), s.where("source_id % 2 = 0"), s, 0.35, 0.45)


@query(E + ", o as (select source_id as node, list_sort(list(distinct target_id)) as outgoing from edges group by 1), i as (select target_id as node, list_sort(list(distinct source_id)) as incoming from edges group by 1) select coalesce(o.node, i.node) as node, coalesce(outgoing, []) as outgoing, coalesce(incoming, []) as incoming from o full join i on o.node = i.node")
def attach_chains(spark, d):
    return G.attach_chains(view(spark, d, "edges"))


@query(M + _ENT + ", q as (select memory_id as query_id, case memory_id % 3 when 0 then 'ann lee' || (memory_id % 40) when 1 then 'al' || (memory_id % 40) else 'maker' end as key from memories where memory_id % 20 < 3), h as (select query_id, id, 0 as tier from q join en on lower(en.name) = key union all select query_id, id, 1 from q join en on 'al' || id = key union all select query_id, id, 2 from q join en on key in ('the', 'maker', 'of', 'n' || id)), b as (select query_id, id, min(tier) as tier from h group by 1, 2) select query_id, id as entity_id, ['exact', 'alias', 'description'][tier + 1] as how from (select *, row_number() over (partition by query_id order by tier, id) as r from b) where r <= 10")
def entity_search(spark, d):
    m = view(spark, d, "memories")
    i = F.col("memory_id") % 40
    # a role, not a sample: the entities that are known already
    ent = m.where("memory_id % 3 = 0").select(i.alias("entity_id"), F.concat(F.lit("Ann Lee"), i).alias("entity_name"), F.array(F.concat(F.lit("AL"), i)).alias("aliases"), F.concat(F.lit("The maker of N"), i).alias("description")).distinct()
    text = F.when(F.col("memory_id") % 3 == 0, F.concat(F.lit("Ann Lee"), i)).when(F.col("memory_id") % 3 == 1, F.concat(F.lit("AL"), i)).otherwise(F.lit("maker"))
    return G.entity_search(m.where("memory_id % 20 < 3").select(F.col("memory_id").alias("query_id"), text.alias("text")), ent)


@query(M + ", q as (select memory_id as query_id, memory_id % 15 as p from memories where memory_id % 20 = 0), a as (select memory_id % 15 as p, memory_id, importance, confidence as relevance from memories where memory_id % 2 = 0), l as (select memory_id % 15 as p, memory_id, importance from memories where memory_id % 3 = 0), u as (select query_id, memory_id, importance, relevance, 0 as o from q join a using (p) union all select query_id, memory_id, importance, 0.7::double, 1 from q join l using (p)), b as (select query_id, memory_id, importance, arg_min(relevance, (o, -relevance)) as relevance from u group by 1, 2, 3) select query_id, memory_id, relevance, rank::int as rank from (select *, row_number() over (partition by query_id order by importance desc, memory_id) as rank from b) where rank <= 10")
def profile_recall(spark, d):
    m = view(spark, d, "memories").withColumn("profile_id", F.col("memory_id") % 15)
    asked = m.where("memory_id % 20 = 0").select(F.col("memory_id").alias("query_id"), "profile_id")
    return G.profile_recall(asked, m.where("memory_id % 2 = 0").withColumn("relevance", F.col("confidence")), m.where("memory_id % 3 = 0"))


@query(E + " select edge_type, count(*) as n, count(distinct source_id) as sources, count(*) filter (source_id < target_id) as rising from edges group by 1")
def edge_type_counts(spark, d):
    return G.edge_type_counts(view(spark, d, "edges"))


@query("""with n as (select item_id, regexp_extract_all(text, '"([^"]+)"', 1) || regexp_extract_all(text, '([A-Z][a-z]+)''s', 1) || regexp_extract_all(text, '[a-z,;] ([A-Z][a-z]+)', 1) as a from benchmark), u as (select item_id, list_filter(a, lambda x, i: list_position(a, x) = i) as a from n) select item_id, a[1:5] as names from u""")
def names_in_query(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", G.names_in_query(F.col("text")).alias("names"))
