"""Queries of loomwork.operators.ingesting and loomwork.operators.predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import ingesting as I
from loomwork.operators import predicates as P
from loomwork.plans.registry import query
from loomwork.sources.views import view, view_sql

M, C, V, E = view_sql("memories"), view_sql("calls"), view_sql("vectors"), view_sql("edges")
SURVIVOR = "deleted_at is null and superseded_by is null and is_duplicate_of is null and searchable and not user_hidden and embedding_status <> 'DUPLICATE'"


def docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


@query(M + f" select memory_id, user_id from memories where {SURVIVOR}")
def survivors(spark, d):
    return P.survivors(view(spark, d, "memories")).select("memory_id", "user_id")


@query(M + " select memory_id from memories where layer in ('SESSION', 'TASK') and project_id = 'p1' and agent_id = 'agent5'")
def scope_filter(spark, d):
    return view(spark, d, "memories").where(P.scope_filter(["SESSION", "TASK"], project="p1", agent="agent5")).select("memory_id")


_SHARED = ", s as (select *, ['PRIVATE', 'TEAM', 'PUBLIC'][(memory_id % 3) + 1] as visibility, ['USER', 'AGENT', 'ENTITY'][(memory_id % 7) % 3 + 1] as subject_type, case when memory_id % 4 <> 0 then 'x' || (memory_id % 25) end as external_id, 's' || (memory_id % 30) as sid from memories)"


def shared(spark, d):
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    k = F.col("memory_id")
    external = F.when(k % 4 != 0, F.concat(F.lit("x"), k % 25))
    return view(spark, d, "memories").withColumns({"visibility": pick(("PRIVATE", "TEAM", "PUBLIC"), k % 3), "subject_type": pick(("USER", "AGENT", "ENTITY"), k % 7 % 3), "external_id": external, "session_id": F.concat(F.lit("s"), k % 30)})


@query(M + _SHARED + " select memory_id from s where visibility in ('TEAM', 'PUBLIC') and subject_type = 'AGENT'")
def scope_by_subject(spark, d):
    return shared(spark, d).where(P.scope_filter(visibility=["TEAM", "PUBLIC"], subject_type="USER", include_user=False)).select("memory_id")


@query(M + _SHARED + " select memory_id from s where (sid = 'x7' or external_id = 'x7') and subject_type = 'USER'")
def scope_by_session(spark, d):
    return shared(spark, d).where(P.scope_filter(session="x7", external_session="external_id", include_agent=False)).select("memory_id")


@query(M + " select memory_id from memories where list_has_all(tags, ['tag3', 'arc6'])")
def has_all_tags(spark, d):
    return view(spark, d, "memories").where(P.has_all_tags(["tag3", "arc6"])).select("memory_id")


@query("select event_id from events where json_extract_string(props, '$.k') = '42'")
def metadata_contains(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").where(P.metadata_contains({"k": 42})).select("event_id")


@query(M + " select memory_id from memories where coalesce(observed_at, created_at) between timestamp '2024-01-05' and timestamp '2024-01-12'")
def time_range(spark, d):
    return view(spark, d, "memories").where(P.time_range("2024-01-05", "2024-01-12", by_event_time=True)).select("memory_id")


_SUBS = [(i, ["signup", "click", "view", "error", "purchase"][i % 5], ["SESSION", "TASK"] if i % 2 else None, ["tag1", "tag4"] if i % 3 else None, i / 20 if i % 4 else None) for i in range(12)]


def _subs_sql() -> str:
    lit = lambda x: "null" if x is None else "[" + ", ".join(f"'{y}'" for y in x) + "]" if isinstance(x, list) else f"'{x}'" if isinstance(x, str) else f"{x}::double" if isinstance(x, float) else str(x)
    return "subs(subscription_id, wanted, layers, tags, least) as (values " + ", ".join("(" + ", ".join(map(lit, s)) + ")" for s in _SUBS) + ")"


@query(C + ", " + _subs_sql() + ", e as (select event_id, event_type, case when k % 3 = 0 then null when k % 3 = 1 then 'SESSION' else 'TASK' end as layer, ['tag' || (k % 6)] as ts, cast(k as double) / 100 as importance from calls) select event_id, subscription_id::int as subscription_id from e join subs on event_type = wanted where (layers is null or layer is null or list_contains(layers, layer)) and (tags is null or list_has_any(tags, ts)) and (least is null or importance >= least)")
def route_events(spark, d):
    layer = F.when(F.col("k") % 3 == 1, "SESSION").when(F.col("k") % 3 == 2, "TASK")
    e = view(spark, d, "calls").select("event_id", "event_type", layer.alias("layer"), F.array(F.concat(F.lit("tag"), F.col("k") % 6)).alias("tags"), (F.col("k").cast("double") / 100).alias("importance"))
    subs = spark.createDataFrame(_SUBS, "subscription_id int, event_type string, filter_layers array<string>, filter_tags array<string>, min_importance double")
    return P.route_events(e, subs)


@query(M + " select memory_id, sha256(lower(trim(raw))) as hash from memories")
def content_hash(spark, d):
    return view(spark, d, "memories").select("memory_id", I.content_hash(F.col("raw")).alias("hash"))


@query("select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') as html from pages")
def sanitize(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", I.sanitize(F.col("html")).alias("html"))


@query("with n as (select conv_id, turn, role, coalesce(text, '') as text, sum((role = 'user')::int) over (partition by conv_id order by turn) as round from conversations) select conv_id, round::bigint as round, min(turn) as first_turn, count(*)::int as turns, string_agg(role || ': ' || text, chr(10) order by turn) as text from n group by 1, 2")
def chunk_rounds(spark, d):
    return I.chunk_rounds(spark.read.parquet(f"{d}/conversations.parquet"))


_DATED = "'# Part ' || (doc_id % 3) || case when doc_id % 2 = 0 then ' 2024-0' || (doc_id % 9 + 1) || '-3' || (doc_id % 3) else '' end || chr(10) || replace(text, '. ', '.' || chr(10) || case when doc_id % 5 = 0 then chr(10) || '- 2023-1' || (doc_id % 4) || '-05 ' when doc_id % 5 = 1 then chr(10) || '  ## On 2024-01-15' || chr(10) else chr(10) end)"


@query(f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as line from (select doc_id, {_DATED} as text from documents)),
m as (select *, regexp_matches(text, '^ {{0,3}}#{{1,6}}[ \t]+') as h, trim(text) = '' as b from l), w as (select *, last_value(case when h then regexp_replace(text, '^ {{0,3}}#{{1,6}}[ \t]+', '') end ignore nulls) over o as heading,
last_value(case when h then line end ignore nulls) over o as heading_line, last_value(case when h then try_cast(regexp_extract(text, '\\b([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})\\b', 1) as date) end ignore nulls) over o as heading_day,
sum((h or b)::int) over o as part from m window o as (partition by doc_id order by line rows unbounded preceding)),
p as (select doc_id, min(heading) as heading, min(heading_line)::int as heading_line, min(heading_day) as heading_day, min(line)::int as first_line, max(line)::int as last_line, string_agg(text, chr(10) order by line) as text from w where not h and not b group by doc_id, part)
select * exclude (heading_day), strftime(coalesce(try_cast(regexp_extract(text, '^[ \t]*(?:[-*][ \t]*)?([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})\\b', 1) as date), heading_day, date '2024-01-01' + (doc_id % 30)::int), '%Y-%m-%d') as day from p""")
def chunk_markdown(spark, d):
    k = F.col("doc_id")
    dated = F.when(k % 2 == 0, F.concat(F.lit(" 2024-0"), k % 9 + 1, F.lit("-3"), k % 3)).otherwise("")
    joint = F.when(k % 5 == 0, F.concat(F.lit(".\n\n- 2023-1"), k % 4, F.lit("-05 "))).when(k % 5 == 1, ".\n\n  ## On 2024-01-15\n").otherwise(".\n\n")
    text = F.concat(F.lit("# Part "), k % 3, dated, F.lit("\n"), F.replace(F.col("text"), F.lit(". "), joint))
    found = I.chunk_markdown(docs(spark, d).select("doc_id", text.alias("text"), F.date_add(F.lit("2024-01-01"), (k % 30).cast("int")).alias("file_day")))
    return found.withColumn("day", F.col("day").cast("string"))


def _sentences(t: str) -> str:
    # the oracle's engine has no look behind: the white space behind an end mark becomes a character that no text has
    return f"list_filter(string_split(regexp_replace({t}, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')"


def _packed(parts: str, size: int, joint: str) -> str:
    """A fold over lists of one part: each is joined to the last of those before, if that stays within the size."""
    one = f"list_transform({parts}, lambda x: [x])"
    return f"case when len({parts}) = 0 then [] else list_reduce({one}, lambda a, b: case when length(a[-1]) + 1 + length(b[1]) <= {size} then list_append(a[:-2], a[-1] || {joint} || b[1]) else list_concat(a, b) end) end"


_CHUNKS = (
    "with p as (select doc_id, unnest(list_filter(regexp_split_to_array(text, '\\n+'), lambda x: trim(x) <> '')) as p, generate_subscripts(list_filter(regexp_split_to_array(text, '\\n+'), lambda x: trim(x) <> ''), 1) as i from documents),"
    f" s as (select doc_id, i, case when length(p) <= 3500 then [p] else {_sentences('p')} end as s from p), f as (select doc_id, i, {_packed('s', 3500, chr(39) + ' ' + chr(39))} as f from s), g as (select doc_id, flatten(list(f order by i)) as g from f group by doc_id), c as (select doc_id, {_packed('g', 3500, 'chr(10)')} as c from g)"
    " select doc_id, generate_subscripts(c, 1)::int - 1 as chunk, unnest(c) as text from c"
)


@query(_CHUNKS)
def chunk_text(spark, d):
    return I.chunk_text(docs(spark, d))


@query(
    f"with s as (select doc_id, {_sentences('text')} as s from documents), f as (select doc_id, {_packed('s', 1500, chr(39) + ' ' + chr(39))} as c from s), u as (select doc_id, c, generate_subscripts(c, 1) as i, unnest(c) as x from f)"
    " select doc_id, i::int - 1 as chunk, case when i = 1 then x else right(c[i - 1], 200) || ' ' || x end as text from u"
)
def chunk_overlap(spark, d):
    return I.chunk_overlap(docs(spark, d))


@query(M + ", m as (select memory_id as event_id, case memory_id % 3 when 0 then 'Ann@x.org' when 1 then 'bob@Y.com' else 'eve@z.net' end as sender, agent_id || '@in.box' as recipient, case when memory_id % 4 <> 0 then raw end as t, raw as html from memories) select event_id, 'A' || substr(recipient, 6, 1) as agent_id, substr(coalesce(t, html, ''), 1, 200) as body from m where (lower(sender) = 'ann@x.org' or lower(sender) like '%@y.com') and event_id % 9 <> 0 and cast(substr(recipient, 6, 1) as int) < 5")
def ingest_email(spark, d):
    m = view(spark, d, "memories")
    sender = F.element_at(F.array(*map(F.lit, ("Ann@x.org", "bob@Y.com", "eve@z.net"))), (F.col("memory_id") % 3 + 1).cast("int"))
    mails = m.select(F.col("memory_id").alias("event_id"), sender.alias("sender"), F.concat("agent_id", F.lit("@in.box")).alias("recipient"), F.when(F.col("memory_id") % 4 != 0, F.col("raw")).alias("text"), F.col("raw").alias("html"))
    agents = spark.createDataFrame([(f"agent{i}", f"A{i}") for i in range(5)], "local_part string, agent_id string")
    return I.ingest_email(mails.unionAll(mails), m.where("memory_id % 9 = 0").select(F.col("memory_id").alias("event_id")), ["ann@x.org", "@y.com"], agents, 200)


@query(M + ", n as (select user_id, sha256(lower(trim(coalesce(raw, '')))) as h, min(memory_id) as place from memories where memory_id % 2 = 0 group by 1, 2), k as (select * from n where not exists (select 1 from memories m where m.user_id = n.user_id and m.memory_id % 2 = 1 and sha256(lower(trim(coalesce(raw, '')))) = n.h)) select user_id, place, n::int as n from (select *, row_number() over (partition by user_id order by place) as n from k) where n <= 12")
def import_with_dedup(spark, d):
    m = view(spark, d, "memories").withColumn("raw", F.coalesce("raw", F.lit("")))
    return I.import_with_dedup(m.where("memory_id % 2 = 1"), m.where("memory_id % 2 = 0").withColumn("place", F.col("memory_id")), 12)


@query(M + ", r as (select user_id, memory_id, row_number() over (partition by user_id order by created_at, memory_id) as place, count(*) over (partition by user_id) > 15 as has_more from memories where created_at > timestamp '2024-01-20') select user_id, memory_id, place::int as place, has_more from r where place <= 15")
def incremental_pull(spark, d):
    return I.incremental_pull(view(spark, d, "memories"), "2024-01-20", 15)


@query(M + " select memory_id, case when observed_at is not null then 'EXPLICIT_CALLER' else 'FALLBACK_RECORDED_AT' end as anchor_source, observed_at is null and layer = 'IDENTITY' as warning from memories")
def temporal_anchor(spark, d):
    kind = F.when(F.col("layer") == "IDENTITY", "HISTORICAL").otherwise("CURRENT")
    return I.temporal_anchor(view(spark, d, "memories").withColumn("kind", kind)).select("memory_id", "anchor_source", "warning")


@query(M + ", u as (select x as memory_id, count(*) as u from (select unnest([memory_id, memory_id // 2]) as x from memories where memory_id % 3 = 0) group by 1), n as (select x as memory_id, count(*) as x from (select unnest([memory_id // 3]) as x from memories where memory_id % 3 = 1) group by 1) select memory_id, used_count + coalesce(u, 0) as used_count, unused_count + coalesce(n.x, 0) as unused_count from memories left join u using (memory_id) left join n using (memory_id) where deleted_at is null and (u is not null or n.x is not null)")
def trajectory_feedback(spark, d):
    m = view(spark, d, "memories")
    used = m.where("memory_id % 3 = 0").select(F.array(F.col("memory_id"), F.expr("memory_id div 2")).alias("ids"))
    unused = m.where("memory_id % 3 = 1").select(F.array(F.expr("memory_id div 3")).alias("ids"))
    return I.trajectory_feedback(m, used, unused)


_POOL = ", s as (select distinct session_id, user_id, agent_id as agent from memories where memory_id % 10 = 3), p as (select memory_id as pool_id, user_id, session_id as created_by, ['GLOBAL', 'SHARED', 'PRIVATE'][(memory_id % 3) + 1] as kind, memory_id % 10 = 0 as archived from memories where memory_id % 4 = 1), g as (select memory_id as pool_id, memory_id % 50 as grantee from memories where memory_id % 4 = 1), a as (select memory_id as pool_id, agent_id as grantee from memories where memory_id % 8 = 1)"


@query(M + _POOL + " select session_id, pool_id from s join p using (user_id) where kind = 'GLOBAL' and not archived union select session_id, p.pool_id from s join g on grantee = session_id join p on p.pool_id = g.pool_id where kind = 'SHARED' and not archived union select session_id, pool_id from s join p on created_by = session_id where kind = 'PRIVATE' and not archived union select session_id, p.pool_id from s join a on grantee = agent join p on p.pool_id = a.pool_id where kind = 'PRIVATE' and not archived")
def visible_pools(spark, d):
    m = view(spark, d, "memories")
    kind = F.element_at(F.array(*map(F.lit, ("GLOBAL", "SHARED", "PRIVATE"))), (F.col("memory_id") % 3 + 1).cast("int"))
    pools = m.where("memory_id % 4 = 1").select(F.col("memory_id").alias("pool_id"), "user_id", F.col("session_id").alias("created_by"), kind.alias("kind"), (F.col("memory_id") % 10 == 0).alias("archived"))
    one = m.where("memory_id % 4 = 1").select(F.col("memory_id").alias("pool_id"), (F.col("memory_id") % 50).cast("string").alias("grantee"), F.lit("session").alias("grantee_kind"))
    two = m.where("memory_id % 8 = 1").select(F.col("memory_id").alias("pool_id"), F.col("agent_id").alias("grantee"), F.lit("agent").alias("grantee_kind"))
    s = m.where("memory_id % 10 = 3").select("session_id", "user_id", F.col("agent_id").alias("agent")).distinct()
    return I.visible_pools(s, pools, one.unionAll(two))


_CSV = ", c as (select memory_id as row, case when memory_id % 17 <> 0 then ' N' || memory_id || ' ' end as name, ['Person', 'ORGANIZATION', 'alien'][(memory_id % 3) + 1] as kind, case when memory_id % 5 = 0 then 'x' else (memory_id % 7)::varchar end as imp from memories), e as (select *, try_cast(imp as int) as n, case when name is null then 'no name' when try_cast(imp as int) is null or try_cast(imp as int) not between 1 and 5 then 'importance must be 1 to 5' end as error from c)"


def _csv(spark, d):
    m = view(spark, d, "memories")
    kind = F.element_at(F.array(*map(F.lit, ("Person", "ORGANIZATION", "alien"))), (F.col("memory_id") % 3 + 1).cast("int"))
    return m.select(F.col("memory_id").alias("row"), F.when(F.col("memory_id") % 17 != 0, F.concat(F.lit(" N"), "memory_id", F.lit(" "))).alias("name"), kind.alias("kind"), F.when(F.col("memory_id") % 5 == 0, "x").otherwise((F.col("memory_id") % 7).cast("string")).alias("importance"))


@query(M + _CSV + " select row, trim(name) as name, case when lower(kind) in ('person', 'organization') then lower(kind) else 'other' end as kind, n as importance from e where error is null")
def import_rows(spark, d):
    return I.import_rows(_csv(spark, d), ["person", "organization"])[0]


@query(M + _CSV + " select row, error from e where error is not null")
def import_errors(spark, d):
    return I.import_rows(_csv(spark, d), ["person", "organization"])[1]


@query(M + " select user_id, count(*) as n, list(memory_id order by memory_id) as ids from memories where layer in ('PROJECT', 'TASK') group by 1")
def export_memories(spark, d):
    return I.export_memories(view(spark, d, "memories"), ["PROJECT", "TASK"]).select("user_id", "n", F.col("memories.memory_id").alias("ids"))


@query(M + "," + V[4:] + "," + E[4:] + ", v as (select vec_id as memory_id, list(model_id) as models, min(len(embedding)) as size from vectors group by 1), l as (select source_id as memory_id, list(target_id || ' ' || edge_type order by target_id, edge_type) as links from edges group by 1) select m.memory_id, user_id, memory_type, tags, coalesce(models, []) as models, size::int as size, coalesce(links, []) as links from memories m left join v on v.memory_id = m.memory_id left join l on l.memory_id = m.memory_id where deleted_at is null and layer in ('SESSION', 'PROJECT') and project_id = 'p1' and created_at between timestamp '2024-01-03' and timestamp '2024-01-28'")
def export_rows(spark, d):
    vectors = view(spark, d, "vectors").select(F.col("vec_id").alias("memory_id"), "model_id", "embedding")
    links = view(spark, d, "edges").select(F.col("source_id").alias("memory_id"), "target_id", "edge_type")
    rows = I.export_rows(view(spark, d, "memories"), ["SESSION", "PROJECT"], "p1", "2024-01-03", "2024-01-28", vectors, links)
    joined = F.transform("links", lambda x: F.concat_ws(" ", x["target_id"], x["edge_type"]))
    size = F.when(F.size("vectors") > 0, F.size(F.get("vectors", F.lit(0))["embedding"]))
    return rows.select("memory_id", "user_id", "extraction.memory_type", "extraction.tags", F.col("vectors.model_id").alias("models"), size.alias("size"), joined.alias("links"))


@query("select 'text' as column_name, 'is null' as problem, count(*) filter (text is null) as n from documents union all select 'doc_id', 'is null', count(*) filter (doc_id is null) from documents union all select 'lang', 'unknown value', count(*) filter (lang not in ('en', 'fr', 'de')) from documents union all select 'embedding', 'wrong size', count(*) filter (len(embedding) <> 64) from embeddings")
def table_problems(spark, d):
    one = I.load_table(spark, f"{d}/documents.parquet", "doc_id long, text string, lang string")
    two = I.load_table(spark, f"{d}/embeddings.parquet", "embedding array<float>")
    return I.table_problems(one, ("text", "doc_id"), {"lang": ("en", "fr", "de")}).unionAll(I.table_problems(two, sizes={"embedding": 64}))


def _rule(column: str, problem: str, bad: str) -> str:
    return f"select '{column}' as column_name, '{problem}' as problem, count(*) filter ({bad}) as n from t"


_KEPT = ("layer", "memory_type", "embedding_status")
_PROBLEMS = (
    M + ", t as (select * replace (case when memory_id % 50 = 7 then null else created_at end as created_at) from memories) "
    + " union all ".join([_rule(c, "is null", f"{c} is null") for c in I.MEMORY_REQUIRED] + [_rule(c, "unknown value", f"{c} not in {I.MEMORY_VALUES[c]}") for c in _KEPT])
    + " union all " + " union all ".join([_rule("user_id", "not found", "user_id is not null and user_id not in (select user_id from memories where memory_id % 4 = 1 and user_id is not null)")]
    + [_rule(c, "not found", f"{c} is not null and {c} not in (select memory_id from memories)") for c in ("superseded_by", "consolidated_into")])
)


@query(_PROBLEMS)
def memory_problems(spark, d):
    m = view(spark, d, "memories")
    broken = m.withColumn("created_at", F.when(F.col("memory_id") % 50 == 7, None).otherwise(F.col("created_at")))
    return I.memory_problems(broken, {"users": m.where("memory_id % 4 = 1").select("user_id")})
