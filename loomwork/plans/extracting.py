"""Queries of loomwork.operators.extracting. Oracles use the same fixed pattern tables with DuckDB's regular expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import extracting as X
from loomwork.plans.registry import query
from loomwork.sources.views import NOW, view, view_sql

# Put before the texts, so that the patterns have something to find.
SAID = [
    "Never forget the tickets! Really.", "No, that's wrong. I meant Tuesday", "I always take the train. Fine", "I like tea", "Keep in mind: doors close early", "fyi",
    "There are 9 in progress", "5 tickets are still open", "The user is now testing it", "User's dog is called Rex", "The user likes rain", "Right now we wait",
    "Successfully migrated the old database, twice.", "We deployed the search service. It was fixed quickly", "She is skilled in knitting of jumpers.", "I prefer dark themes, always use tabs.",
    "My favorite editor is vim. I usually walk home", "He doesn't like coffee", "The goal is agreed", "A crash: the build is broken", "We shipped it, a success", "There is an error", "plain words",
]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spoken(key, text):
    phrase = F.element_at(F.array(*map(F.lit, SAID)), (F.pmod(key, F.lit(len(SAID))) + 1).cast("int"))
    return F.concat(phrase, F.lit(" "), F.coalesce(text, F.lit("")))


def _spoken_sql(key: str, text: str) -> str:
    return "[" + ", ".join(map(_q, SAID)) + f"][(({key}) % {len(SAID)}) + 1] || ' ' || coalesce({text}, '')"


def turns(spark, d):
    t = spark.read.parquet(f"{d}/conversations.parquet")
    return t.select("conv_id", "turn", "role", _spoken(F.col("conv_id") * 5 + F.col("turn"), F.col("text")).alias("text"))


def memories(spark, d):
    return view(spark, d, "memories").withColumn("raw", _spoken(F.col("memory_id"), F.col("raw")))


TURNS = f"with t as (select conv_id, turn, role, {_spoken_sql('conv_id * 5 + turn', 'text')} as t from conversations)"
MEM = view_sql("memories") + f", m as (select * replace ({_spoken_sql('memory_id', 'raw')} as raw) from memories)"


def _hit(p: str, t: str = "t") -> str:
    return f"regexp_matches({t}, {_q(p)}, 'i')"


def _first(p: str) -> str:
    return f"nullif(regexp_extract(t, {_q(p)}, 0, 'i'), '')"


def _around(p: str) -> str:
    before = f"regexp_extract(t, {_q('^(.*?)(?:' + p + ')')}, 1, 'is')"
    return f"trim(regexp_extract({before}, '([^.!?]*)\\z', 1) || regexp_extract(t[length({before}) + 1:], '^([^.!?]*)', 1))"


def _signals() -> str:
    rows = []
    for kind, ps, base, raising, raised in X.SIGNALS:
        trigger, sentence = "coalesce(" + ", ".join(map(_first, ps)) + ")", "case " + " ".join(f"when {_first(p)} is not null then {_around(p)} end" if p == ps[-1] else f"when {_first(p)} is not null then {_around(p)}" for p in ps)
        sure = f"case when {_hit(raising, trigger)} then {raised}::double else {base}::double end" if raising else f"{base}::double"
        only = " and role = 'user'" if kind == "preference" else ""
        rows.append(f"select conv_id, turn, '{kind}' as kind, {trigger} as trigger, {sentence} as sentence, round({sure} * case when length(t) < 20 then 0.8::double else 1 end, 6) as confidence from t where {trigger} is not null{only}")
    return TURNS + " " + " union all ".join(rows)


@query(_signals())
def importance_signals(spark, d):
    return X.importance_signals(turns(spark, d))


_FACTS = TURNS + ", f as (select conv_id * 100 + turn as fact_id, conv_id, t, case when turn % 3 = 0 then [] else [turn, turn + 1] end as cites from t)"
_GUARD = (
    _FACTS + ", w as (select conv_id, min(turn) filter (role = 'user') as first_user, max(turn) as last_turn, bool_and(role = 'assistant') as al from t group by 1), e as (select fact_id, conv_id, unnest(cites) as turn from f),"
    " c as (select fact_id, max(turn) as last_cited, bool_and(role = 'assistant') as ca from e join t using (conv_id, turn) group by 1),"
    f" r as (select fact_id, case when {' or '.join(map(_hit, X.STATUS_SIGNS))} then 'status_chatter' when coalesce(ca, al, true) and not coalesce(first_user < coalesce(last_cited, last_turn), false) and {_hit(X.USER_SUBJECT)} then 'user_subject_from_assistant' end as reason"
    " from f left join w using (conv_id) left join c using (fact_id)) select fact_id, reason is null as keep, reason from r"
)


@query(_GUARD)
def formation_guard(spark, d):
    t = turns(spark, d)
    turn = F.col("turn").cast("long")
    cites = F.when(turn % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(turn, turn + 1))
    return X.formation_guard(t.select((F.col("conv_id") * 100 + turn).alias("fact_id"), "conv_id", F.col("text").alias("content"), cites.alias("cites")), t)


@query(
    "with c as (select doc_id as memory_id, 't' || (doc_id % 7) as topic, cast((doc_id * 37) % 101 as double) / 100 as score from documents where (doc_id * 37) % 101 > 0),"
    " b as (select memory_id, 't' || ((memory_id + 3 * i) % 7) as topic, cast((memory_id * 53 + i) % 101 as double) / 100 as confidence from (select doc_id as memory_id, unnest(range(4)) as i from documents) where i < 3)"
    " select * from (select memory_id, topic, round(case when score is null then case when confidence > 0.7::double then 0.2::double end when confidence is null then score else score * 1.15::double end, 6) as score from c full join b using (memory_id, topic)) where score is not null"
)
def topic_context(spark, d):
    i = F.col("doc_id")
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    current = rows.select(i.alias("memory_id"), F.concat(F.lit("t"), i % 7).alias("topic"), ((i * 37 % 101).cast("double") / 100).alias("score"))
    n = F.col("n")
    recent = rows.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(3))))
    recent = recent.select(i.alias("memory_id"), F.concat(F.lit("t"), (i + 3 * n) % 7).alias("topic"), (((i * 53 + n) % 101).cast("double") / 100).alias("confidence"), (n + 1).alias("rank"))
    return X.topic_context(current, recent)


_SHIFTED = "case when memory_id % 31 = 0 then created_at + interval 40 days when memory_id % 4 = 0 then timestamp '" + NOW + "' - to_seconds((memory_id * 61) % 200000) else created_at - to_days((memory_id % 900)::int) end"
_AGO = f"""case when m < 1 then 'less than a minute' when m < 2 then '1 minute' when m < 45 then m || ' minutes' when m < 90 then 'about 1 hour'
when m < 1440 then 'about ' || floor(m / 60 + 0.5::double)::bigint || case when floor(m / 60 + 0.5::double) = 1 then ' hour' else ' hours' end when m < 2520 then '1 day'
when m < 43200 then floor(m / 1440 + 0.5::double)::bigint || ' days' when m < 86400 then 'about ' || floor(m / 43200 + 0.5::double)::bigint || case when floor(m / 43200 + 0.5::double) = 1 then ' month' else ' months' end
when mo < 12 then floor(m / 43200 + 0.5::double)::bigint || ' months' when mo % 12 < 3 then 'about ' || (mo // 12) || case when mo // 12 = 1 then ' year' else ' years' end
when mo % 12 < 9 then 'over ' || (mo // 12) || case when mo // 12 = 1 then ' year' else ' years' end else 'almost ' || (mo // 12 + 1) || case when mo // 12 + 1 = 1 then ' year' else ' years' end end"""


@query(
    view_sql("memories") + f", s as (select memory_id, raw, effective, importance, safety_critical, {_SHIFTED} as made from memories), x as (select *, floor(abs(epoch(timestamp '{NOW}') - epoch(made)) / 60 + 0.5::double)::bigint as m, datesub('month', least(made, timestamp '{NOW}'), greatest(made, timestamp '{NOW}')) as mo from s),"
    " e as (select memory_id, i, 'n' || ((memory_id + i) % 9) as name from (select memory_id, unnest(range(memory_id % 8 + 1)) as i from memories where memory_id % 3 = 0)), n as (select memory_id, string_agg(name, ', ' order by i) as names from e where i < 5 group by 1),"
    f" p as (select memory_id, raw, concat_ws(' ', '[Time: ' || strftime(made, '%B %-d, %Y') || ', ' || case when made > timestamp '{NOW}' then 'in ' || ({_AGO}) else ({_AGO}) || ' ago' end || ']', '[About: ' || names || ']', case when coalesce(effective, importance) >= 0.9 or safety_critical then '[Critical importance]' when coalesce(effective, importance) >= 0.7 then '[High importance]' end) as prefix from x left join n using (memory_id))"
    " select memory_id, prefix || chr(10) || chr(10) || coalesce(raw, '') as enriched from p"
)
def enrich_text(spark, d):
    i, now = F.col("memory_id"), F.lit(NOW).cast("timestamp")
    at = F.when(i % 31 == 0, F.col("created_at") + F.expr("interval 40 days")).when(i % 4 == 0, F.timestamp_seconds(F.unix_timestamp(now) - i * 61 % 200000)).otherwise(F.timestamp_seconds(F.unix_timestamp("created_at") - i % 900 * 86400))
    m = view(spark, d, "memories").withColumn("created_at", at)
    names = m.where(i % 3 == 0).select("memory_id", F.explode(F.sequence(F.lit(0).cast("long"), i % 8)).alias("place")).withColumn("name", F.concat(F.lit("n"), (i + F.col("place")) % 9))
    return X.enrich_text(m, names, NOW)


def _phrases_sql(rules, extra: str = "") -> str:
    rules = [(X.of_line(p), v) for p, v in rules]
    parts = ", ".join(f"case when {_hit(p, 'raw')} then {{'a': trim(regexp_extract(raw, {_q(p)}, 1, 'i')), 'b': {_q(v) if isinstance(v, str) else str(v) + '::double'}, 'i': {i}}} end" for i, (p, v) in enumerate(rules))
    return MEM + f", s as (select memory_id, raw, memory_type, list_filter([{parts}], lambda x: x is not null) as f from m), u as (select memory_id, unnest(f) as x from s), g as (select memory_id, x.a as a, x.b as b, row_number() over (partition by memory_id, lower(x.a) order by x.i) as r from u)"


@query(_phrases_sql(X.CAPABILITIES) + " select memory_id, a as capability, b as confidence from g where r = 1")
def capability_signals(spark, d):
    return memories(spark, d).select("memory_id", F.inline(X.capability_signals(F.col("raw"))))


_CATEGORY = "case " + " ".join(f"when {_hit(p, 'raw')} then '{n}'" for n, p in X.CATEGORIES) + " else 'general' end"


@query(
    _phrases_sql(X.PREFERENCES) + f", all_ as (select memory_id, a as preference, b as strength from g where r = 1 union all select memory_id, raw[1:150], 'moderate' from s where len(f) = 0 and memory_type = 'PREFERENCE') select memory_id, {_CATEGORY} as category, preference, strength from all_ join m using (memory_id)"
)
def preference_signals(spark, d):
    m = memories(spark, d)
    found = m.select("memory_id", "raw", F.inline(X.preference_signals(F.col("raw"), F.col("memory_type"))))
    # categories are sought in the texts that have a preference only
    return found.select("memory_id", X.preference_category(F.col("raw")).alias("category"), "preference", "strength")


_LABELS = MEM + ", l as (select project_id, memory_id, raw, unnest(case when layer = 'INSIGHT' then ['insight'] else list_filter([" + ", ".join(f"case when {_hit(p, 'raw')} then '{n}' end" for n, p in X.STATE_SIGNS.items()) + "], lambda x: x is not null) end) as label from m), z as (select project_id, memory_id, label, case when label = 'issue' then case " + " ".join(f"when {_hit(p, 'raw')} then '{n}'" for n, p in X.SEVERITY) + " else 'low' end end as severity from l)"


@query(_LABELS + " select * from z")
def project_labels(spark, d):
    return X.project_labels(memories(spark, d))


@query(
    _LABELS + ", c as (select project_id, " + ", ".join(f"count(*) filter (label = '{n}') as {n}s" for n in [*X.STATE_SIGNS, "insight"]) + ", count(*) filter (severity = 'critical') as critical from z group by 1), w as (select project_id, count(*) as total, max(created_at) as last from m group by 1)"
    " select project_id, total, epoch_us(last) as last_activity, " + ", ".join(f"coalesce({n}s, 0) as {n}s" for n in [*X.STATE_SIGNS, "insight"]) + ", coalesce(critical, 0) as critical, round(least(total / 50, 1.0::double) * 0.4::double + greatest(0.0::double, 1 - (epoch(timestamp '" + NOW + "') - epoch(last)) / 86400 / 30) * 0.3::double + (" + " + ".join(f"(coalesce({n}s, 0) > 0)::int" for n in [*X.STATE_SIGNS, "insight"]) + ")::double / 5 * 0.3::double, 2) as confidence from w left join c using (project_id)"
)
def project_state(spark, d):
    return X.project_state(memories(spark, d), NOW).withColumn("last_activity", F.unix_micros("last_activity"))


@query(view_sql("memories") + f", r as (select project_id, memory_id, row_number() over (partition by project_id order by created_at desc, memory_id) as rank from memories where created_at >= timestamp '{NOW}' - interval 7 days) select project_id, memory_id, rank::int as rank from r where rank <= 20")
def recent_activity(spark, d):
    return X.recent_activity(view(spark, d, "memories"), NOW)


@query(
    view_sql("memories", "calls") + ", s as (select session_id, min(agent_id) as agent from memories where session_id % 5 <> 0 group by 1), r as (select k as memory_id, event_id, agent_id, row_number() over (partition by k order by ts desc, event_id desc) as rank from calls), a as (select memory_id, list(event_id order by rank) as accesses, list(agent_id order by rank) as by_agents from r where rank <= 4 group by 1), p as (select memory_id, list(distinct pool) as pools from (select memory_id, unnest([memory_id % 7, memory_id % 11]) as pool from memories where memory_id % 4 = 1) group by 1)"
    " select memory_id, agent, accesses, by_agents, list_sort(pools) as pools from memories left join s using (session_id) left join a using (memory_id) left join p using (memory_id)"
)
def memory_attribution(spark, d):
    m, i = view(spark, d, "memories"), F.col("memory_id")
    sessions = m.where("session_id % 5 <> 0").groupBy("session_id").agg(F.min("agent_id").alias("agent"))
    calls = view(spark, d, "calls").select(F.col("k").alias("memory_id"), "event_id", "ts", F.col("agent_id").alias("agent"))
    members = m.where(i % 4 == 1).select("memory_id", F.explode(F.array(i % 7, i % 11)).alias("pool_id"))
    return X.memory_attribution(m, sessions, calls, members, 4).select("memory_id", "agent", F.col("accesses.event_id").alias("accesses"), F.col("accesses.agent").alias("by_agents"), "pools")


MAPPING = {"name": "full name", "kind": "kind", "description": "note", "content": "text", "importance": "stars", "attributes": [("town", "city"), ("kind", "sort")]}


def _sheet(spark, d):
    i = F.col("memory_id")
    m = view(spark, d, "memories")
    return m.select(
        i.alias("row"), F.when(i % 17 != 0, F.concat(F.lit(" N"), i)).alias("full name"), F.element_at(F.array(*map(F.lit, ("Person", "ORGANIZATION", "alien", ""))), (i % 4 + 1).cast("int")).alias("kind"),
        F.when(i % 3 == 0, "").otherwise("seen").alias("note"), F.when(i % 5 == 0, " ").otherwise(F.concat(F.lit("town"), i % 4)).alias("town"), F.when(i % 13 != 0, F.col("raw")).alias("text"),
        F.when(i % 6 == 0, "x").when(i % 6 == 1, "").otherwise((i % 7).cast("string")).alias("stars"),
    )


_SHEET = view_sql("memories") + ", c as (select memory_id as row, case when memory_id % 17 <> 0 then 'N' || memory_id end as name, ['Person', 'ORGANIZATION', 'alien', ''][(memory_id % 4) + 1] as kind, case when memory_id % 3 <> 0 then 'seen' end as note, case when memory_id % 5 <> 0 then 'town' || (memory_id % 4) end as town, case when memory_id % 13 <> 0 then nullif(trim(raw), '') end as content, case when memory_id % 6 = 0 then 'x' when memory_id % 6 = 1 then '' else (memory_id % 7)::varchar end as stars from memories)"


@query(_SHEET + " select row, name, case when upper(kind) in ('PERSON', 'ORGANIZATION') then upper(kind) else 'PERSON' end as kind, note as description from c where name is not null")
def import_profiles(spark, d):
    return X.map_import(_sheet(spark, d), MAPPING)[0]


@query(_SHEET + " select row, 'city' as key, town as value from c where name is not null and town is not null union all select row, 'sort', kind from c where name is not null and kind <> ''")
def import_attributes(spark, d):
    return X.map_import(_sheet(spark, d), MAPPING)[1]


@query(_SHEET + " select row, content, case when try_cast(stars as double) between 1 and 5 then stars::int end as importance from c where name is not null and content is not null")
def import_memories(spark, d):
    return X.map_import(_sheet(spark, d), MAPPING)[2]


@query(_SHEET + " select row, 'name is required' as message from c where name is null union all select row, 'unknown kind' from c where kind = 'alien' union all select row, 'importance must be 1 to 5' from c where content is not null and stars <> '' and not coalesce(try_cast(stars as double) between 1 and 5, false)")
def import_issues(spark, d):
    return X.map_import(_sheet(spark, d), MAPPING)[3]
