"""Queries of loomwork.operators.texts. Oracles use the same fixed pattern tables with DuckDB's regular expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import segmenting
from loomwork.operators import texts as T
from loomwork.plans.registry import query
from loomwork.sources.views import NOW, view, view_sql


def _sql(p: str) -> str:
    return "regexp_matches(t, '(?i)" + p.replace("'", "''") + "')"


def _any(ps: list[str]) -> str:
    return "(" + " or ".join(map(_sql, ps)) + ")"


def docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def told(spark, d):
    """Turns with a phrase from a list before their text, so that the patterns have something to find."""
    t = spark.read.parquet(f"{d}/conversations.parquet")
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(PHRASES))) + 1).cast("int"))
    return t.select("conv_id", "turn", "role", F.concat(phrase, F.lit(" "), F.coalesce("text", F.lit(""))).alias("t"))


PHRASES = [
    "I prefer tea", "Remind me to call", "The deploy failed", "Actually, that was wrong", "She is allergic to nuts", "We decided to merge", "What is the phone number",
    "what happened day before yesterday", "3 days ago it broke", "last 10 days", "Important: keep in mind", "this week we shipped it", "Explain how to compare", "2 months ago", "plain words",
    "past month or so", "5 hours ago", "1 year ago", "years ago", "recently", "summary of the last session", "insulin and EpiPen", "my name is Ann", "earlier", "a friend came by", "one colleague said so",
]
TOLD = "with told as (select conv_id, turn, role, [" + ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES) + f"][((conv_id * 7 + turn) % {len(PHRASES)}) + 1] || ' ' || coalesce(text, '') as t from conversations)"
_LAYER = "case " + " ".join(f"when {_any(ps)} then '{k}'" for k, ps in T.LAYER_PATTERNS.items()) + " else 'SESSION' end"
_TYPE = "case " + " ".join("when " + " and ".join([_sql(p) for p in need] + ["not " + _sql(p) for p in ban]) + f" then '{k}'" for k, need, ban in T.TYPE_RULES) + " else 'FACT' end"
_SAFE = "list_filter([" + ", ".join(f"case when {_sql(p)} then '{i}' end" for p, i in T.SAFETY_PATTERNS) + "], lambda x: x is not null)"


@query(f"{TOLD} select conv_id, turn, {_LAYER} as layer from told")
def classify_layer(spark, d):
    return told(spark, d).select("conv_id", "turn", T.classify_layer(F.col("t")).alias("layer"))


# kinds of entities by the number of the turn, since the given tables have none
_KINDS = ["project", "person", "place", "organization", "person"]
_BY_ENTITY = _LAYER.replace(" else 'SESSION' end", f" when kind in ('project', 'organization') then 'PROJECT' when kind = 'person' and coalesce(role <> '', false) and {_sql(T.CLOSE_PEOPLE)} then 'IDENTITY' else 'SESSION' end")


@query(f"{TOLD}, e as (select *, {_KINDS}[((conv_id + turn) % 6) + 1] as kind from told) select conv_id, turn, {_BY_ENTITY} as layer from e")
def classify_layer_by_entities(spark, d):
    kind = F.get(F.array(*map(F.lit, _KINDS)), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6)).cast("int"))
    entities = F.when(kind.isNotNull(), F.array(F.struct(kind.alias("type"))))
    return told(spark, d).select("conv_id", "turn", T.classify_layer(F.col("t"), entities=entities, who=F.col("role")).alias("layer"))


@query(f"{TOLD} select conv_id, turn, {_TYPE} as memory_type from told")
def classify_type(spark, d):
    return told(spark, d).select("conv_id", "turn", T.classify_type(F.col("t")).alias("memory_type"))


@query(f"{TOLD}, s as (select conv_id, turn, {_SAFE} as f from told) select conv_id, turn, list_filter(f, lambda x, i: list_position(f, x) = i) as flags from s")
def safety_flags(spark, d):
    return told(spark, d).select("conv_id", "turn", T.safety_flags(F.col("t")).alias("flags"))


@query(f"with d as (select doc_id, trim(coalesce(text, '')) as t from documents) select doc_id, case when length(t) >= 30 and ({_any(T.PREFERENCE_SIGNS + T.FACT_SIGNS)} or regexp_matches(t, '[a-z,;] [A-Z][a-z]+') or regexp_matches(t, '[0-9]')) then 'DURABLE' else 'EPHEMERAL' end as durability from d")
def durability(spark, d):
    return docs(spark, d).select("doc_id", T.durability(F.col("text")).alias("durability"))


@query(f"{TOLD}, q as (select conv_id, turn, array_to_string(regexp_split_to_array(lower(trim(t)), '[ \\t\\r\\n\\f]+')[1:6], ' ') as t from told) select conv_id, turn, case when {_any(T.TEMPORAL_SIGNS)} then 'TEMPORAL' when {_any(T.FACTUAL_SIGNS)} then 'FACTUAL' else 'SEMANTIC' end as query_type from q")
def query_type(spark, d):
    t = told(spark, d).withColumn("t", F.array_join(F.slice(F.split(F.lower(F.trim("t")), r"[ \t\r\n\f]+"), 1, 6), " "))
    return t.select("conv_id", "turn", T.query_type(F.col("t")).alias("query_type"))


@query(f"{TOLD} select conv_id, turn, case when {_sql(T.SUCCESS_WORDS)} and not {_sql(T.FAILURE_WORDS)} then true when {_sql(T.FAILURE_WORDS)} and not {_sql(T.SUCCESS_WORDS)} then false end as outcome from told")
def text_outcome(spark, d):
    return told(spark, d).select("conv_id", "turn", T.outcome(F.col("t")).alias("outcome"))


_VOTES = ", ".join(f"({' + '.join(_sql(p) + '::int' for p, ls in T.LEVEL_PATTERNS if lv in ls)}) as {lv}" for lv in ("L0", "L1", "L2", "L3"))


@query(f"{TOLD}, v as (select conv_id, turn, {_VOTES} from told), r as (select conv_id, turn, unnest(['L0', 'L1', 'L2', 'L3']) as level, unnest([L0, L1, L2, L3]) as votes from v) select conv_id, turn, level, votes::int as votes, (row_number() over (partition by conv_id, turn order by votes desc, level))::int as place from r where votes > 0")
def level_route(spark, d):
    rows = told(spark, d).select("conv_id", "turn", F.posexplode(T.level_votes(F.col("t"))).alias("place", "v"))
    return rows.select("conv_id", "turn", "v.level", "v.votes", (F.col("place") + 1).alias("place"))


@query(f"{TOLD} select conv_id, turn, list_filter([case when {_any(T.EXPLICIT_SIGNS)} then 'explicit' end, case when {_any(T.CORRECTION_SIGNS)} then 'correction' end, case when {_any(T.PREFERENCE_SIGNS)} then 'preference' end], lambda x: x is not null) as signs from told")
def importance_signs(spark, d):
    return told(spark, d).select("conv_id", "turn", T.importance_signs(F.col("t")).alias("signs"))


@query("""with r as (select conv_id, turn, unnest(list_distinct(regexp_extract_all(text, '"([^"]+)"', 1) || regexp_extract_all(text, '[a-z,;] ([A-Z][a-z]+)', 1))) as concept from conversations where role = 'user'), n as (select conv_id, lower(concept) as concept, count(distinct turn) as turns from r group by 1, 2) select conv_id, concept, turns, round(least(0.9::double, 0.6::double + 0.1::double * turns), 6) as confidence from n where turns >= 2""")
def repeated_concepts(spark, d):
    return T.repeated_concepts(spark.read.parquet(f"{d}/conversations.parquet"))


_RULES = [("travel", "life", "the", 0.9), ("food", "life", "and", 0.6), ("work", None, "que", 0.8), ("work", None, "der", 0.7), ("health", "body", "of", 0.5)]


@query("with rules(topic, parent, word, weight) as (values " + ", ".join(f"('{t}', {'null' if p is None else chr(39) + p + chr(39)}, '{w}', {x}::double)" for t, p, w, x in _RULES) + "), w as (select doc_id as memory_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) as word from documents), h as (select memory_id, topic, parent, count(*) as n, max(weight) as w from w join rules using (word) group by 1, 2, 3), o as (select memory_id, topic, parent, w * least(n / 2, 1.0::double) as s from h), b as (select memory_id, topic, s from o union all select memory_id, parent, 0.7::double * s from o where parent is not null), m as (select memory_id, topic, round(max(s), 6) as score from b group by 1, 2) select memory_id, topic, score, rank::int as rank from (select *, row_number() over (partition by memory_id order by score desc, topic) as rank from m where score >= 0.3) where rank <= 5")
def topic_scores(spark, d):
    rules = spark.createDataFrame(_RULES, "topic string, parent string, word string, weight double")
    return T.topics(docs(spark, d).select(F.col("doc_id").alias("memory_id"), F.col("text").alias("raw")), rules)


def _time_sql() -> str:
    now, day = "timestamp '2024-01-31 15:30:00'", "date '2024-01-31'"
    e = lambda x: f"epoch(({x})::timestamp)::bigint"
    num = lambda u: f"regexp_extract(t, '\\b([0-9]{{1,4}})\\s+{u}s?\\s+ago\\b', 1)"
    n = lambda u: f"try_cast({num(u)} as int)"
    has = lambda p: f"regexp_matches(t, '\\b({p})\\b')"
    dayof = lambda off: (e(f"{day} + ({off})::int"), e(f"{day} + ({off})::int + 1") + " - 1", "false")
    month = f"({day} - to_months({n('month')}))"
    back = "try_cast(regexp_extract(t, '\\b(?:last|past)\\s+([0-9]{1,4})\\s+days?\\b', 1) as int)"
    rules = [
        (has("today|this morning|this afternoon|this evening|tonight"), dayof("0")), (has("yesterday"), dayof("-1")), (has("day before yesterday|two days ago|2 days ago"), dayof("-2")),
        (num("hour") + " <> ''", (f"{e(now)} - {n('hour')} * 3600", e(now), "false")), (num("minute") + " <> ''", (f"{e(now)} - {n('minute')} * 60", e(now), "false")),
        (num("day") + " <> ''", dayof("-" + n("day"))), (num("week") + " <> ''", dayof("-7 * " + n("week"))),
        (num("month") + " <> ''", (e(f"date_trunc('month', {month})"), e(f"last_day({month}::date) + 1") + " - 1", "false")),
        (num("year") + " <> ''", (e(f"make_date(2024 - {n('year')}, 1, 1)"), e(f"make_date(2025 - {n('year')}, 1, 1)") + " - 1", "false")),
        (has(r"years\s+ago"), (e("date '2021-01-01'"), e("date '2023-01-01'"), "false")), (back + " is not null", (e(f"{day} - {back}"), e(now), "false")),
        (has(r"(?:last|past)\s+week"), (e(f"{day} - 7"), e(now), "false")), (has(r"this\s+week"), (e("date '2024-01-29'"), e(now), "false")),
        (has(r"(?:last|past)\s+month"), (e(f"{day} - 30"), e(now), "true")), (has(r"this\s+month"), (e("date '2024-01-01'"), e(now), "false")),
        (has("recently|lately|recent"), (e(f"{day} - 3"), e(now), "true")), (has("earlier today|earlier"), (e(day), e(f"{day} + 1") + " - 1", "true")),
    ]
    case = lambda k: "case " + " ".join(f"when {c} then {v[k]}" for c, v in rules) + " end"
    return f'{TOLD}, q as (select conv_id, turn, lower(t) as t from told) select conv_id, turn, ({case(0)})::bigint as start, ({case(1)})::bigint as "end", {case(2)} as soft from q'


@query(_time_sql())
def parse_time(spark, d):
    rows = told(spark, d).withColumn("p", T.parse_time(F.col("t"), "2024-01-31 15:30:00"))
    return rows.select("conv_id", "turn", "p.start", "p.end", "p.soft")


_ABOUT = "(" + _sql(r"\bi (am|'m) a\b") + " or " + _sql(r"\bmy (name|birthday|job|wife|husband|family)\b") + ")"


@query(f"{TOLD} select conv_id, turn, case when {_any(T.PREFERENCE_SIGNS)} or {_ABOUT} then 'IDENTITY' when {_any(T.LAYER_PATTERNS['PROJECT'])} then 'PROJECT' else 'SESSION' end as layer, case when conv_id % 11 >= 9 then 'critical' when conv_id % 11 >= 7 then 'high' when conv_id % 11 >= 5 then 'medium' else 'low' end as band from told")
def observed_layer(spark, d):
    t = told(spark, d)
    return t.select("conv_id", "turn", T.observed_layer(F.col("t"), T.importance_signs(F.col("t"))).alias("layer"), T.importance_band((F.col("conv_id") % 11) / 10).alias("band"))


@query("with c as (select doc_id as memory_id, 't' || (doc_id % 7) as topic, cast((doc_id * 37) % 101 as double) / 100 as score from documents union select doc_id, 't' || (doc_id % 5), cast((doc_id * 53) % 101 as double) / 100 from documents where doc_id % 5 <> doc_id % 7), r(topic, related) as (select 't' || a, 't' || ((a + b) % 7) from range(7) x(a), range(1, 4) y(b)), n as (select memory_id, related as topic, max(round(score * 0.5::double, 6)) as confidence from c join r using (topic) where not exists (select 1 from c c2 where c2.memory_id = c.memory_id and c2.topic = related) group by 1, 2) select memory_id, topic, confidence, rank::int as rank from (select *, row_number() over (partition by memory_id order by confidence desc, topic) as rank from n) where rank <= 3")
def predict_topics(spark, d):
    i = F.col("doc_id")
    one = docs(spark, d).select(i.alias("memory_id"), F.concat(F.lit("t"), i % 7).alias("topic"), ((i * 37 % 101).cast("double") / 100).alias("score"))
    two = docs(spark, d).where("doc_id % 5 <> doc_id % 7").select(i.alias("memory_id"), F.concat(F.lit("t"), i % 5).alias("topic"), ((i * 53 % 101).cast("double") / 100).alias("score"))
    related = spark.createDataFrame([(f"t{a}", f"t{(a + b) % 7}") for a in range(7) for b in range(1, 4)], "topic string, related string")
    return T.predict_topics(one.unionAll(two).distinct(), related)


@query(view_sql("memories") + f", t as (select memory_id as query_id, user_id, unnest(['tag' || (memory_id % 6), 'the', 'que']) as term from memories where memory_id % 20 = 0), h as (select query_id, m.memory_id, (case when contains(lower(raw), term) then 0.3::double else 0 end + case when list_contains(tags, term) then 0.2::double else 0 end) * confidence * greatest(0.1::double, 1 - epoch(timestamp '{NOW}' - created_at) / 86400 / 14) * greatest(0.1::double, 1 - 0.2::double * retrieval_count) as s from t join memories m using (user_id)), g as (select query_id, memory_id, round(sum(s), 6) as salience from h group by 1, 2 having round(sum(s), 6) >= 0.05::double) select query_id, memory_id, salience, rank::int as rank from (select *, row_number() over (partition by query_id order by salience desc, memory_id) as rank from g) where rank <= 3")
def insight_salience(spark, d):
    m = view(spark, d, "memories")
    terms = m.where("memory_id % 20 = 0").select(F.col("memory_id").alias("query_id"), "user_id", F.explode(F.array(F.concat(F.lit("tag"), F.col("memory_id") % 6), F.lit("the"), F.lit("que"))).alias("term"))
    return T.insight_salience(m.withColumn("shown", F.col("retrieval_count")), terms, NOW)


# Whole texts that name a day, and some that don't.
DATED = [
    "2024-02-29", "2024-02-30", "2023-11-05T10:30:00", "today", " Now ", "yesterday", "Tomorrow", "3 days ago", "a week ago", "2 months ago", "1 year ago", "last month", "last year",
    "this week", "this month", "this year", "last Wednesday", "on friday", "Wednesday", "February 1st, 2026", "Feb 30 2026", "3rd of may", "1 Sept, 2025", "june 2025", "13/12/2024", "12/31/2024",
    "2-3-2021", "May 4 1850", "", "no date at all",
]


def _date_sql() -> str:
    day, form = "date '2024-01-31'", {k: "'" + p + "'" for k, p in T.DATE_FORMS.items()}
    got = lambda k, i: f"regexp_extract(t, {form[k]}, {i})"
    month = lambda c: f"nullif(coalesce(list_position({T.MONTHS!r}, ({c})[1:3]), 0), 0)"
    n = f"case when {got('ago', 1)} in ('a', 'an', 'one') then 1 else try_cast({got('ago', 1)} as int) end"
    back = lambda n, u: f"case {u} when 'day' then {day} - ({n}) when 'week' then {day} - ({n}) * 7 when 'month' then ({day} - to_months({n}))::date when 'year' then ({day} - to_months(12 * ({n})))::date end"
    i = lambda c: f"try_cast({c} as int)"
    made = lambda y, m, d, named=True: f"case when ({m}) between 1 and 12 and ({d}) between 1 and 31" + (f" and {y} between 1900 and 2100" if named else "") + f" then make_date({y}, ({m})::int, 1) + ({d} - 1) end"
    since = lambda k: f"((dayofweek({day}) + 1 - list_position({T.WEEK_DAYS!r}, {got(k, 1)}) + 7) % 7)::int"
    rules = [
        ("regexp_matches(t, '^[0-9]{4}-[0-9]{2}-[0-9]{2}($|[t ][0-9]{2}:[0-9]{2})')", "try_cast(t[1:10] as date)"), ("t in ('today', 'now')", day), ("t = 'yesterday'", f"{day} - 1"), ("t = 'tomorrow'", f"{day} + 1"),
        ("ago", back(n, got("ago", 2))), ("last", back("1", got("last", 1))), ("this", f"case {got('this', 1)} when 'week' then {day} - dayofweek({day})::int else date_trunc({got('this', 1)}, {day})::date end"),
        ("last_day", f"{day} - case when {since('last_day')} = 0 then 7 else {since('last_day')} end"), ("on_day", f"{day} - {since('on_day')}"),
        ("month_first", made(i(got("month_first", 3)), month(got("month_first", 1)), i(got("month_first", 2)))), ("day_first", made(i(got("day_first", 3)), month(got("day_first", 2)), i(got("day_first", 1)))),
        ("month_only", made(i(got("month_only", 2)), month(got("month_only", 1)), "1")), ("numbers", made(i(got("numbers", 3)), i(got("numbers", 1)), i(got("numbers", 2)), False)),
    ]
    case = "case " + " ".join(f"when {f'regexp_matches(t, {form[c]})' if c in form else c} then {v}" for c, v in rules) + " end"
    return f"with s as (select doc_id, lower(trim({DATED!r}[(doc_id % {len(DATED)}) + 1])) as t from documents) select doc_id, strftime(({case})::date, '%Y-%m-%d') as day from s"


@query(_date_sql())
def parse_date(spark, d):
    said = F.element_at(F.array(*map(F.lit, DATED)), (F.col("doc_id") % len(DATED) + 1).cast("int"))
    return docs(spark, d).select("doc_id", T.parse_date(said, "2024-01-31 15:30:00").cast("string").alias("day"))


@query(None)
def segments(spark, d):
    return segmenting.segments(docs(spark, d))
