"""Signals, labels and contexts drawn from texts, and imports by a column mapping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators.analytics import at, count_if
from loomwork.operators.scoring import ranked
from loomwork.operators.texts import CORRECTION_SIGNS, EXPLICIT_SIGNS, PREFERENCE_SIGNS, any_of, java, matches


def _found(text: Column, pattern: str) -> Column:
    """The first match, null without one."""
    return F.nullif(F.regexp_extract(text, java(pattern), 0), F.lit(""))


def _sentence(text: Column, pattern: str) -> Column:
    """The run without . ! ? around the start of the first match."""
    before = F.regexp_extract(text, "(?s)" + java(f"^(.*?)(?:{pattern})"), 1)
    rest = F.substring(text, F.length(before) + 1, F.length(text))
    return F.trim(F.concat(F.regexp_extract(before, r"([^.!?]*)\z", 1), F.regexp_extract(rest, r"^([^.!?]*)", 1)))


# Kind, its patterns, confidence, the trigger that raises it, the raised confidence.
SIGNALS = [
    ("explicit", EXPLICIT_SIGNS, 0.9, r"never\s+forget|critical", 0.95),
    ("correction", CORRECTION_SIGNS, 0.85, None, None),
    ("preference", PREFERENCE_SIGNS, 0.75, "always|never|hate|love", 0.85),
]
SHORT_TEXT, SHORT_FACTOR = 20, 0.8


def importance_signals(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, kind, trigger, sentence, confidence): for each kind the first pattern, in order, that a turn matches.

    Preferences count in user turns only; texts under 20 characters have 0.8 of the confidence. A null text has no signal.
    """
    text = F.coalesce("text", F.lit(""))
    options = []
    for kind, patterns, base, raising, raised in SIGNALS:
        trigger = F.coalesce(*[_found(text, p) for p in patterns])
        sentence = F.coalesce(*[F.when(_found(text, p).isNotNull(), _sentence(text, p)) for p in patterns])
        confidence = F.when(matches(trigger, raising), raised).otherwise(base) if raising else F.lit(base)
        told = trigger if kind != "preference" else F.when(F.col("role") == "user", trigger)
        options.append(F.struct(F.lit(kind).alias("kind"), told.alias("trigger"), sentence.alias("sentence"), confidence.alias("confidence")))
    rows = turns.where(any_of(text, [p for _, ps, *_ in SIGNALS for p in ps])).withColumn("s", F.explode(F.array(*options))).where("s.trigger is not null")
    factor = F.when(F.length(text) < SHORT_TEXT, SHORT_FACTOR).otherwise(1.0)
    return rows.select("conv_id", "turn", "s.kind", "s.trigger", "s.sentence", F.round(F.col("s.confidence") * factor, 6).alias("confidence"))


# What passing status reports look like.
STATUS_SIGNS = [
    r"\b\d+\s+(?:in[- ]progress|in review|blocked|to[- ]?do|done|queued|open)\b",
    r"\b\d+\s+(?:open\s+)?(?:tickets?|prs?|pull requests?|issues?|tasks?|jobs?|runs?)\b[^.]{0,40}\b(?:in[- ]progress|in review|blocked|open|pending|to[- ]?do|done|closed|running|queued|failing)\b",
    r"\b(?:currently|presently|right now|at the moment)\s+(?:working on|running|blocked|in progress|reviewing|monitoring|testing|waiting|investigating|fixing)\b",
    r"\bis (?:now|currently) (?:working|running|monitoring|testing|reviewing|waiting|investigating|fixing)\b",
    r"\b(?:right now|at the moment|as of (?:right )?now)\b",
]
USER_SUBJECT = r"^\s*(?:the user|user)(?:'s)?\b"


def formation_guard(facts: DataFrame, turns: DataFrame, drop_assistant: bool = False) -> DataFrame:
    """(fact_id, keep, reason): facts that are status chatter, or tell of the user with only assistant turns behind them, go.

    facts(fact_id, conv_id, content, cites array), turns(conv_id, turn, role). A fact that cites no turn of its conversation stands
    on all of them. An assistant's fact about the user stays if the user spoke before the last turn that it cites.
    """
    whole = turns.groupBy("conv_id").agg(F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("first_user"), F.max("turn").alias("last_turn"), F.bool_and(F.col("role") == "assistant").alias("all_assistant"))
    cited = facts.select("fact_id", "conv_id", F.explode("cites").alias("turn")).join(turns.select("conv_id", "turn", "role"), ["conv_id", "turn"])
    cited = cited.groupBy("fact_id").agg(F.max("turn").alias("last_cited"), F.bool_and(F.col("role") == "assistant").alias("cited_assistant"))
    rows = facts.join(whole, "conv_id", "left").join(cited, "fact_id", "left")
    assistant = F.coalesce("cited_assistant", "all_assistant", F.lit(True))
    spoke = F.coalesce(F.col("first_user") < F.coalesce("last_cited", "last_turn"), F.lit(False))
    reason = F.when(any_of(F.col("content"), STATUS_SIGNS), "status_chatter")
    if drop_assistant:
        reason = reason.when(assistant, "assistant_only")
    reason = reason.when(assistant & ~spoke & matches(F.col("content"), USER_SUBJECT), "user_subject_from_assistant")
    return rows.select("fact_id", reason.isNull().alias("keep"), reason.alias("reason"))


def topic_context(current: DataFrame, recent: DataFrame, n: int = 3, boost: float = 1.15, sure: float = 0.7, carried: float = 0.2) -> DataFrame:
    """(memory_id, topic, score): scores of current(memory_id, topic, score) smoothed by the first n of recent(memory_id, topic, confidence, rank).

    A topic found again gains by `boost`; one not found now is carried at a fixed score if its confidence was over `sure`.
    """
    before = recent.where(F.col("rank") <= n).select("memory_id", "topic", "confidence")
    rows = current.where("score > 0").join(before, ["memory_id", "topic"], "full_outer")
    score = F.when(F.col("score").isNull(), F.when(F.col("confidence") > sure, carried)).when(F.col("confidence").isNull(), F.col("score")).otherwise(F.col("score") * boost)
    return rows.select("memory_id", "topic", F.round(score, 6).alias("score")).where("score is not null")


def time_distance(time: Column, now: str) -> Column:
    """The distance of a time to now in words, rounded to minutes, hours, days, months or years; `in ...` ahead of now."""
    end = at(now)
    m = F.floor(F.abs(F.unix_timestamp(end) - F.unix_timestamp(time)) / 60 + 0.5)
    near = lambda unit: F.floor(m / unit + 0.5)
    text = lambda lead, n, word: F.concat(F.lit(lead), n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    low, high = F.least(time, end), F.greatest(time, end)
    months = F.timestamp_diff("MONTH", low, high)
    years, rest = F.floor(months / 12), months % 12
    words = (
        F.when(m < 1, "less than a minute").when(m < 45, text("", m, "minute")).when(m < 90, "about 1 hour").when(m < 1440, text("about ", near(60), "hour"))
        .when(m < 2520, "1 day").when(m < 43200, text("", near(1440), "day")).when(m < 86400, text("about ", near(43200), "month"))
        .when(months < 12, text("", near(43200), "month")).when(rest < 3, text("about ", years, "year")).when(rest < 9, text("over ", years, "year"))
        .otherwise(text("almost ", years + 1, "year"))
    )
    return F.when(time > end, F.concat(F.lit("in "), words)).otherwise(F.concat(words, F.lit(" ago")))


def enrich_text(memories: DataFrame, entities: DataFrame, now: str, most: int = 5, critical: float = 0.9, high: float = 0.7) -> DataFrame:
    """(memory_id, enriched): the text behind its date, its first entities and its importance.

    memories(memory_id, raw, created_at, effective, importance, safety_critical), entities(memory_id, place, name).
    """
    first = ranked(entities, ["memory_id"], [F.col("place"), F.col("name")], most)
    names = first.groupBy("memory_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda r: r["name"]), ", ").alias("names"))
    score = F.coalesce("effective", "importance")
    band = F.when((score >= critical) | F.col("safety_critical"), "[Critical importance]").when(score >= high, "[High importance]")
    when = F.concat(F.lit("[Time: "), F.date_format("created_at", "MMMM d, yyyy"), F.lit(", "), time_distance(F.col("created_at"), now), F.lit("]"))
    prefix = F.concat_ws(" ", when, F.concat(F.lit("[About: "), F.col("names"), F.lit("]")), band)
    rows = memories.join(names, "memory_id", "left")
    return rows.select("memory_id", F.concat(F.when(prefix == "", "").otherwise(F.concat(prefix, F.lit("\n\n"))), F.coalesce("raw", F.lit(""))).alias("enriched"))


# Phrases of a capability with their confidence, of a preference with its strength, and words of categories. In them a dot is
# any character of a line, and $ the end of the text; the engines read both differently, see of_line.
CAPABILITIES = [
    (r"successfully\s+(.{5,80}?)(?:\.|,|$)", 0.8),
    (r"(?:built|created|developed|implemented|deployed|shipped|launched)\s+(.{5,80}?)(?:\.|,|$)", 0.7),
    (r"(?:fixed|resolved|debugged|patched)\s+(.{5,80}?)(?:\.|,|$)", 0.7),
    (r"(?:configured|set up|integrated)\s+(.{5,80}?)(?:\.|,|$)", 0.6),
    (r"(?:migrated|upgraded|optimized)\s+(.{5,80}?)(?:\.|,|$)", 0.7),
    (r"(?:proficient|skilled|experienced|expert)\s+(?:in|with|at)\s+(.{3,80}?)(?:\.|,|$)", 0.9),
]
PREFERENCES = [
    (r"\bi\s+prefer\s+(.{3,100}?)(?:\.|,|$)", "strong"),
    (r"\balways\s+(?:use|uses?)\s+(.{3,80}?)(?:\.|,|$)", "strong"),
    (r"\bnever\s+(?:use|uses?)\s+(.{3,80}?)(?:\.|,|$)", "strong"),
    (r"\bi?\s*(?:don't|doesn't|do not)\s+like\s+(.{3,80}?)(?:\.|,|$)", "moderate"),
    (r"\bi?\s*(?:like|enjoy)\s+(.{3,80}?)(?:\.|,|$)", "moderate"),
    (r"\bfavorite\s+(?:\w+\s+)?is\s+(.{3,80}?)(?:\.|,|$)", "strong"),
    (r"\busually\s+(.{3,80}?)(?:\.|,|$)", "weak"),
]
CATEGORIES = [
    ("tooling", r"\b(code|programming|language|framework|library|tool|editor|ide)\b"), ("interface", r"\b(ui|ux|design|theme|dark|light|color|font)\b"),
    ("food", r"\b(coffee|tea|food|drink|meal)\b"), ("communication", r"\b(communicate|email|slack|message|call|meeting)\b"),
    ("workflow", r"\b(deploy|ci|cd|pipeline|workflow|process)\b"),
]


def of_line(pattern: str) -> str:
    """A pattern of phrases for Java's engine and the oracle's: their dots leave out different line ends, and Java's $ stands before a last line end too."""
    return pattern.replace("(.{", r"([^\n]{").replace("$)", r"\z)")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that f names several times: Spark would work it out anew at each."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _phrases(text: Column, rules: list[tuple[str, object]], names: tuple[str, str]) -> Column:
    """array of (phrase, value) for the rules that match, in order; of phrases alike in lower case the first."""
    found = [(F.trim(F.regexp_extract(text, java(of_line(p)), 1)), matches(text, of_line(p)), v) for p, v in rules]
    every = F.array_compact(F.array(*[F.when(hit, F.struct(got.alias(names[0]), F.lit(v).alias(names[1]))) for got, hit, v in found]))
    low = lambda rows: F.transform(rows, lambda r: F.lower(r[names[0]]))
    # one pass for what stands before the phrases spares most texts the rules
    some = any_of(text, [p.partition("(.{")[0] for p, _ in rules])
    return once(F.when(some, every).otherwise(F.array().cast(f"array<struct<{names[0]}:string,{names[1]}:{'string' if isinstance(rules[0][1], str) else 'double'}>>")), lambda rows: F.filter(rows, lambda r, i: ~F.array_contains(F.slice(low(rows), F.lit(1), i), F.lower(r[names[0]]))))


def capability_signals(text: Column) -> Column:
    """array of (capability, confidence) that a text claims."""
    return _phrases(F.coalesce(text, F.lit("")), CAPABILITIES, ("capability", "confidence"))


def preference_category(text: Column) -> Column:
    return F.coalesce(*[F.when(matches(text, p), name) for name, p in CATEGORIES], F.lit("general"))


def preference_signals(text: Column, memory_type: Column) -> Column:
    """array of (preference, strength); a text of type PREFERENCE without such phrases is one itself, by its first 150 characters."""
    text = F.coalesce(text, F.lit(""))
    found = _phrases(text, PREFERENCES, ("preference", "strength"))
    own = F.array(F.struct(F.substring(text, 1, 150).alias("preference"), F.lit("moderate").alias("strength")))
    return once(found, lambda rows: F.when((F.size(rows) == 0) & F.coalesce(memory_type == "PREFERENCE", F.lit(False)), own).otherwise(rows))


# Words that put a memory under a heading of its project's state, and an issue's severity.
STATE_SIGNS = {
    "goal": r"\b(goal|objective|target|aim|milestone|deliverable|accomplish)\b",
    "decision": r"\b(decid\w*|decision|chose|chosen|agreed|resolved|went with|picked|settled on)\b",
    "issue": r"\b(bug|issue|problem|blocker|broken|fail|error|regression|crash|stuck)\b",
    "outcome": r"\b(result|outcome|success|completed|shipped|launched|deployed|achieved|finished|done)\b",
}
SEVERITY = [("critical", r"\b(critical|crash|data.?loss|security|blocker)\b"), ("high", r"\b(broken|fail|regression|major)\b"), ("medium", r"\b(bug|error|issue|problem)\b")]


def project_labels(memories: DataFrame) -> DataFrame:
    """(project_id, memory_id, label, severity): a row for each heading a memory falls under; insights fall under theirs alone."""
    text = F.col("raw")
    labels = F.array_compact(F.array(*[F.when(matches(text, p), name) for name, p in STATE_SIGNS.items()]))
    labels = F.when(F.coalesce(F.col("layer") == "INSIGHT", F.lit(False)), F.array(F.lit("insight"))).otherwise(labels)
    severity = F.coalesce(*[F.when(matches(text, p), name) for name, p in SEVERITY], F.lit("low"))
    rows = memories.select("project_id", "memory_id", F.explode(labels).alias("label"), severity.alias("severity"))
    return rows.withColumn("severity", F.when(F.col("label") == "issue", F.col("severity")))


def project_state(memories: DataFrame, now: str, enough: int = 50, fresh_days: int = 30) -> DataFrame:
    """(project_id, total, last_activity, counts of the headings, critical, confidence) of every project.

    Confidence: .4 for `enough` memories, .3 for activity just now falling to none in `fresh_days`, .3 for the share of headings in use.
    """
    names = [*STATE_SIGNS, "insight"]
    counts = project_labels(memories).groupBy("project_id").agg(*[count_if(F.col("label") == n).alias(f"{n}s") for n in names], count_if(F.col("severity") == "critical").alias("critical"))
    whole = memories.groupBy("project_id").agg(F.count("*").alias("total"), F.max("created_at").alias("last_activity"))
    rows = whole.join(counts, "project_id", "left").fillna(0, [*[f"{n}s" for n in names], "critical"])
    days = (F.unix_timestamp(at(now)) - F.unix_timestamp("last_activity")) / 86400
    filled = sum((F.col(f"{n}s") > 0).cast("int") for n in names)
    confidence = F.least(F.col("total") / enough, F.lit(1.0)) * 0.4 + F.coalesce(F.greatest(F.lit(0.0), 1 - days / fresh_days), F.lit(0.0)) * 0.3 + filled / len(names) * 0.3
    return rows.withColumn("confidence", F.round(confidence, 2))


def recent_activity(memories: DataFrame, now: str, days: int = 7, k: int = 20) -> DataFrame:
    """(project_id, memory_id, rank): each project's newest k memories of the last days."""
    rows = memories.where(F.col("created_at") >= at(now) - F.expr(f"interval {days} days"))
    return ranked(rows, ["project_id"], [F.col("created_at").desc(), F.col("memory_id")], k).select("project_id", "memory_id", "rank")


def memory_attribution(memories: DataFrame, sessions: DataFrame, calls: DataFrame, members: DataFrame, n: int = 100) -> DataFrame:
    """(memory_id, agent, accesses array of (event_id, agent) newest first, pools): who made a memory, its last n accesses, its pools.

    memories(memory_id, session_id), sessions(session_id, agent), calls(memory_id, event_id, ts, agent), members(memory_id, pool_id).
    """
    newest = ranked(calls, ["memory_id"], [F.col("ts").desc(), F.col("event_id").desc()], n)
    log = newest.groupBy("memory_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "event_id", "agent"))), lambda r: F.struct(r["event_id"].alias("event_id"), r["agent"].alias("agent"))).alias("accesses"))
    pools = members.groupBy("memory_id").agg(F.sort_array(F.collect_set("pool_id")).alias("pools"))
    rows = memories.select("memory_id", "session_id").join(sessions.select("session_id", "agent"), "session_id", "left").join(log, "memory_id", "left").join(pools, "memory_id", "left")
    return rows.select("memory_id", "agent", "accesses", "pools")


# Kinds of imported profiles, the first of them the default.
ENTITY_KINDS = ["PERSON", "ORGANIZATION", "PROJECT", "BRAND", "PRODUCT"]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of CSV files with headers, all strings, with a column `row` that rises within a file."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False).withColumn("row", F.monotonically_increasing_id())


def missing_headers(columns: list[str], mapping: dict) -> list[str]:
    """What a mapping takes from columns that aren't there; kinds and numbers stand for themselves."""
    wanted = [mapping.get(k) for k in ("name", "kind", "description", "content", "importance")] + [c for c, _ in mapping.get("attributes", [])]
    fixed = lambda v: v.upper() in ENTITY_KINDS or v.replace(".", "", 1).isdigit()
    loose = {mapping.get("name"), mapping.get("kind"), mapping.get("description"), mapping.get("importance")}
    return list(dict.fromkeys(v for v in wanted if v and v not in columns and not (v in loose and fixed(v))))


def map_import(rows: DataFrame, mapping: dict) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Profiles(row, name, kind, description), attributes(row, key, value), memories(row, content, importance), errors(row, message).

    mapping: name, and if wanted kind, description, content, importance, each a column of rows or, failing that, a value that stands
    for itself, and attributes, a list of (column, key). Rows without a name are errors and give nothing else; an unknown kind is
    an error and becomes PERSON; an importance outside 1 to 5 is an error and becomes null. Empty attributes and contents are left out.
    """
    given = lambda k: F.lit(None).cast("string") if not mapping.get(k) else F.col(f"`{mapping[k]}`") if mapping[k] in rows.columns else F.lit(mapping[k])
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    number = given("importance").try_cast("double")
    wrong_kind = ~blank(given("kind")) & ~F.upper(given("kind")).isin(ENTITY_KINDS)
    wrong_number = F.coalesce(given("importance"), F.lit("")).isin("") == F.lit(False)
    wrong_number = wrong_number & ~blank(given("content")) & ~F.coalesce(number.between(1, 5), F.lit(False))
    messages = F.array_compact(F.array(F.when(blank(given("name")), "name is required"), F.when(wrong_kind, "unknown kind"), F.when(wrong_number, "importance must be 1 to 5")))
    errors = rows.select("row", F.explode(messages).alias("message"))
    named = rows.where(~blank(given("name")))
    kind = F.when(F.upper(given("kind")).isin(ENTITY_KINDS), F.upper(given("kind"))).otherwise(ENTITY_KINDS[0])
    profiles = named.select("row", F.trim(given("name")).alias("name"), kind.alias("kind"), F.nullif(given("description"), F.lit("")).alias("description"))
    pairs = [F.struct(F.lit(key).alias("key"), F.trim(F.col(f"`{c}`")).alias("value")) for c, key in mapping.get("attributes", [])]
    none = F.array().cast("array<struct<key:string,value:string>>")
    attributes = named.select("row", F.explode(F.array(*pairs) if pairs else none).alias("a")).select("row", "a.key", "a.value").where("value <> ''")
    rounded = F.when(number.between(1, 5), F.floor(number + 0.5).cast("int"))
    memories = named.where(~blank(given("content"))).select("row", F.trim(given("content")).alias("content"), rounded.alias("importance"))
    return profiles, attributes, memories, errors


def write_export(df: DataFrame, path: str, fmt: str = "ndjson") -> None:
    """Writes rows as files of JSON lines (ndjson) or CSV with headers; in CSV, columns that nest are JSON texts."""
    if fmt == "csv":
        nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
        df.withColumns({c: F.to_json(c) for c in nested}).write.csv(path, header=True, escape='"', mode="errorifexists")
    elif fmt == "ndjson":
        df.write.json(path, mode="errorifexists")
    else:
        raise ValueError(f"format {fmt} is neither ndjson nor csv")
