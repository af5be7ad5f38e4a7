"""Text classification and parsing by ordered patterns, as Columns.

Patterns mean what they mean in ASCII: a word is letters, digits and underscores of ASCII, whatever stands beside it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern outside of its brackets, up to a bracket that closes more than it holds."""
    depth, cuts, end = 0, [], len(pattern)
    for m in re.finditer(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", pattern, re.S):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if depth < 0:
            end = m.start()
            break
        if m[0] == "|" and not depth:
            cuts.append(m.start())
    return [pattern[i:j] for i, j in zip([0, *[c + 1 for c in cuts]], [*cuts, end], strict=True)]


def _starts_a_word(pattern: str) -> bool:
    """Whether what a pattern matches surely begins with a letter or digit of ASCII; False where that is not plain to see."""
    if pattern[:1] == "(":
        inner = pattern[3:] if pattern.startswith("(?:") else pattern[1:]
        every = _alternatives(inner)
        behind = inner[len("|".join(every)) + 1 :]
        return not inner.startswith("?") and behind[:1] not in ("?", "*", "{") and all(map(_starts_a_word, every))
    return bool(re.match(r"[A-Za-z0-9](?![?*{])", pattern))


def java(pattern: str) -> str:
    """The pattern for Java's engine, letters in either case; \\b is an edge of an ASCII word.

    Before a letter an edge is a place without a word before it. That is one look back instead of four looks around at each place of a text.
    """
    edge = lambda m: "(?<![A-Za-z0-9_])" if _starts_a_word(pattern[m.end() :]) else _EDGE
    return "(?i)" + re.sub(r"\\b", edge, pattern)


def matches(text: Column, pattern: str) -> Column:
    """Whether the pattern, whose \\b is an edge of an ASCII word, is found, letters in either case."""
    return F.coalesce(text, F.lit("")).rlike(java(pattern))


def any_of(text: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns is found; an edge that all begin with is looked for once at each place, not once for each pattern."""
    if all(p.startswith(r"\b") and len(_alternatives(p)) == 1 for p in patterns):
        return matches(text, r"\b(?:" + "|".join(p[2:] for p in patterns) + ")")
    return matches(text, "|".join(f"(?:{p})" for p in patterns))


# Layers in order, with the patterns that tell them.
LAYER_PATTERNS = {
    "TASK": [
        r"\b(remind me|reminder|todo|to-do|to do list)\b", r"\b(remember to)\b", r"\b(don't forget|do not forget)\b", r"\b(follow up|follow-up|followup)\b",
        r"\b(action item)\b", r"\b(schedule|appointment)\b.*\b(for|at|on|with)\b",
        r"\b(book)\b\s+\b(a|an|the)\b\s+\b(meeting|appointment|session|call|flight|reservation|hotel|room|table)\b",
    ],
    "IDENTITY": [
        r"\b(prefer|prefers|always|never|favorite|hate|hates|love|loves)\b", r"\b(born|birthday|age|years? old)\b", r"\b(live|lives|from|hometown|grew up)\b",
        r"\b(name is|called|known as|go by)\b",
        r"\b(wife|husband|spouse|daughters?|sons?|family|mother|father|parents?|siblings?|brothers?|sisters?|child|children)\b",
        r"\b(work at|works at|job|profession|career|employed|employer|occupation)\b", r"\b(allergic|allergy|allergies|intolerant|intolerance)\b",
        r"\b(believe|believes|religion|faith)\b", r"\b(hobby|hobbies|passionate about)\b", r"\b(timezone|time zone|located in)\b", r"\bi (am|'m) a\b",
        r"\bmy (name|birthday|job|wife|husband|family)\b",
    ],
    "PROJECT": [
        r"\b(project|projects)\b", r"\b(building|developing|implementing|working on)\b", r"\b(repo|repository|codebase|branch)\b",
        r"\b(deadline|due date|milestone|sprint|release)\b", r"\b(feature|bug|issue|ticket|pr|pull request)\b", r"\b(deploy|deployment|production|staging)\b",
        r"\b(client|customer|stakeholder)\s+(wants|needs|requested)", r"\b(architecture|design doc|spec|specification)\b", r"\b(team|teammate|collaborator)\b",
    ],
}


# People who make a text about a person one about the user.
CLOSE_PEOPLE = r"\b(wife|husband|daughter|son|friend|colleague)\b"


def classify_layer(text: Column, memory_type: Column | None = None, entities: Column | None = None, who: Column | None = None) -> Column:
    """The layer of a text by patterns; where none is found, by its entities array<struct<type>>: a project or organisation makes it PROJECT, a person with `who` IDENTITY if the text names someone close."""
    out = F.lit("SESSION")
    if entities is not None:
        has = lambda *types: F.coalesce(F.exists(entities, lambda e: e["type"].isin(*types)), F.lit(False))
        close = has("person") & (F.lit(False) if who is None else F.coalesce(who != "", F.lit(False))) & any_of(text, [CLOSE_PEOPLE])
        out = F.when(has("project", "organization"), "PROJECT").when(close, "IDENTITY").otherwise(out)
    for layer in reversed(LAYER_PATTERNS):
        out = F.when(any_of(text, LAYER_PATTERNS[layer]), layer).otherwise(out)
    return out if memory_type is None else F.when(memory_type == "TASK", "TASK").otherwise(out)


# Types in order; a row is a type, the patterns that must all be found, and those that must not.
TYPE_RULES = [
    ("CONSTRAINT", [r"\b(allergic|allergy|allergies|intolerant|medication|medical|deadly|fatal)\b"], []),
    ("CONSTRAINT", [r"\b(must not|cannot|can't|never|forbidden|prohibited)\b", r"\b(eat|take|use|do|have)\b"], []),
    ("LESSON", [r"\b(that's wrong|that was wrong|you made a mistake|lesson learned|don't do that again)\b"], []),
    ("LESSON", [r"\b(actually|no,)\b", r"\b(wrong|incorrect|mistake|shouldn't have|should have)\b"], []),
    ("DECISION", [r"\b(decided|chose|went with|opted for|selected|decision was|made the call)\b"], []),
    ("OUTCOME", [r"\b(resulted in|outcome was|turned out|succeeded|failed|consequence was|end result)\b"], []),
    ("GOAL", [r"\b(goal is|want to|plan to|aim to|objective|aspire to|target is|working toward)\b"], []),
    ("TASK", [r"\b(remind|todo|task|need to|should|must|deadline|by tomorrow|by next)\b"], []),
    ("PREFERENCE", [r"\b(prefer|prefers|favorite|favourite|like|likes|love|loves|enjoy|enjoys|want|wants)\b"], []),
    ("PREFERENCE", [r"\b(always|usually|normally|every morning|every day)\b"], [r"\b(allergic|medical|cannot)\b"]),
    ("EVENT", [r"\b(yesterday|today|last week|recently|just now|this morning|earlier)\b"], []),
]


def classify_type(text: Column) -> Column:
    out = F.lit("FACT")
    for name, need, ban in reversed(TYPE_RULES):
        rule = F.lit(True)
        for p in need:
            rule = rule & matches(text, p)
        for p in ban:
            rule = rule & ~matches(text, p)
        out = F.when(rule, name).otherwise(out)
    return out


# Indicators of safety and their patterns. Alternatives without brackets keep their edge on one side only.
SAFETY_PATTERNS = [
    (r"\ballerg(y|ic|ies)\b", "allergy"), (r"\bmedication|medicine|prescription|drug\b", "medication"), (r"\bdiabet(es|ic)\b", "diabetes"),
    (r"\bepilepsy|seizures?\b", "seizure"), (r"\basthma|inhaler\b", "asthma"), (r"\bemergency contact\b", "emergency"), (r"\bblood type\b", "medical"),
    (r"\bdo not resuscitate|dnr\b", "medical_directive"), (r"\blife[- ]threatening\b", "critical"), (r"\bdeathly|fatal|deadly\b", "critical"),
    (r"\banaphy(laxis|lactic)\b", "allergy"), (r"\bepipen\b", "allergy"), (r"\bheart condition|cardiac\b", "medical"), (r"\bpacemaker\b", "medical"),
    (r"\bblood thinner|anticoagulant\b", "medication"), (r"\binsulin\b", "medication"),
]


def safety_flags(text: Column) -> Column:
    """The distinct indicators found, in the order of the patterns."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(matches(text, p), F.lit(i)) for p, i in SAFETY_PATTERNS])))


# Signs of a lasting statement.
PREFERENCE_SIGNS = [r"\bi prefer\b", r"\bi like\b", r"\bi love\b", r"\bi hate\b", r"\bi always\b", r"\bi never\b", r"\bmy favou?rite\b", r"\bi enjoy\b"]
FACT_SIGNS = [
    r"\bmy name is\b", r"\bi work at\b", r"\bi live in\b", r"\bmy daughter\b", r"\bmy son\b", r"\bmy wife\b", r"\bmy husband\b", r"\bmy partner\b",
    r"\bmy dog\b", r"\bi was born\b", r"\bmy job\b", r"\bmy goal is\b", r"\bi decided\b",
]


def durability(text: Column) -> Column:
    """DURABLE for a text of 30 characters or more with a preference, a fact, a capitalised word in mid-sentence or a number; else EPHEMERAL."""
    t = F.trim(F.coalesce(text, F.lit("")))
    sign = any_of(t, PREFERENCE_SIGNS + FACT_SIGNS) | t.rlike("[a-z,;] [A-Z][a-z]+") | t.rlike("[0-9]")
    return F.when((F.length(t) >= 30) & sign, "DURABLE").otherwise("EPHEMERAL")


# What tells a query's kind.
TEMPORAL_SIGNS = [
    r"\b(yesterday|today|tomorrow|last\s+(week|month|year|night|time))\b", r"\b(this\s+(week|month|year|morning|afternoon|evening))\b",
    r"\b(recent(ly)?|latest|newest|earlier|before|after|since|ago|during)\b", r"\b[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}\b",
    r"\b(january|february|march|april|may|june|july|august|september|october|november|december)\b",
    r"\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b", r"\b(when\s+did|when\s+was|how\s+long\s+ago)\b",
]
FACTUAL_SIGNS = [
    r"^(what|who|where|which|how\s+many|how\s+much)\b", r"\b(name|number|address|email|phone|date|price|cost|amount)\b",
    r"\b(zip\s*code|error\s*code|status\s*code|version\s*(number|id)?)\b",
]


def query_type(text: Column) -> Column:
    t = F.lower(F.trim(text))
    short = F.size(F.split(t, r"[ \t\r\n\f]+")) <= 6
    return F.when(any_of(t, TEMPORAL_SIGNS), "TEMPORAL").when(short & any_of(t, FACTUAL_SIGNS), "FACTUAL").otherwise("SEMANTIC")


# Words of success and failure.
SUCCESS_WORDS = r"\b(completed|succeeded|deployed|fixed|resolved|passed|shipped|merged|approved)\b"
FAILURE_WORDS = r"\b(failed|broke|crashed|error|bug|regression|reverted|rejected)\b"


def outcome(text: Column) -> Column:
    """True for words of success, false for words of failure, null for both or neither."""
    good, bad = matches(text, SUCCESS_WORDS), matches(text, FAILURE_WORDS)
    return F.when(good & ~bad, True).when(bad & ~good, False)


# Levels that a pattern votes for.
LEVEL_PATTERNS = [
    (r"\b(exact|specific|precisely|quote|verbatim)\b", ["L0"]), (r"\bwhat (was|is|are) the\b", ["L0", "L1"]),
    (r"\b(error code|command|syntax|api endpoint|url|path|value)\b", ["L0"]), (r"\b(said|told|mentioned|stated)\b", ["L0"]),
    (r"\b(explain|how does|why did|reasoning|because|reason for)\b", ["L1"]), (r"\b(relationship between|compare|difference|versus|vs\.?)\b", ["L1"]),
    (r"\b(context|background|overview)\b", ["L1", "L0"]), (r"\b(steps|process|procedure|how to)\b", ["L1"]),
    (r"\bwhat did we (discuss|talk about|cover)\b", ["L2", "L1"]), (r"\b(last|that|the) (session|conversation|meeting|call)\b", ["L2"]),
    (r"\b(summary of|summarize|recap)\b", ["L2", "L1"]), (r"\b(usually|always|never|tend to|prefer|habit)\b", ["L3", "L1"]),
    (r"\bwhat (do|does) .* (think about|feel about|prefer)\b", ["L3"]), (r"\b(philosophy|approach|style|pattern|theme)\b", ["L3", "L1"]),
    (r"\b(recurring|consistent|over time|historically)\b", ["L3"]),
]


def level_votes(text: Column) -> Column:
    """array of (level, votes) with votes, most first, then by level."""
    hits = {lv: F.lit(0) for lv in ("L0", "L1", "L2", "L3")}
    for p, levels in LEVEL_PATTERNS:
        hit = matches(text, p).cast("int")
        hits |= {lv: hits[lv] + hit for lv in levels}
    rows = F.array(*[F.struct((-n).alias("v"), F.lit(lv).alias("level")) for lv, n in hits.items()])
    return F.transform(F.filter(F.array_sort(rows), lambda x: x["v"] < 0), lambda x: F.struct(x["level"].alias("level"), (-x["v"]).alias("votes")))


# Signs of importance in a turn.
EXPLICIT_SIGNS = [
    r"\bremember\s+this\b", r"\bdon'?t\s+forget\b", r"\bnever\s+forget\b", r"\bimportant\s*[:!]", r"\bthis\s+is\s+important\b", r"\bkeep\s+in\s+mind\b",
    r"\bnote\s+that\b", r"\bmake\s+sure\s+(to\s+)?remember\b", r"\balways\s+remember\b", r"\bcritical\s*[:!]", r"\bfyi\b", r"\bheads\s*up\b",
]
CORRECTION_SIGNS = [
    r"\bactually\b", r"\bno,?\s+that'?s?\s+(not\s+)?(wrong|right|correct)\b", r"\bi\s+meant\b", r"\bi\s+mean\b", r"\blet\s+me\s+correct\b", r"\bcorrection\s*[:!]?\b",
    r"\bto\s+be\s+clear\b", r"\bto\s+clarify\b", r"\bwhat\s+i\s+(really\s+)?meant\b", r"\bi\s+should\s+have\s+said\b", r"\bsorry,?\s+i\s+meant\b",
    r"\bthat'?s?\s+not\s+what\s+i\s+(meant|said)\b",
]


def importance_signs(text: Column) -> Column:
    return F.array_compact(F.array(F.when(any_of(text, EXPLICIT_SIGNS), "explicit"), F.when(any_of(text, CORRECTION_SIGNS), "correction"), F.when(any_of(text, PREFERENCE_SIGNS), "preference")))


def repeated_concepts(turns: DataFrame, least: int = 2) -> DataFrame:
    """(conv_id, concept, turns, confidence): capitalised or quoted concepts in several user turns, min(.6 + .1 n, .9)."""
    quoted, named = F.regexp_extract_all("text", F.lit('"([^"]+)"')), F.regexp_extract_all("text", F.lit("[a-z,;] ([A-Z][a-z]+)"))
    rows = turns.where("role = 'user'").select("conv_id", "turn", F.explode(F.array_distinct(F.concat(quoted, named))).alias("concept"))
    n = rows.groupBy("conv_id", F.lower("concept").alias("concept")).agg(F.countDistinct("turn").alias("turns")).where(F.col("turns") >= least)
    return n.withColumn("confidence", F.round(F.least(F.lit(0.9), 0.6 + 0.1 * F.col("turns")), 6))


def topics(texts: DataFrame, rules: DataFrame, least: float = 0.3, k: int = 5) -> DataFrame:
    """(memory_id, topic, score): a topic's best weight * min(matches / 2, 1), parents at 0.7 of it, the k best of `least` or more.

    rules(topic, parent, word, weight): words of rules meet the texts' words by equality.
    """
    words = texts.select("memory_id", F.explode(F.split(F.lower("raw"), "[^a-z0-9]+")).alias("word"))
    hits = words.join(rules, "word").groupBy("memory_id", "topic", "parent").agg(F.count("*").alias("n"), F.max("weight").alias("w"))
    own = hits.select("memory_id", "topic", "parent", (F.col("w") * F.least(F.col("n") / 2, F.lit(1.0))).alias("score"))
    both = own.select("memory_id", "topic", "score").unionAll(own.where("parent is not null").select("memory_id", "parent", 0.7 * F.col("score")))
    best = both.groupBy("memory_id", "topic").agg(F.round(F.max("score"), 6).alias("score")).where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("memory_id").orderBy(F.col("score").desc(), "topic"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def parse_time(text: Column, now: str) -> Column:
    """struct(start, end as epoch seconds, soft): the time phrase that the first fitting rule finds in a query; null fields without one.

    Rules are tried in order, so a phrase inside a longer one may win. Days are UTC, weeks start on Monday, ends are the last second.
    """
    t = F.lower(F.coalesce(text, F.lit("")))
    at, day = F.lit(now).cast("timestamp"), F.lit(now).cast("date")
    sec = lambda c: F.unix_timestamp(c.cast("timestamp"))
    number = lambda unit: F.regexp_extract(t, rf"(?<![a-z0-9_])([0-9]{{1,4}})\s+{unit}s?\s+ago(?![a-z0-9_])", 1)
    has = lambda p: matches(t, rf"\b({p})\b")

    def span(start: Column, end: Column, soft: bool = False) -> Column:
        return F.struct(sec(start).alias("start"), sec(end).alias("end"), F.lit(soft).alias("soft"))

    def one_day(offset: Column) -> Column:
        return F.struct(sec(F.date_add(day, offset)).alias("start"), (sec(F.date_add(day, offset + 1)) - 1).alias("end"), F.lit(False).alias("soft"))

    def last_days(n: Column, soft: bool = False) -> Column:
        return span(F.date_add(day, -n), at, soft)

    whole = lambda unit: F.try_to_number(number(unit), F.lit("9999")).cast("int")
    days_back = F.try_to_number(F.regexp_extract(t, r"(?<![a-z0-9_])(?:last|past)\s+([0-9]{1,4})\s+days?(?![a-z0-9_])", 1), F.lit("9999")).cast("int")
    ago = lambda unit, seconds: F.struct((sec(at) - whole(unit) * seconds).alias("start"), sec(at).alias("end"), F.lit(False).alias("soft"))
    month = F.add_months(day, -whole("month"))
    year = F.year(day) - whole("year")
    first_of = lambda y: F.make_date(y, F.lit(1), F.lit(1))
    rules = [
        (has("today|this morning|this afternoon|this evening|tonight"), one_day(F.lit(0))),
        (has("yesterday"), one_day(F.lit(-1))),
        (has("day before yesterday|two days ago|2 days ago"), one_day(F.lit(-2))),
        (number("hour") != "", ago("hour", 3600)),
        (number("minute") != "", ago("minute", 60)),
        (number("day") != "", one_day(-whole("day"))),
        (number("week") != "", one_day(-7 * whole("week"))),
        (number("month") != "", F.struct(sec(F.trunc(month, "month")).alias("start"), (sec(F.date_add(F.last_day(month), 1)) - 1).alias("end"), F.lit(False).alias("soft"))),
        (number("year") != "", F.struct(sec(first_of(year)).alias("start"), (sec(first_of(year + 1)) - 1).alias("end"), F.lit(False).alias("soft"))),
        (has(r"years\s+ago"), span(first_of(F.year(day) - 3), first_of(F.year(day) - 1))),
        (days_back.isNotNull(), last_days(days_back)),
        (has(r"(?:last|past)\s+week"), last_days(F.lit(7))),
        (has(r"this\s+week"), span(F.trunc(day, "week"), at)),
        (has(r"(?:last|past)\s+month"), last_days(F.lit(30), True)),
        (has(r"this\s+month"), span(F.trunc(day, "month"), at)),
        (has("recently|lately|recent"), last_days(F.lit(3), True)),
        (has("earlier today|earlier"), F.struct(sec(day).alias("start"), (sec(F.date_add(day, 1)) - 1).alias("end"), F.lit(True).alias("soft"))),
    ]
    out = F.lit(None).cast("struct<start: bigint, end: bigint, soft: boolean>")
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def observed_layer(text: Column, signs: Column) -> Column:
    """IDENTITY for a preference or a statement about oneself, PROJECT for project words, else SESSION; signs as importance_signs gives them."""
    about = matches(text, r"\bi (am|'m) a\b") | matches(text, r"\bmy (name|birthday|job|wife|husband|family)\b")
    return F.when(F.array_contains(signs, "preference") | about, "IDENTITY").when(any_of(text, LAYER_PATTERNS["PROJECT"]), "PROJECT").otherwise("SESSION")


def importance_band(score: Column) -> Column:
    return F.when(score >= 0.9, "critical").when(score >= 0.7, "high").when(score >= 0.5, "medium").otherwise("low")


def predict_topics(current: DataFrame, related: DataFrame, k: int = 3) -> DataFrame:
    """(memory_id, topic, confidence, rank): topics related to the current ones at half their score, none of them current, the k best."""
    rows = current.join(related, "topic").select("memory_id", F.col("related").alias("topic"), F.round(F.col("score") * 0.5, 6).alias("confidence"))
    new = rows.join(current.select("memory_id", "topic"), ["memory_id", "topic"], "left_anti").groupBy("memory_id", "topic").agg(F.max("confidence").alias("confidence"))
    rank = F.row_number().over(Window.partitionBy("memory_id").orderBy(F.col("confidence").desc(), "topic"))
    return new.withColumn("rank", rank).where(F.col("rank") <= k)


def insight_salience(insights: DataFrame, terms: DataFrame, now: str, k: int = 3, least: float = 0.05) -> DataFrame:
    """(query_id, memory_id, salience, rank): (.3 for each term in the text + .2 for each in the topics) * confidence * age and repetition factors.

    insights(memory_id, user_id, raw, tags, confidence, created_at, shown), terms(query_id, user_id, term): the stated queries against their user's insights.
    """
    from loomwork.operators.analytics import hours_before

    low = insights.withColumn("low", F.lower("raw"))
    days = hours_before(now, F.col("created_at")) / 24
    factor = F.col("confidence") * F.greatest(F.lit(0.1), 1 - days / 14) * F.greatest(F.lit(0.1), 1 - 0.2 * F.col("shown"))
    hit = F.when(F.contains("low", F.col("term")), 0.3).otherwise(0.0) + F.when(F.array_contains("tags", F.col("term")), 0.2).otherwise(0.0)
    # a user's queries with the same terms have the same insights, which are sought once
    sets = terms.groupBy("query_id", "user_id").agg(F.sort_array(F.collect_list("term")).alias("set"))
    asked = sets.select("user_id", "set").distinct()
    # a text is searched once for each of a user's terms
    hits = terms.select("user_id", "term").distinct().join(low, "user_id").select("user_id", "memory_id", "term", (hit * factor).alias("s")).where("s > 0")
    rows = asked.select("user_id", "set", F.explode("set").alias("term")).join(hits, ["user_id", "term"])
    rows = rows.groupBy("user_id", "set", "memory_id").agg(F.round(F.sum("s"), 6).alias("salience")).where(F.col("salience") >= least)
    rank = F.row_number().over(Window.partitionBy("user_id", "set").orderBy(F.col("salience").desc(), "memory_id"))
    best = rows.withColumn("rank", rank).where(F.col("rank") <= k)
    return sets.join(best, ["user_id", "set"]).select("query_id", "memory_id", "salience", "rank")


# Month names by their first three letters, week days from Sunday.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
WEEK_DAYS = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
_MONTH = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_DAY = r"([0-9]{1,2})(?:st|nd|rd|th)?"
DATE_FORMS = {
    "ago": r"^(a|an|one|[0-9]{1,4})\s+(day|week|month|year)s?\s+ago$", "last": r"^last\s+(week|month|year)$", "this": r"^this\s+(week|month|year)$",
    "last_day": "^last\\s+(" + "|".join(WEEK_DAYS) + ")$", "on_day": "^(?:on\\s+)?(" + "|".join(WEEK_DAYS) + ")$",
    "month_first": rf"^{_MONTH}\s+{_DAY},?\s+([0-9]{{4}})$", "day_first": rf"^{_DAY}\s+{_MONTH},?\s+([0-9]{{4}})$", "month_only": rf"^{_MONTH}\s+([0-9]{{4}})$",
    "numbers": r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})$",
}


def parse_date(text: Column, now: str) -> Column:
    """The date that a whole text names: ISO, relative words, week days, month names or m/d/y; null for other texts.

    Months and years ago end on the month's last day where it is shorter; days past a month's end run into the next. Weeks start on
    Sunday. A year outside 1900 to 2100 behind a month's name gives null.
    """
    t, day = F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit(now).cast("date")
    got = lambda form, i: F.regexp_extract(t, DATE_FORMS[form], i)
    is_form = lambda form: t.rlike(DATE_FORMS[form])
    months = F.array(*map(F.lit, MONTHS))
    month = lambda c: F.array_position(months, F.substring(c, 1, 3))
    number = lambda c: c.try_cast("int")

    def back(n: Column, unit: Column) -> Column:
        return F.when(unit == "day", F.date_sub(day, n)).when(unit == "week", F.date_sub(day, n * 7)).when(unit == "month", F.add_months(day, -n)).when(unit == "year", F.add_months(day, n * -12))

    def made(y: Column, m: Column, d: Column, named: bool = True) -> Column:
        ok = m.between(1, 12) & d.between(1, 31)
        return F.when(ok & (y.between(1900, 2100) if named else F.lit(True)), F.date_add(F.make_date(y, F.when(ok, m).cast("int"), F.lit(1)), d - 1))

    since = lambda form: (F.dayofweek(day) - F.array_position(F.array(*map(F.lit, WEEK_DAYS)), got(form, 1)) + 7) % 7
    period = got("this", 1)
    begun = F.when(period == "week", F.date_sub(day, F.dayofweek(day) - 1)).when(period == "month", F.trunc(day, "month")).when(period == "year", F.trunc(day, "year"))
    n = F.when(got("ago", 1).isin("a", "an", "one"), 1).otherwise(number(got("ago", 1)))
    return (
        F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}($|[t ][0-9]{2}:[0-9]{2})"), F.substring(t, 1, 10).try_cast("date"))
        .when(t.isin("today", "now"), day).when(t == "yesterday", F.date_sub(day, 1)).when(t == "tomorrow", F.date_add(day, 1))
        .when(is_form("ago"), back(n, got("ago", 2))).when(is_form("last"), back(F.lit(1), got("last", 1))).when(is_form("this"), begun)
        .when(is_form("last_day"), F.date_sub(day, F.when(since("last_day") == 0, 7).otherwise(since("last_day")).cast("int")))
        .when(is_form("on_day"), F.date_sub(day, since("on_day").cast("int")))
        .when(is_form("month_first"), made(number(got("month_first", 3)), month(got("month_first", 1)), number(got("month_first", 2))))
        .when(is_form("day_first"), made(number(got("day_first", 3)), month(got("day_first", 2)), number(got("day_first", 1))))
        .when(is_form("month_only"), made(number(got("month_only", 2)), month(got("month_only", 1)), F.lit(1)))
        .when(is_form("numbers"), made(number(got("numbers", 3)), number(got("numbers", 1)), number(got("numbers", 2)), False))
    )
