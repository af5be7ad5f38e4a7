"""Chunking, importing, exporting and incremental reading of memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.operators.dedup import content_hash
from loomwork.operators.predicates import scope_filter, time_range
from loomwork.session import written


def pack_parts(parts: Column, size: int, joint: str) -> Column:
    """array<string> of parts joined in order into chunks of at most `size` characters; a longer part is a chunk of its own."""
    state = "struct<done: array<string>, open: string>"
    zero = F.struct(F.array().alias("done"), F.lit(None).alias("open")).cast(state)

    def step(s: Column, x: Column) -> Column:
        fits = s["open"].isNotNull() & (F.length(s["open"]) + len(joint) + F.length(x) <= size)
        closed = F.when(s["open"].isNull() | fits, s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
        return F.struct(closed.alias("done"), F.when(fits, F.concat(s["open"], F.lit(joint), x)).otherwise(x).alias("open")).cast(state)

    folded = F.aggregate(parts, zero, step)
    return F.when(folded["open"].isNull(), folded["done"]).otherwise(F.concat(folded["done"], F.array(folded["open"])))


def sentences(text: Column) -> Column:
    """Sentences with their end marks: cut behind a full stop, question or exclamation mark and the white space after it."""
    return F.filter(F.split(text, r"(?<=[.!?])[ \t\r\n]+"), lambda s: F.trim(s) != "")


def chunk_text(docs: DataFrame, size: int = 3500) -> DataFrame:
    """(doc_id, chunk, text): paragraphs packed up to `size`; one that is longer is packed from its sentences."""
    paragraphs = F.filter(F.split(F.col("text"), r"\n+"), lambda p: F.trim(p) != "")
    parts = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(pack_parts(sentences(p), size, " "))))
    return docs.select("doc_id", F.posexplode(pack_parts(parts, size, "\n")).alias("chunk", "text"))


def chunk_overlap(docs: DataFrame, size: int = 1500, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk, text): sentences packed up to `size`, each chunk led by the last `overlap` characters of the one before."""
    rows = docs.select("doc_id", pack_parts(sentences(F.col("text")), size, " ").alias("cs"))
    led = F.transform("cs", lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.substr(F.get(F.col("cs"), i - 1), F.greatest(F.lit(1), F.length(F.get(F.col("cs"), i - 1)) - overlap + 1)), F.lit(" "), c)))
    return rows.select("doc_id", F.posexplode(led).alias("chunk", "text"))


def chunk_rounds(turns: DataFrame) -> DataFrame:
    """(conv_id, round, first_turn, turns, text): a user turn and what follows it up to the next; round 0 is what comes before the first."""
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    n = F.sum((F.col("role") == "user").cast("int")).over(by_turn.rowsBetween(Window.unboundedPreceding, 0))
    rows = turns.withColumn("round", n).groupBy("conv_id", "round").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("ts"))
    text = F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")
    return rows.select("conv_id", "round", F.get("ts", F.lit(0))["turn"].alias("first_turn"), F.size("ts").alias("turns"), text.alias("text"))


# A day that stands alone, without a letter or digit beside it.
_DAY = "([0-9]{4}-[0-9]{2}-[0-9]{2})(?![A-Za-z0-9_])"


def valid_day(text: Column, pattern: str) -> Column:
    """The day that the pattern's group finds first; null without one, and for days that no calendar has."""
    return F.regexp_extract(text, pattern, 1).try_cast("date")


def chunk_markdown(docs: DataFrame) -> DataFrame:
    """(doc_id, heading, heading_line, first_line, last_line, day, text): paragraphs between blank lines, with the heading they stand under.

    Lines count from 1. day: the one that the paragraph begins with, perhaps behind a list mark, else that of the last heading that has one,
    else docs.file_day (date), where there is such a column. A document without a paragraph, or without text, has no row.
    """
    file_day = F.col("file_day") if "file_day" in docs.columns else F.lit(None).cast("date")
    lines = docs.select("doc_id", file_day.alias("file_day"), F.posexplode(F.split("text", "\r?\n")).alias("line", "text"))
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    is_heading, blank = F.col("text").rlike("^ {0,3}#{1,6}[ \t]+"), F.col("text").rlike("^[ \t]*$")
    name = F.regexp_replace("text", "^ {0,3}#{1,6}[ \t]+", "")
    lines = lines.withColumns({
        "heading": F.last(F.when(is_heading, name), ignorenulls=True).over(w), "heading_line": F.last(F.when(is_heading, F.col("line") + 1), ignorenulls=True).over(w),
        "heading_day": F.last(F.when(is_heading, valid_day(F.col("text"), f"(?<![A-Za-z0-9_]){_DAY}")), ignorenulls=True).over(w), "part": F.sum((is_heading | blank).cast("int")).over(w),
    })
    rows = lines.where(~is_heading & ~blank).groupBy("doc_id", "part").agg(
        *[F.first(c).alias(c) for c in ("heading", "heading_line", "heading_day", "file_day")], F.sort_array(F.collect_list(F.struct("line", "text"))).alias("ls")
    )
    first, last = F.get("ls", F.lit(0)), F.element_at("ls", -1)
    day = F.coalesce(valid_day(first["text"], f"^[ \t]*(?:[-*][ \t]*)?{_DAY}"), "heading_day", "file_day")
    return rows.select("doc_id", "heading", "heading_line", (first["line"] + 1).alias("first_line"), (last["line"] + 1).alias("last_line"), day.alias("day"), F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("text"))


def ingest_email(mails: DataFrame, seen: DataFrame, allowed: list[str], agents: DataFrame, most: int = 500_000) -> DataFrame:
    """(event_id, agent_id, body): new mails of allowed senders (an address or @domain), text else html, cut at `most` characters.

    agents(local_part, agent_id): whom a recipient's local part means.
    """
    sender = F.lower("sender")
    ok = sender.isin([a for a in allowed if a[0] != "@"]) | F.concat(F.lit("@"), F.substring_index(sender, "@", -1)).isin([a for a in allowed if a[0] == "@"])
    rows = mails.where(ok).dropDuplicates(["event_id"]).join(seen, "event_id", "left_anti").withColumn("local_part", F.substring_index(F.lower("recipient"), "@", 1))
    return rows.join(agents, "local_part").select("event_id", "agent_id", F.substring(F.coalesce("text", "html", F.lit("")), 1, most).alias("body"))


def import_with_dedup(existing: DataFrame, incoming: DataFrame, quota: int) -> DataFrame:
    """Incoming rows(user_id, place, raw) whose text the user doesn't have, the first of equal ones, up to the quota in input order."""
    new = incoming.withColumn("h", content_hash(F.col("raw"))).join(existing.select("user_id", content_hash(F.col("raw")).alias("h")).distinct(), ["user_id", "h"], "left_anti")
    first = new.groupBy("user_id", "h").agg(F.min("place").alias("place"))
    kept = first.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("place"))).where(F.col("n") <= quota)
    return kept.select("user_id", "place", "n")


def incremental_pull(df: DataFrame, since: str, limit: int, time: str = "created_at", key: str = "memory_id") -> DataFrame:
    """(user_id, key, place, has_more): a user's rows changed after the watermark, in order, up to the limit; has_more if there are others."""
    rows = df.where(F.col(time) > F.lit(since).cast("timestamp")).withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(time, key))).where(F.col("place") <= limit + 1)
    more = F.max("place").over(Window.partitionBy("user_id")) > limit
    return rows.withColumn("has_more", more).where(F.col("place") <= limit).select("user_id", key, "place", "has_more")


def sanitize(text: Column) -> Column:
    """Html escapes of the five characters that need them, the ampersand first."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def temporal_anchor(df: DataFrame) -> DataFrame:
    """Adds anchor_source and warning: where the event time came from; historical rows without one are flagged."""
    has = F.col("observed_at").isNotNull()
    return df.withColumns({"anchor_source": F.when(has, "EXPLICIT_CALLER").otherwise("FALLBACK_RECORDED_AT"), "warning": ~has & (F.col("kind") == "HISTORICAL")})


def trajectory_feedback(memories: DataFrame, used: DataFrame, unused: DataFrame) -> DataFrame:
    """(memory_id, used_count, unused_count) after feedback rows(ids array, at); deleted memories stay as they are and are left out."""
    n = lambda df, name: df.select(F.explode("ids").alias("memory_id")).groupBy("memory_id").agg(F.count("*").alias(name))
    rows = memories.where("deleted_at is null").join(n(used, "u"), "memory_id", "left").join(n(unused, "x"), "memory_id", "left").where("u is not null or x is not null")
    return rows.select("memory_id", (F.col("used_count") + F.coalesce("u", F.lit(0))).alias("used_count"), (F.col("unused_count") + F.coalesce("x", F.lit(0))).alias("unused_count"))


#: Lists into which the pools of a user or an agent are dealt, so that none is one row of all.
POOL_BLOCKS = 64


def visible_pools(sessions: DataFrame, pools: DataFrame, grants: DataFrame) -> DataFrame:
    """(session_id, pool_id): a user's global pools, shared ones granted to the session, private ones it made or its agent was granted; not archived."""
    live = pools.where("not archived").select("pool_id", "user_id", "created_by", "kind").distinct()
    live = written(live.join(live.groupBy("pool_id").agg((F.count("*") == 1).alias("alone")), "pool_id"), "pools")
    s = sessions.select("session_id", "user_id", "agent").distinct()
    s = written(s.join(s.groupBy("session_id").agg((F.count("*") == 1).alias("single")), "session_id"), "sessions")
    private = live.where("kind = 'PRIVATE'").select("pool_id", "alone").distinct()
    by_agent = written(grants.where("grantee_kind = 'agent'").select(F.col("grantee").alias("agent"), "pool_id").distinct().join(private, "pool_id"), "agent-grants")
    by_user = live.where("kind = 'GLOBAL'").select("user_id", "pool_id", "alone")

    # nearly all pairs are of a session and a pool of one row each, which meet in one way only: by the user, or by the agent. They need not be told apart
    def plain(key: str, seen: DataFrame) -> DataFrame:
        lists = seen.where("alone").groupBy(key, F.pmod(F.xxhash64("pool_id"), F.lit(POOL_BLOCKS)).alias("block")).agg(F.collect_list("pool_id").alias("pools"))
        dealt = s.where("single").select("session_id", key).repartition(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), "session_id")
        return dealt.join(lists.drop("block"), key).select("session_id", F.explode("pools").alias("pool_id"))

    def other(key: str, seen: DataFrame) -> DataFrame:
        both = [s.where("not single").join(seen, key), s.where("single").join(seen.where("not alone"), key)]
        return both[0].select("session_id", "pool_id").unionAll(both[1].select("session_id", "pool_id"))

    granted = s.join(grants.where("grantee_kind = 'session'").select(F.col("grantee").alias("session_id"), "pool_id"), "session_id").join(live.where("kind = 'SHARED'").select("pool_id"), "pool_id", "left_semi").select("session_id", "pool_id")
    made = s.join(live.where("kind = 'PRIVATE'").select(F.col("created_by").alias("session_id"), "pool_id"), "session_id").join(by_agent.select("agent", "pool_id"), ["agent", "pool_id"], "left_anti").select("session_id", "pool_id")
    few = other("user_id", by_user).unionAll(other("agent", by_agent)).unionByName(granted).unionByName(made).distinct()
    return plain("user_id", by_user).unionByName(plain("agent", by_agent)).unionByName(few)


def import_rows(df: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """Good rows and an error table of df(row, name, kind, importance as text): unknown kinds become `other`; importance must be 1 to 5."""
    n = F.expr("try_cast(importance as int)")
    rows = df.withColumn("n", n).withColumn("error", F.when(F.col("name").isNull() | (F.trim("name") == ""), "no name").when(F.col("n").isNull() | ~F.col("n").between(1, 5), "importance must be 1 to 5"))
    good = rows.where("error is null").select("row", F.trim("name").alias("name"), F.when(F.lower("kind").isin(kinds), F.lower("kind")).otherwise("other").alias("kind"), F.col("n").alias("importance"))
    return good, rows.where("error is not null").select("row", "error")


def export_memories(df: DataFrame, layers: list[str] | None = None) -> DataFrame:
    """A row a user: the exported memories as an ordered array of structs, ready for write.json."""
    rows = df if layers is None else df.where(F.col("layer").isin(layers))
    item = F.struct("memory_id", "layer", "memory_type", "importance", "tags")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(item)).alias("memories"))


def export_rows(
    df: DataFrame, layers: list[str] | None = None, project: str | None = None, since: str | None = None, until: str | None = None,
    vectors: DataFrame | None = None, links: DataFrame | None = None,
) -> DataFrame:
    """A row a memory that isn't deleted, with its extraction, vectors and graph nested in it: write.partitionBy("user_id").json gives a file set a user.

    vectors(memory_id, model_id, embedding), links(memory_id, target_id, edge_type). `since` and `until` are included. Nothing of a user is gathered
    in one row; a memory's own vectors and links are, ordered by model and by target, empty where it has none.
    """
    rows = df.where("deleted_at is null").where(scope_filter(layers, project)).where(time_range(since, until))
    extraction = F.struct("memory_type", "tags", "confidence")
    rows = rows.select("memory_id", "user_id", "raw", "layer", "importance", "created_at", extraction.alias("extraction"))
    nested = (("vectors", vectors, ["model_id", "embedding"]), ("links", links, ["target_id", "edge_type"]))
    for name, side, fields in nested:
        if side is not None:
            lists = side.groupBy("memory_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
            rows = rows.join(lists, "memory_id", "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return rows


def load_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table under the given types; only the columns named there are read."""
    return spark.read.schema(schema).parquet(path)


# What the columns of the memory table may hold, which may not be null, and what they refer to (table, key).
MEMORY_VALUES = {
    "layer": ("IDENTITY", "PROJECT", "SESSION", "TASK", "INSIGHT"),
    "memory_type": ("CONSTRAINT", "PREFERENCE", "FACT", "TASK", "EVENT", "LESSON", "TASK_OUTCOME", "SELF_ASSESSMENT", "DECISION", "OUTCOME", "GOAL", "TEMPORAL_GAP", "FACT_KEY"),
    "subject_type": ("USER", "AGENT", "ENTITY"),
    "source": ("DREAM_CYCLE", "EXPLICIT_STATEMENT", "AGENT_OBSERVATION", "AGENT_REFLECTION", "CORRECTION", "PATTERN_DETECTED", "SYSTEM", "GIT_HISTORY", "HISTORICAL"),
    "importance_hint": ("LOW", "MEDIUM", "HIGH", "CRITICAL"),
    "embedding_status": ("PENDING", "COMPLETE", "FAILED", "DUPLICATE"),
    "durability": ("UNCLASSIFIED", "DURABLE", "EPHEMERAL"),
    "visibility": ("PRIVATE", "TEAM", "PUBLIC"),
    "temporal_anchor_source": ("EXPLICIT_CALLER", "INFERRED_FROM_CONTENT", "FALLBACK_RECORDED_AT"),
}
MEMORY_REQUIRED = ("memory_id", "user_id", "raw", "layer", "created_at")
MEMORY_RELATIONS = {
    "user_id": ("users", "user_id"), "project_id": ("projects", "project_id"), "session_id": ("sessions", "session_id"), "cluster_id": ("clusters", "cluster_id"),
    "superseded_by": ("memories", "memory_id"), "consolidated_into": ("memories", "memory_id"),
}


def table_problems(
    df: DataFrame, required: tuple[str, ...] = (), values: dict[str, tuple[str, ...]] | None = None, sizes: dict[str, int] | None = None, relations: dict[str, tuple[DataFrame, str]] | None = None
) -> DataFrame:
    """(column_name, problem, n): how many rows break a rule, one row a rule, zeros too, in one pass over the table and a join for each relation.

    required: columns that may not be null. values: what an enum column may hold; null is left to `required`. sizes: the length that a vector must have.
    relations: the table and key in which a column's values must be found, nulls aside; the rows that share a value are counted as one before they are joined.
    An empty table breaks no rule.
    """
    rules = [(c, "is null", F.col(c).isNull()) for c in required]
    rules += [(c, "unknown value", ~F.col(c).isin(*v)) for c, v in (values or {}).items()]
    rules += [(c, "wrong size", F.col(c).isNotNull() & (F.size(c) != n)) for c, n in (sizes or {}).items()]
    counts = df.agg(*[F.count(F.when(bad, 1)).alias(f"n{i}") for i, (_, _, bad) in enumerate(rules)])
    out = counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(p).alias("problem"), F.col(f"n{i}").alias("n")) for i, (c, p, _) in enumerate(rules)]))) if rules else None
    for column, (table, key) in (relations or {}).items():
        used = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))
        lost = used.join(table.select(F.col(key).alias("value")).distinct(), "value", "left_anti").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"))
        row = lost.select(F.lit(column).alias("column_name"), F.lit("not found").alias("problem"), F.col("n").cast("long").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def memory_problems(memories: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """table_problems by the rules of the memory table, as far as the columns and the tables (by name, `memories` itself aside) are there."""
    have = set(memories.columns)
    known = tables | {"memories": memories}
    relations = {c: (known[t], key) for c, (t, key) in MEMORY_RELATIONS.items() if c in have and t in known}
    return table_problems(memories, tuple(c for c in MEMORY_REQUIRED if c in have), {c: v for c, v in MEMORY_VALUES.items() if c in have}, relations=relations)


def checked_memories(memories: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """memories, once memory_problems finds none; else an error that names the broken rules. The rules are some twenty rows."""
    found = memory_problems(memories, tables).where("n > 0").orderBy("column_name", "problem").collect()
    if found:
        raise ValueError("; ".join(f"{r.column_name} {r.problem}: {r.n} rows" for r in found))
    return memories
