"""Trust, capabilities and failures of agents, from logs of signals, tasks and calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.analytics import count_if, hours_before, latest_by
from loomwork.operators.vectors import knn
from loomwork.operators.scoring import experience_weight, ranked

# Weights of outcomes.
SIGNALS = {"SUCCESS": 1.0, "FAILURE": -1.5, "PARTIAL": -0.5}


def signed(outcome: Column) -> Column:
    return F.coalesce(*[F.when(outcome == k, w) for k, w in SIGNALS.items()], F.lit(0.0))


def trust_score(signals: DataFrame, now: str, keys: list[str]) -> DataFrame:
    """(keys, trust, n): weights decayed with a half-life of 30 days, their sum over the sum of their sizes, put into 0 to 1."""
    d = F.pow(F.lit(2.0), -hours_before(now, F.col("created_at")) / 24 / 30)
    s = signals.groupBy(*keys).agg(F.sum(F.col("weight") * d).alias("a"), F.sum(F.abs("weight") * d).alias("b"), F.count("*").alias("n"))
    return s.select(*keys, F.round((F.coalesce(F.try_divide("a", "b"), F.lit(0.0)) + 1) / 2, 6).alias("trust"), "n")


def trust_profile(tasks: DataFrame, now: str) -> DataFrame:
    """(agent_id, domain, decayed, success_rate, avg_duration, n, trend): later half against the first, from four tasks on."""
    d = F.pow(F.lit(2.0), -hours_before(now, F.col("created_at")) / 24 / 30)
    points = F.when(F.col("outcome") == "SUCCESS", 1.0).when(F.col("outcome") == "PARTIAL", 0.5).otherwise(0.0)
    keys = ["agent_id", "domain"]
    w = Window.partitionBy(*keys)
    rows = tasks.withColumns({"p": points, "d": d, "r": F.row_number().over(w.orderBy("created_at", "task_id")), "n": F.count("*").over(w)})
    late = F.col("r") * 2 > F.col("n")
    out = rows.groupBy(*keys).agg(
        (F.sum(F.col("p") * F.col("d")) / F.sum("d")).alias("x"), F.avg((F.col("outcome") == "SUCCESS").cast("int")).alias("s"), F.avg("duration_ms").alias("t"), F.count("*").alias("n"),
        F.avg(F.when(late, F.col("p"))).alias("late"), F.avg(F.when(~late, F.col("p"))).alias("early"),
    )
    change = F.col("late") - F.col("early")
    trend = F.when(F.col("n") < 4, "stable").when(change > 0.1, "improving").when(change < -0.1, "declining").otherwise("stable")
    return out.select(*keys, F.round("x", 6).alias("decayed"), F.round("s", 6).alias("success_rate"), F.round("t", 4).alias("avg_duration"), "n", trend.alias("trend"))


def trust_history(tasks: DataFrame) -> DataFrame:
    """(agent_id, day, score, n): the share of successes up to each day that has tasks."""
    day = tasks.groupBy("agent_id", F.to_date("created_at").alias("day")).agg(F.sum(signed(F.col("outcome"))).alias("s"), F.count("*").alias("c"))
    w = Window.partitionBy("agent_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return day.select("agent_id", "day", F.round(F.sum("s").over(w) / F.sum("c").over(w), 6).alias("score"), F.sum("c").over(w).alias("n"))


def trust_changes(history: DataFrame) -> DataFrame:
    """(agent_id, day, change, size, importance) of trust_history's days that differ from the one before."""
    change = F.round(F.col("score") - F.lag("score").over(Window.partitionBy("agent_id").orderBy("day")), 6)
    rows = history.withColumn("change", change).where(F.abs("change") >= 0.005)
    size = F.when(F.abs("change") >= 0.15, "large").when(F.abs("change") >= 0.05, "moderate").otherwise("slight")
    return rows.select("agent_id", "day", "change", size.alias("size"), F.when(F.abs("change") >= 0.15, 0.9).when(F.abs("change") >= 0.05, 0.7).otherwise(0.5).alias("importance"))


def failure_patterns(tasks: DataFrame, least: int = 2, shared: int = 3) -> DataFrame:
    """(kind, subject, n): agents that fail again, agents that time out again, and domains that fail for several agents."""
    bad = tasks.where(F.col("outcome") == "FAILURE")
    agents = bad.groupBy("agent_id").agg(F.count("*").alias("n"), count_if(F.col("reason").contains("timeout")).alias("t"))
    domains = bad.groupBy("domain").agg(F.count("*").alias("n"), F.countDistinct("agent_id").alias("a")).where((F.col("n") >= shared) & (F.col("a") >= 2))
    one = agents.where(F.col("n") >= least).select(F.lit("agent").alias("kind"), F.col("agent_id").alias("subject"), "n")
    two = agents.where(F.col("t") >= 2).select(F.lit("timeout"), "agent_id", F.col("t"))
    return one.unionAll(two).unionAll(domains.select(F.lit("domain"), "domain", "n"))


def capability_checkpoint(tasks: DataFrame, least: int = 2) -> DataFrame:
    """(agent_id, domain, successes, first, last as epoch seconds) where an agent has `least` successes."""
    good = tasks.where(F.col("outcome") == "SUCCESS")
    at = F.unix_timestamp("created_at")
    return good.groupBy("agent_id", "domain").agg(F.count("*").alias("successes"), F.min(at).alias("first"), F.max(at).alias("last")).where(F.col("successes") >= least)


def capability_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(agent_id, domain, change, gain): capabilities gained or improved since the checkpoint before."""
    rows = after.select("agent_id", "domain", "successes").join(before.select("agent_id", "domain", F.col("successes").alias("old")), ["agent_id", "domain"], "left")
    rows = rows.where(F.col("old").isNull() | (F.col("successes") > F.col("old")))
    return rows.select("agent_id", "domain", F.when(F.col("old").isNull(), "gained").otherwise("improved").alias("change"), (F.col("successes") - F.coalesce("old", F.lit(0))).alias("gain"))


def capability_profile(tasks: DataFrame) -> DataFrame:
    """(agent_id, domain, n, success, confidence): confidence 0.3 + 0.7 * (1 - exp(-n / 10))."""
    rows = tasks.groupBy("agent_id", "domain").agg(F.count("*").alias("n"), F.avg((F.col("outcome") == "SUCCESS").cast("int")).alias("s"))
    return rows.select("agent_id", "domain", "n", F.round("s", 6).alias("success"), F.round(F.least(F.lit(1.0), 0.3 + 0.7 * (1 - F.exp(-F.col("n") / 10.0))), 6).alias("confidence"))


def experience_weights(tasks: DataFrame) -> DataFrame:
    n = tasks.groupBy("agent_id", "domain").agg(count_if(F.col("outcome") == "SUCCESS").alias("successes"))
    return n.withColumn("weight", F.round(experience_weight(F.col("successes")), 6))


def work_style(tasks: DataFrame) -> DataFrame:
    """(agent_id, avg, least, most, latest, trend): the newest duration against the mean before, 5 % either way being stable."""
    w = Window.partitionBy("agent_id").orderBy("created_at", "task_id")
    rows = tasks.withColumn("before", F.avg("duration_ms").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    out = rows.groupBy("agent_id").agg(
        F.round(F.avg("duration_ms"), 4).alias("avg"), F.min("duration_ms").alias("least"), F.max("duration_ms").alias("most"),
        F.max_by(F.struct("duration_ms", "before"), F.struct("created_at", "task_id")).alias("l"),
    )
    trend = F.when(F.col("l.duration_ms") > 1.05 * F.col("l.before"), "up").when(F.col("l.duration_ms") < 0.95 * F.col("l.before"), "down").otherwise("stable")
    return out.select("agent_id", "avg", "least", "most", F.col("l.duration_ms").alias("latest"), trend.alias("trend"))


def frequencies(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*keys)), 6))


def collaboration_pairs(touches: DataFrame) -> DataFrame:
    """(left_agent, right_agent, shared, importance): agent pairs by the rows both touched: touches(agent_id, item, importance).

    Counted from each row's set of agents, as many rows have the same set: pairs are made once a set, not once a row.
    """
    sets = touches.groupBy("item").agg(F.sort_array(F.collect_set("agent_id")).alias("agents"), F.max("importance").alias("importance"))
    same = sets.where(F.size("agents") > 1).groupBy("agents").agg(F.count("*").alias("n"), F.sum("importance").alias("s"))
    pairs = same.withColumn("left_agent", F.explode("agents")).withColumn("right_agent", F.explode("agents")).where("left_agent < right_agent")
    return pairs.groupBy("left_agent", "right_agent").agg(F.sum("n").alias("shared"), F.round(F.sum("s") / F.sum("n"), 6).alias("importance"))


def recommend_agent(tasks: DataFrame, k: int = 3) -> DataFrame:
    """(domain, agent_id, success_rate, failures, rank): by success rate, then number of tasks."""
    rows = tasks.groupBy("domain", "agent_id").agg(F.round(F.avg((F.col("outcome") == "SUCCESS").cast("int")), 6).alias("success_rate"), F.count("*").alias("n"), count_if(F.col("outcome") == "FAILURE").alias("failures"))
    return ranked(rows, ["domain"], [F.col("success_rate").desc(), F.col("n").desc(), F.col("agent_id")], k).select("domain", "agent_id", "success_rate", "failures", "rank")


def task_report(tasks: DataFrame, validations: DataFrame) -> DataFrame:
    """(task_id, verdict): what blocks a task, by its latest validation(task_id, at, passed, checks)."""
    last = latest_by(validations, ["task_id"], ["at", "passed", "checks"])
    rows = tasks.join(last, "task_id", "left")
    verdict = F.when(F.col("passed").isNull(), "not validated").when(~F.col("passed"), "validation failed").when(F.exists("checks", lambda c: c == "open"), "open checks").when(F.col("outcome") == "FAILURE", "failed").otherwise("trusted")
    return rows.select("task_id", verdict.alias("verdict"))


def evidence_to_signals(validations: DataFrame, receipts: DataFrame) -> DataFrame:
    """(task_id, signal, weight) of validations(task_id, passed) and receipts(task_id, status, verified)."""
    one = validations.select("task_id", F.when(F.col("passed"), "SUCCESS").otherwise("FAILURE").alias("signal"), F.when(F.col("passed"), 0.7).otherwise(1.0).alias("weight"))
    bad, clean = F.col("status").isin("failed", "rejected"), (F.col("status") == "clean") & F.col("verified")
    two = receipts.where(bad | clean).select("task_id", F.when(bad, "FAILURE").otherwise("SUCCESS").alias("signal"), F.when(bad, 1.2).otherwise(1.3).alias("weight"))
    return one.unionAll(two)


def illegal_transitions(events: DataFrame, allowed: list[tuple[str, str]], keys: list[str], order: list[str]) -> DataFrame:
    """(keys, from_state, to_state, n): moves between states that aren't allowed."""
    rows = events.withColumn("from_state", F.lag("state").over(Window.partitionBy(*keys).orderBy(*order))).where("from_state is not null")
    ok = F.lit(False)
    for a, b in allowed:
        ok = ok | ((F.col("from_state") == a) & (F.col("state") == b))
    return rows.where(~ok).groupBy(*keys, "from_state", F.col("state").alias("to_state")).agg(F.count("*").alias("n"))


def behaviour_drift(df: DataFrame, now: str, category: str, short: int = 24, long: int = 720, least: tuple[int, int] = (3, 5)) -> DataFrame:
    """(agent_id, distance): half the sum of absolute differences between the category's shares in the short and the long window."""
    age = hours_before(now, F.col("created_at"))
    rows = df.groupBy("agent_id", category).agg(count_if((age >= 0) & (age < short)).alias("s"), count_if((age >= 0) & (age < long)).alias("l"))
    w = Window.partitionBy("agent_id")
    rows = rows.withColumns({"ss": F.sum("s").over(w), "ll": F.sum("l").over(w)}).where((F.col("ss") >= least[0]) & (F.col("ll") >= least[1]))
    gap = F.abs(F.round(F.col("s") / F.col("ss"), 2) - F.round(F.col("l") / F.col("ll"), 2))
    return rows.groupBy("agent_id").agg(F.round(F.sum(gap) / 2, 4).alias("distance"))


def hot_entities(mentions: DataFrame, share: float = 0.4, least: int = 20) -> DataFrame:
    """(user_id, entity, n, share): entities that make up more than `share` of a user's mentions, from `least` on."""
    rows = frequencies(mentions, ["user_id"], "entity")
    return rows.where((F.col("share") > share) & (F.col("n") >= least))


def memory_observations(df: DataFrame, now: str, since: str) -> DataFrame:
    """(user_id, new_rows, forgotten, span_days): new since the checkpoint, important ones never retrieved in a week, days covered."""
    age = hours_before(now, F.col("created_at")) / 24
    return df.groupBy("user_id").agg(
        count_if(F.col("created_at") > F.lit(since).cast("timestamp")).alias("new_rows"), count_if((F.col("importance") >= 0.7) & (F.col("retrieval_count") == 0) & (age > 7)).alias("forgotten"),
        F.date_diff(F.max(F.to_date("created_at")), F.min(F.to_date("created_at"))).alias("span_days"),
    )


def top_values(df: DataFrame, keys: list[str], value: str, least: int = 2, k: int = 15) -> DataFrame:
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return ranked(n, keys, [F.col("n").desc(), F.col(value)], k)


def work_history(df: DataFrame, completions: str = "SYSTEM", reflections: str = "AGENT_REFLECTION") -> DataFrame:
    """(agent_id, total, completions, reflections, active_since, types, counts): of rows neither deleted nor hidden; types by falling count, then by name.

    Counts come per type first, so that an agent with most of the rows is no one task's work.
    """
    live = df.where(F.col("deleted_at").isNull() & ~F.coalesce("user_hidden", F.lit(False)))
    of = lambda origin: count_if(F.col("origin") == origin)
    per = live.groupBy("agent_id", "memory_type").agg(F.count("*").alias("n"), of(completions).alias("c"), of(reflections).alias("r"), F.min("created_at").alias("since"))
    kinds = F.sort_array(F.collect_list(F.when(F.col("memory_type").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("memory_type").alias("t")))))
    rows = per.groupBy("agent_id").agg(F.sum("n").alias("total"), F.sum("c").alias("completions"), F.sum("r").alias("reflections"), F.min("since").alias("active_since"), kinds.alias("kinds"))
    return rows.select("agent_id", "total", "completions", "reflections", "active_since", F.col("kinds.t").alias("types"), F.transform("kinds", lambda x: -x["n"]).alias("counts"))


def portable_trust(df: DataFrame, origins: tuple[str, ...] = ("SYSTEM", "AGENT_OBSERVATION"), digits: int = 2) -> DataFrame:
    """(agent_id, tasks, success_rate, quality): rows of these origins, neither deleted nor hidden; a success says `success` or `completed`.

    An agent with memories but none of these has zeros.
    """
    live = df.where(F.col("deleted_at").isNull() & ~F.coalesce("user_hidden", F.lit(False)))
    task, text = F.col("origin").isin(*origins), F.lower(F.coalesce("raw", F.lit("")))
    good = text.contains("success") | text.contains("completed")
    rows = live.groupBy("agent_id").agg(count_if(task).alias("tasks"), count_if(task & good).alias("good"), F.sum(F.when(task, F.col("importance"))).alias("s"))
    mean = lambda x: F.round(F.coalesce(F.try_divide(F.col(x).cast("double"), F.col("tasks")), F.lit(0.0)), digits)
    return rows.select("agent_id", "tasks", mean("good").alias("success_rate"), mean("s").alias("quality"))


def task_stats(tasks: DataFrame) -> DataFrame:
    """(agent_id, n, success_rate, avg_duration, reasons, stuck): stuck if three of the last five tasks failed for one reason."""
    rows = tasks.groupBy("agent_id").agg(F.count("*").alias("n"), F.round(F.avg((F.col("outcome") == "SUCCESS").cast("int")), 6).alias("success_rate"), F.round(F.avg("duration_ms"), 4).alias("avg_duration"))
    top = top_values(tasks.where(F.col("outcome") == "FAILURE"), ["agent_id"], "reason", 1, 5)
    reasons = top.groupBy("agent_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "reason"))), lambda x: x["reason"]).alias("reasons"))
    last = ranked(tasks, ["agent_id"], [F.col("created_at").desc(), F.col("task_id").desc()], 5).where(F.col("outcome") == "FAILURE")
    stuck = last.groupBy("agent_id", F.substring("reason", 1, 50).alias("r")).agg(F.count("*").alias("c")).where("c >= 3").select("agent_id", F.lit(True).alias("stuck")).distinct()
    return rows.join(reasons, "agent_id", "left").join(stuck, "agent_id", "left").withColumn("stuck", F.coalesce("stuck", F.lit(False)))


def capability_check(tasks: DataFrame, profile: DataFrame, least: float = 0.3) -> DataFrame:
    """(task_id, lowest, risky): the lowest confidence of domains that contain one of the task's words, or are contained in one."""
    words = tasks.select("task_id", "agent_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("w")).where(F.length("w") > 2)
    rows = words.join(profile, "agent_id").where(F.lower("domain").contains(F.col("w")) | F.col("w").contains(F.lower("domain")))
    low = rows.groupBy("task_id").agg(F.min("confidence").alias("lowest"))
    return low.withColumn("risky", F.col("lowest") < least)


def team_capabilities(rows: DataFrame, keywords: DataFrame, k: int = 50, per_hit: float = 0.3) -> DataFrame:
    """(capability, score, contributors): keyword hits of each agent's k most important rows(agent_id, memory_id, raw, importance), meaned over agents.

    keywords(capability, word) meet the rows' words by equality.
    """
    top = ranked(rows, ["agent_id"], [F.col("importance").desc(), F.col("memory_id")], k)
    words = top.select("agent_id", F.explode(F.array_distinct(F.split(F.lower("raw"), "[^a-z0-9]+"))).alias("word"))
    hits = words.join(keywords, "word").groupBy("agent_id", "capability").agg(F.least(F.lit(1.0), F.count("*") * per_hit).alias("s"))
    return hits.groupBy("capability").agg(F.round(F.avg("s"), 6).alias("score"), F.count("*").alias("contributors"))


def similar_tasks(queries: DataFrame, tasks: DataFrame, k: int = 5, words: int = 3, similarity: float = 0.5) -> DataFrame:
    """(query_id, task_id, similarity, rank): tasks of the query's domain whose reason has the query's first words, at a fixed similarity, newest first.

    The fallback of a vector search on tasks: queries(query_id, domain, text), tasks(task_id, domain, reason, created_at). Only different phrases of
    a domain meet its different reasons, of which the k newest tasks can be among a phrase's k newest.
    """
    low = F.lower("reason").alias("low")
    newest = [F.col("created_at").desc(), F.col("task_id")]
    asked = queries.select("query_id", "domain", F.lower(F.array_join(F.slice(F.split("text", " "), 1, words), " ")).alias("phrase"))
    phrases = asked.select("domain", "phrase").distinct()
    held = ranked(tasks.select("domain", low, "created_at", "task_id"), ["domain", "low"], newest, k, "newest")
    rows = phrases.join(held, "domain").where(F.contains("low", F.col("phrase")))
    best = ranked(rows, ["domain", "phrase"], newest, k).select("domain", "phrase", "task_id", F.lit(similarity).alias("similarity"), "rank")
    return asked.join(best, ["domain", "phrase"]).select("query_id", "task_id", "similarity", "rank")


def similar_tasks_by_vector(queries: DataFrame, tasks: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, task_id, similarity, rank): the k tasks nearest to each query by cosine, over all tasks; queries without a vector fall back to text.

    queries(query_id, domain, text, q), tasks(task_id, domain, reason, created_at, v) with unit vectors or null. Both sides are dealt into blocks.
    """
    whole = F.lit(0).alias("user_id")
    known = tasks.where("v is not null").select(F.col("task_id").alias("vec_id"), whole, "v")
    near = knn(queries.where("q is not null").select("query_id", whole, "q"), known, k).withColumnRenamed("vec_id", "task_id")
    return near.unionByName(similar_tasks(queries.where("q is null"), tasks, k))
