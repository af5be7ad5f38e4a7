"""Queries that ask the same are answered once: against plain versions, and without rows for each query and memory."""

from pyspark.sql import functions as F

from loomwork.operators import behaviour, dedup, graphs, searching, texts


def rows_made(out):
    """The most rows that a join or expansion of the executed plan gave."""
    out.collect()
    plan = out._jdf.queryExecution().executedPlan()
    found = []

    def walk(p):
        if "Join" in p.nodeName():
            m = p.metrics().get("numOutputRows")
            if m.isDefined():
                found.append(m.get().value())
        kids = p.children()
        for i in range(kids.size()):
            walk(kids.apply(i))
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            walk(p.executedPlan())
        elif "QueryStage" in p.nodeName():
            walk(p.plan())

    walk(plan)
    return max(found)


N, Q = 400, 200


def test_graph_recalls_of_equal_queries(spark):
    asked = spark.range(Q).select(F.col("id").alias("query_id"), F.concat(F.lit("e"), F.col("id") % 2).alias("entity"))
    edges = spark.createDataFrame([("e0", "e1", 0.9)], "source_id string, target_id string, weight double")
    mentions = spark.range(N).select(F.concat(F.lit("e"), F.col("id") % 2).alias("entity"), F.col("id").alias("memory_id"), F.lit(0.8).alias("effective"), F.lit(0).alias("days"))
    out = graphs.graph_recall(asked, edges, mentions, 3)
    assert rows_made(out) < N * Q / 20
    assert {(r.query_id, r.memory_id, r.score, r.rank) for r in out.collect()} == {(q, m, 0.7, m + 1) for q in range(Q) for m in range(3)}
    out = graphs.radiate(asked, edges, mentions, 3)
    assert rows_made(out) < N * Q / 20
    assert {tuple(r) for r in out.collect()} == {(q, 1, 0.72) for q in range(0, Q, 2)}


def test_profile_recall_of_equal_queries(spark):
    m = spark.range(N).select(F.col("id").alias("memory_id"), (F.col("id") % 2).alias("profile_id"), F.lit(0.5).alias("importance"), F.lit(0.9).alias("relevance"))
    asked = spark.range(Q).select(F.col("id").alias("query_id"), (F.col("id") % 2).alias("profile_id"))
    out = graphs.profile_recall(asked, m.where("memory_id > 1"), m, 2)
    assert rows_made(out) < N * Q / 20
    assert {tuple(r) for r in out.collect()} == {x for q in range(Q) for x in ((q, q % 2, 0.7, 1), (q, q % 2 + 2, 0.9, 2))}


def test_insights_of_equal_queries(spark):
    m = spark.range(N).select(
        F.col("id").alias("memory_id"), F.lit("u").alias("user_id"), F.when(F.col("id") % 2 == 0, "the tea").otherwise("no").alias("raw"), F.array(F.lit("tag")).alias("tags"),
        F.lit(1.0).alias("confidence"), F.lit("2024-01-31").cast("timestamp").alias("created_at"), F.lit(0).alias("shown"),
    )
    terms = spark.range(Q).select(F.col("id").alias("query_id"), F.lit("u").alias("user_id"), F.explode(F.array(F.lit("tea"), F.lit("tag"), F.lit("tea"))).alias("term"))
    out = texts.insight_salience(m, terms, "2024-01-31 00:00:00")
    assert rows_made(out) < N * Q / 20
    assert {tuple(r) for r in out.collect()} == {(q, 2 * i, 0.8, i + 1) for q in range(Q) for i in range(3)}


def test_identity_of_equal_queries(spark):
    m = spark.range(N).select(
        F.col("id").alias("memory_id"), F.lit("u").alias("user_id"), F.lit("a thing").alias("raw"), F.array().cast("array<string>").alias("tags"), F.lit(0.5).alias("importance"),
        F.lit("2024-01-31").cast("timestamp").alias("created_at"),
    )
    asked = spark.range(Q).select(F.col("id").alias("query_id"), F.lit("u").alias("user_id"), F.lit("Who am I").alias("text"))
    out = searching.identity_rescue(asked, m, ["thing"], 4)
    assert rows_made(out) < N * Q / 20
    assert {tuple(r) for r in out.collect()} == {(q, i, i + 1) for q in range(Q) for i in range(4)}


def test_tasks_of_equal_phrases(spark):
    tasks = spark.range(N).select(F.col("id").alias("task_id"), F.lit("d").alias("domain"), F.when(F.col("id") % 2 == 0, "Tool error here").otherwise("timeout").alias("reason"), F.timestamp_seconds("id").alias("created_at"))
    asked = spark.range(Q).select(F.col("id").alias("query_id"), F.lit("d").alias("domain"), F.lit("tool error").alias("text"))
    out = behaviour.similar_tasks(asked, tasks, 2)
    assert rows_made(out) < N * Q / 20
    assert {(r.query_id, r.task_id, r.similarity, r["rank"]) for r in out.collect()} == {(q, N - 2 * i, 0.5, i) for q in range(Q) for i in (1, 2)}


def test_names_with_common_beginnings(spark):
    """Names that differ in their last digits only, as numbered ones do, don't meet all of one another."""
    people = spark.range(600).select(F.col("id").alias("profile_id"), F.format_string("Customer#%09d", F.col("id") * 7).alias("profile_name"))
    own = F.concat(F.substring("profile_name", 1, 9), F.substring("profile_name", 11, 100))
    out = searching.trigram_match(people.select(own.alias("name")), people)
    plain = {}

    def pieces(t):
        t = "  " + t.lower() + " "
        return {t[i : i + 3] for i in range(len(t) - 2)}

    held = [(i, pieces(f"Customer#{i * 7:09d}")) for i in range(600)]
    for i in range(600):
        name = f"Customer#{i * 7:08d}"
        x = pieces(name)
        plain[name] = min((-round(len(x & g) / len(x | g), 6), p) for p, g in held)
    assert {r.name: (-r.similarity, r.profile_id) for r in out.collect()} == plain
    wrong = F.concat(F.substring("profile_name", 1, 9), F.lit("y"), F.substring("profile_name", 11, 100))
    found = dedup._one_edit(people.select(wrong.alias("name")), people, 0.75)
    assert {tuple(r) for r in found.collect()} == {(f"Customer#y{i * 7:08d}", i, round(1 - 1 / 18, 6)) for i in range(600)}
    out = dedup.edit_ratio(people.select(wrong.alias("name")), people)
    assert rows_made(dedup._one_edit(people.select(wrong.alias("name")), people, 0.75)) < 600 * 60 and out.count() == 600
