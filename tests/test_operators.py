"""Hand fixtures with exact values, and invariants."""

import datetime

import pytest
from pyspark.sql import functions as F

from loomwork.operators import analytics, behaviour, components, dedup, evaluating, ingesting, lifecycle, reconciling, running, scoring, searching, texts, timelines, vectors

NOW = "2024-01-31 00:00:00"


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)]).select(column.alias("x")).first().x


def test_rrf(spark):
    hits = spark.createDataFrame([("q", v, d, r, 1.0 / r) for v, ds in (("a", "ABC"), ("b", "BD")) for r, d in enumerate(ds, 1)], "query_id string, variant string, doc_id string, rank int, score double")
    found = {r.doc_id: r.fused for r in scoring.rrf(hits).collect()}
    assert found == {"B": 1.0, "A": 0.504065, "D": 0.495935, "C": 0.488063}
    assert {r.doc_id for r in scoring.rrf(hits, 2).collect()} == {"B"}


def test_usage_weight(spark):
    assert round(one(spark, scoring.usage_weight(F.lit(0.8), F.lit(5), F.lit(14.0), F.lit(0))), 6) == 0.73
    assert round(one(spark, scoring.usage_weight(F.lit(0.8), F.lit(0), F.lit(None).cast("double"), F.lit(0))), 6) == 0.68


@pytest.mark.parametrize(("day", "want"), [("2024-01-10", 1.0), ("2024-01-12 00:00:00", 0.7), ("2024-01-14", 0.328571), ("2024-01-19", 0.0)])
def test_temporal_relevance(spark, day, want):
    assert round(one(spark, scoring.temporal_relevance(F.lit(day), F.lit("2024-01-09"), F.lit("2024-01-11"))), 6) == want


def test_experience(spark):
    assert [round(one(spark, scoring.experience_weight(F.lit(n))), 6) for n in (0, 15, 20)] == [1.0, 1.5, 1.60315]


def test_effective_score(spark):
    row = spark.createDataFrame([("SESSION", 0.6, 3, 4, 0.8, "2023-12-01", "2024-01-01", False, False, "FACT")], "layer string, importance double, used_count int, retrieval_count int, confidence double, created_at string, last_retrieved_at string, user_pinned boolean, safety_critical boolean, memory_type string")
    assert round(row.select(scoring.effective_score(NOW).alias("x")).first().x, 3) == 0.491


def test_trust(spark):
    rows = spark.createDataFrame([("a", 1.0, datetime.datetime(2024, 1, 31)), ("a", -1.5, datetime.datetime(2024, 1, 1))], "agent_id string, weight double, created_at timestamp")
    assert behaviour.trust_score(rows, NOW, ["agent_id"]).first().trust == 0.571429


def test_tier(spark):
    rows = [(1, False, "2023-10-23", "2023-12-31", 2), (2, False, "2023-10-23", "2023-12-31", 3), (3, True, "2023-10-23", "2023-12-31", 2), (4, False, "2024-01-30", None, 0)]
    df = spark.createDataFrame(rows, "id int, user_pinned boolean, created_at string, last_retrieved_at string, retrieval_count int")
    assert [r.t for r in df.orderBy("id").select(lifecycle.tier(NOW).alias("t")).collect()] == ["COLD", "WARM", "HOT", "HOT"]


def test_gap_markers(spark):
    t0 = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", i, t0 + datetime.timedelta(seconds=s)) for i, s in enumerate((0, 600, 1201, 1202))], "agent string, event_id long, ts timestamp")
    assert [(r.event_id, r.gap_seconds, r.gap_text) for r in timelines.gap_markers(rows, ["agent"]).collect()] == [(2, 601, "10m")]


def test_edit_similarity(spark):
    assert round(one(spark, dedup.edit_similarity(F.lit("kitten"), F.lit("sitting"))), 6) == 0.571429


def test_edit_pairs(spark):
    words = [f"word{i}" for i in range(30)]
    near, far = [*words[:20], "other", *words[21:]], words[::-1]
    df = spark.createDataFrame([("u", 1, " ".join(words)), ("u", 2, "  ".join(near).upper()), ("u", 3, " ".join(far)), ("u", 4, " ".join(words)), ("v", 5, " ".join(words)), ("v", 6, None)], "user_id string, memory_id long, raw string")
    found = dedup.edit_pairs(df).collect()
    assert [(r.user_id, r.left_text, r.right_text) for r in found] == [("u", *sorted((" ".join(words), " ".join(near))))]
    assert dedup.text_members(df).count() == 6


def test_rescue_terms(spark):
    assert one(spark, searching.rescue_terms(F.lit("What does the coffee shop need from me?"))) == ["coffee", "shop", "from"]


def test_types_and_times(spark):
    kind = lambda s: one(spark, texts.classify_type(F.lit(s)))
    assert [kind(s) for s in ("I prefer tea", "I am allergic to nuts", "plain text")] == ["PREFERENCE", "CONSTRAINT", "FACT"]
    span = one(spark, texts.parse_time(F.lit("what happened day before yesterday"), NOW))
    start = int(datetime.datetime(2024, 1, 30, tzinfo=datetime.UTC).timestamp())
    assert (span.start, span.end, span.soft) == (start, start + 86399, False)
    assert one(spark, texts.parse_time(F.lit("nothing here"), NOW)) is None
    assert one(spark, texts.classify_layer(F.lit("Don't forget the milk"))) == "TASK"
    assert one(spark, texts.matches(F.lit("éage"), r"\bage\b")) is True


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(x), 1, 1) for x in (1, 2, 3, 4)], "k string, latency_ms double, result_count int, chars int")
    assert evaluating.ops_summary(df, ["k"]).first().p95 == 3.85


def test_anti_entropy(spark):
    rows = spark.createDataFrame([("f", 9, "x", "broken", "held"), ("f", 1, "y", None, "in")], "fact_id string, version int, content string, digest string, side string")
    good = rows.withColumn("digest", F.coalesce("digest", reconciling.digest(F.col("fact_id"), F.col("version"), F.col("content"))))
    r = reconciling.anti_entropy(good.where("side = 'held'"), good.where("side = 'in'")).first()
    assert (r.outcome, r.version) == ("healed", 1)


def test_components_of_paths_rings_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(200, 200 + i) for i in range(1, 40)] + [(300, 300), (None, 5)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(9)} | {200 + i: 200 for i in range(40)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_running_sum_over_blocks(spark):
    rows = [("a" if i % 3 else None, i, i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    found = running.running_sum(df, ["k"], F.floor(F.col("i") / 7), [F.col("i")], F.col("v"), "ahead").collect()
    assert len(found) == 200
    for r in found:
        assert r.ahead == sum(v for k, i, v in rows if k == r.k and i < r.i)


def greedy(pairs, n, least):
    near = {i: set() for i in range(n)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    free, groups = set(range(n)), {}
    for i in range(n):
        if i in free:
            own = {j for j in near[i] if j in free} | {i}
            free.discard(i)
            if len(own) >= least:
                groups[i] = own
                free -= own
    return groups


@pytest.mark.parametrize("seed", range(3))
def test_leader_groups_equal_the_loop(spark, seed):
    import random

    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(45)}
    found = lifecycle.leader_groups(spark.createDataFrame(sorted(pairs), "a long, b long"), spark.createDataFrame([(i, i) for i in range(40)], "id long, place long"), 3).collect()
    got = {}
    for r in found:
        got.setdefault(r.leader, set()).add(r.id)
    assert got == greedy(pairs, 40, 3)


def test_chunks_lose_nothing(spark):
    text = "\n".join(" ".join(f"Sentence {i} of part {p}." for i in range(p * 7 + 1)) for p in range(6))
    chunks = [r.text for r in ingesting.chunk_text(spark.createDataFrame([(1, text)], "doc_id long, text string"), 200).orderBy("chunk").collect()]
    assert all(len(c) <= 200 for c in chunks) and " ".join(chunks).split() == text.split()
    led = [r.text for r in ingesting.chunk_overlap(spark.createDataFrame([(1, text)], "doc_id long, text string"), 200, 20).orderBy("chunk").collect()]
    assert all(b.startswith(a[-20:]) for a, b in zip(led, led[1:]))


def test_diversify(spark):
    rows = [("q", i, i, list("abcde") if i in (1, 2, 4) else [f"w{i}", "x"]) for i in range(1, 7)]
    df = spark.createDataFrame(rows, "query_id string, rank int, doc_id long, tokens array<string>")
    assert [r.doc_id for r in scoring.diversify(df, 5).orderBy("place").collect()] == [1, 3, 5, 6, 2]


def test_wrong_dimensions_fail(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "embedding array<float>")
    with pytest.raises(Exception, match="dimensions"):
        vectors.checked(df, "embedding", 3).collect()


def test_bad_interval():
    with pytest.raises(ValueError):
        analytics.volume(None, "fortnight")


def test_fusion_does_not_depend_on_partitions(spark):
    hits = spark.createDataFrame([(q, f"v{i % 3}", i % 11, i % 7 + 1, i % 5 / 5, "rules") for q in range(4) for i in range(60)], "query_id long, variant string, doc_id long, rank int, score double, source string")
    for f in (scoring.rrf, scoring.weighted_rrf, scoring.max_score_fusion, scoring.frequency_fusion):
        assert sorted(map(str, f(hits).collect())) == sorted(map(str, f(hits.repartition(7, "doc_id")).collect()))


def test_lineage_reports_cycles(spark):
    events = [(2, [1], False), (3, [2], False), (1, [3], False), (1, [4], False), (9, [8], False), (10, [9], False), (5, [6], True)]
    found = dedup.lineage(spark.createDataFrame(events, "survivor long, absorbed array<long>, rolled_back boolean")).collect()
    assert {(r.memory_id, r.final_id, r.steps) for r in found} == {(1, None, None), (2, None, None), (3, None, None), (4, None, None), (8, 10, 2), (9, 10, 1)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize(("share", "q"), [(0.1, 4), (0.25, 2)])
def test_edit_candidates_lose_no_pair(spark, share, q):
    import random

    rng, texts = random.Random(17), set()
    for _ in range(60):
        t = "".join(rng.choice("ab c") for _ in range(rng.choice([1, 3, 5, 9, 12, 20, 60])))
        for _ in range(4):
            texts.add(t)
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(["", "x", "zq"]) + t[at + rng.randint(0, 1) :]
    texts = sorted(x for x in texts if x)
    rows = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "grp int, id long, text string")
    found = {(r.left_id, r.right_id) for r in dedup.edit_candidates(rows, rows, share, q).collect()}
    near = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if abs(len(a) - len(b)) <= share * max(len(a), len(b)) and distance(a, b) <= share * max(len(a), len(b)) + 1e-9}
    assert near <= found and len(near) > len(texts)


def test_edit_pairs_of_short_texts(spark):
    rows = [(1, "please call me after lunch"), (2, "please call mi after lunch"), (3, "something else"), (4, None), (5, ""), (6, "please call me after lunch")]
    found = dedup.edit_pairs(spark.createDataFrame([(i, "u", t) for i, t in rows], "memory_id long, user_id string, raw string")).collect()
    assert [(r.left_text, r.right_text) for r in found] == [(rows[0][1], rows[1][1])]


def test_names_resolve_by_tiers(spark):
    profiles = spark.createDataFrame([(1, "Alice Johnson", ["Al"]), (2, "Robert", ["Bob"]), (3, "Katherine Smith", [])], "profile_id long, profile_name string, aliases array<string>")
    names = ["Who is Alice Johnson?", "bob", "alice johnson profile", "Katherin Smith", "Rxbxrt", "Rpbert", "Nobody Here", "Zed"]
    near = spark.createDataFrame([("Zed", 3, 0.8), ("Nobody Here", 1, 0.4)], "name string, profile_id long, similarity double")
    found = {r.name: (r.profile_id, r.how) for r in searching.resolve_names(spark.createDataFrame([(n,) for n in names], "name string"), profiles, near).collect()}
    assert found == {"Who is Alice Johnson?": (1, "exact"), "alice johnson profile": (1, "exact"), "bob": (2, "alias"), "Katherin Smith": (3, "trigram"), "Rpbert": (2, "edits"), "Zed": (3, "vector")}


def test_scope_filter(spark):
    from loomwork.operators.predicates import scope_filter

    rows = spark.createDataFrame([(1, "USER", "TEAM", "s", None), (2, "AGENT", "PRIVATE", None, "s"), (3, None, None, "t", "s"), (4, "ENTITY", "PUBLIC", None, None)], "id int, subject_type string, visibility string, session_id string, other string")
    ids = lambda **k: [r.id for r in rows.where(scope_filter(**k)).orderBy("id").collect()]
    assert ids() == [1, 2, 3, 4] and ids(visibility=[]) == [1, 2, 3, 4]
    assert ids(session="s") == [1] and ids(session="s", external_session="other") == [1, 2, 3]
    assert ids(visibility=["TEAM", "PUBLIC"]) == [1, 4]
    assert ids(subject_type="ENTITY") == [4] and ids(subject_type="ENTITY", include_user=False) == [2]
    assert ids(include_agent=False) == [1] and ids(include_agent=False, include_user=False) == []


def test_chunk_markdown(spark):
    text = "first\r\n\n# A 2024-02-30\none\n2023-01-01 two\n\n- 2023-05-06 three\n ## B 2024-03-01\nfour\n#C no heading\n\n# D\n2024-13-01 five\nx2024"
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string").withColumn("file_day", F.lit("2020-01-01").cast("date"))
    found = [(r.heading, r.heading_line, r.first_line, r.last_line, str(r.day), r.text) for r in ingesting.chunk_markdown(rows).orderBy("first_line").collect()]
    assert found == [
        (None, None, 1, 1, "2020-01-01", "first"), ("A 2024-02-30", 3, 4, 5, "2020-01-01", "one\n2023-01-01 two"), ("A 2024-02-30", 3, 7, 7, "2023-05-06", "- 2023-05-06 three"),
        ("B 2024-03-01", 8, 9, 10, "2024-03-01", "four\n#C no heading"), ("D", 12, 13, 14, "2024-03-01", "2024-13-01 five\nx2024"),
    ]
    assert all(r.day is None for r in ingesting.chunk_markdown(rows.drop("file_day").where("doc_id > 1")).collect())


def test_table_problems(spark):
    rows = spark.createDataFrame([("a", [1.0]), (None, [1.0, 2.0]), ("z", None)], "kind string, v array<double>")
    problems = lambda df: {(r.column_name, r.problem): r.n for r in ingesting.table_problems(df, ("kind",), {"kind": ("a", "b")}, {"v": 2}).collect()}
    assert problems(rows) == {("kind", "is null"): 1, ("kind", "unknown value"): 1, ("v", "wrong size"): 1}
    assert set(problems(rows.limit(0)).values()) == {0}


def test_reports_of_empty_and_null_rows(spark):
    schema = "memory_id long, user_id string, agent_id string, raw string, memory_type string, origin string, layer string, importance double, deleted_at timestamp, user_hidden boolean, consolidated_into long, created_at timestamp, synced_at timestamp, embedding_status string, embedding_id long, attempts int"
    rows = spark.createDataFrame([(1, "u", "a", None, None, "SYSTEM", "SESSION", 0.5, None, None, None, None, None, "DONE", None, 5)], schema)
    assert behaviour.work_history(rows).select("total", "completions", "types").first() == (1, 1, [])
    assert behaviour.portable_trust(rows).first() == ("a", 1, 0.0, 0.5)
    assert analytics.embedding_status(rows).first() == ("u", 1, 1, 0, 0, 1, 1)
    assert analytics.sync_status(rows).first() == ("u", 1, 0, None, 1)
    assert analytics.consolidation_stats(rows).first() == ("u", 1, 1, 0, 0, 0, 0)
    for report in (behaviour.work_history, behaviour.portable_trust, analytics.embedding_status, analytics.sync_status, analytics.consolidation_stats):
        assert report(rows.limit(0)).count() == 0


def test_memories_are_checked_before_they_are_used(spark):
    fields = "memory_id long, user_id string, raw string, layer string, memory_type string, created_at string, superseded_by long"
    good = spark.createDataFrame([(1, "u", "a", "TASK", None, "x", None), (2, "u", "b", "IDENTITY", "FACT", "x", 1)], fields)
    users = spark.createDataFrame([("u",)], "user_id string")
    assert ingesting.checked_memories(good, {"users": users}).count() == 2
    bad = good.unionAll(spark.createDataFrame([(3, "v", None, "TASKS", "fact", "x", 9), (4, "v", "c", "TASK", None, "x", None)], fields))
    with pytest.raises(ValueError, match="layer unknown value: 1 rows; memory_type unknown value: 1 rows; raw is null: 1 rows; superseded_by not found: 1 rows; user_id not found: 2 rows"):
        ingesting.checked_memories(bad, {"users": users})
    assert not ingesting.memory_problems(good.limit(0), {}).where("n > 0").count()
