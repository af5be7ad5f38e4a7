"""Segments, dates, contexts, imports and exports against hand fixtures and plain loops."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from loomwork.operators import extracting, scoring, segmenting, texts

NOW = "2024-01-31 00:00:00"


def cut(text, **kw):
    return [text[a:b] for a, b in segmenting.sentence_spans(text, **kw)]


def test_sentences():
    text = "Mr. Fox ran to the far hills today. Yes. It is `a. B` code that stays whole! and goes on? Then the very last sentence came."
    assert cut(text) == ["Mr. Fox ran to the far hills today.", "Yes. It is `a. B` code that stays whole! and goes on?", "Then the very last sentence came."]
    assert cut("One long enough sentence. Short.") == ["One long enough sentence. Short."]
    long = "; ".join(["part " * 10] * 30) + "."
    parts = cut(long)
    assert len(parts) > 2 and all(len(p) <= 512 for p in parts) and "; ".join(p.strip() for p in parts).replace(" ", "") == long.replace(" ", "")
    assert cut("") == cut(" \n ") == []
    assert cut("x" * 600) == ["x" * 600]


def test_paragraphs(spark):
    many = " ".join(f"This is the sentence with the number {i}." for i in range(12))
    assert [len(p) for p in segmenting.paragraph_spans(many)] == [5, 5, 2]
    assert [len(p) for p in segmenting.paragraph_spans("One is a first paragraph.\n\nTwo is a second paragraph.\n \n" + many)] == [1, 1, 12]
    df = spark.createDataFrame([(1, many), (2, None), (3, ""), (1, many)], "doc_id long, text string")
    rows = segmenting.segments(df).collect()
    assert len(rows) == 24 and all(many[r.start : r.end] == r.segment for r in rows)
    assert segmenting.segments(df.where("false")).count() == 0


@pytest.mark.parametrize(
    ("said", "want"),
    [("last wednesday", "2024-01-24"), ("wednesday", "2024-01-31"), ("on Friday", "2024-01-26"), ("this week", "2024-01-28"), ("2 months ago", "2023-11-30"), ("Feb 30, 2026", "2026-03-02"),
     ("3rd june 2025", "2025-06-03"), ("12/31/2024", "2024-12-31"), ("13/12/2024", None), ("may be", None), (None, None), ("2024-02-30", None)],
)
def test_dates(spark, said, want):
    got = spark.range(1).select(texts.parse_date(F.lit(said).cast("string"), NOW).cast("string").alias("d")).first().d
    assert got == want


def test_signals(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Well. I always walk. Fine"), (1, 1, "assistant", "I prefer tea"), (1, 2, "user", "never forget!"), (1, 3, "user", None)], "conv_id long, turn long, role string, text string")
    found = {(r.turn, r.kind): (r.trigger, r.sentence, r.confidence) for r in extracting.importance_signals(rows).collect()}
    assert found == {(0, "preference"): ("I always", "I always walk", 0.85), (2, "explicit"): ("never forget", "never forget", 0.76)}


def test_time_distance(spark):
    ago = lambda t: spark.range(1).select(extracting.time_distance(F.lit(t).cast("timestamp"), NOW).alias("x")).first().x
    want = {
        "2024-01-30 23:59:50": "less than a minute ago", "2024-01-30 23:15:31": "44 minutes ago", "2024-01-30 23:00:00": "about 1 hour ago", "2024-01-29 12:00:00": "1 day ago", "2024-01-21 00:00:00": "10 days ago",
        "2023-12-25 00:00:00": "about 1 month ago", "2023-10-03 00:00:00": "4 months ago", "2022-11-30 00:00:00": "about 1 year ago", "2022-06-30 00:00:00": "over 1 year ago", "2022-02-28 00:00:00": "almost 2 years ago",
        "2024-02-03 00:00:00": "in 3 days",
    }
    assert {t: ago(t) for t in want} == want


def test_first_fit_for_groups_of_any_size(spark):
    import random

    rng = random.Random(5)
    rows = [(g, rng.randrange(300), i, rng.choice((0, 1, 3, 7, 20, 45, 400))) for g in ("a", "b") for i in range(600)]
    df = spark.createDataFrame(rows, "g string, place long, item long, tokens long")
    want = set()
    for g in "ab":
        left = 100
        for place, item, tokens in sorted(r[1:] for r in rows if r[0] == g):
            if 1 <= tokens <= left:
                left -= tokens
                want.add((g, item))
    assert {(r.g, r.item) for r in scoring.bounded_first_fit(df, ["g"], 100).collect()} == want


def test_context_sections(spark):
    day = lambda n: datetime.datetime(2024, 1, 31) - datetime.timedelta(days=n)
    names = "memory_id long, raw string, effective double, layer string, memory_type string, safety_critical boolean, created_at timestamp, superseded_by long, consolidated_into long"
    rows = [
        (1, "a" * 40, 0.9, "IDENTITY", None, False, day(10), None, None), (2, "b" * 40, 0.8, "SESSION", "LESSON", False, day(10), None, None), (3, "c" * 40, 0.7, "PROJECT", None, False, day(10), None, None),
        (4, "d" * 40, 0.6, "TASK", None, False, day(1), None, None), (5, "e" * 40, 0.2, "TASK", None, False, day(1), None, None), (6, "f" * 40, 0.9, "TASK", None, False, day(1), 7, None),
        (7, "g" * 40, 0.9, "IDENTITY", None, False, day(20), None, None), (8, "h" * 40, 0.9, "IDENTITY", None, False, day(20), None, None), (9, "i" * 40, 0.6, "TASK", None, False, day(1), None, None),
    ]
    m = spark.createDataFrame(rows, names).withColumn("user_id", F.lit("u"))
    accesses = spark.createDataFrame([(7, day(2)), (8, day(18))], "memory_id long, ts timestamp")
    near = spark.createDataFrame([(4, 9)], "left_id long, right_id long")
    found = {r.memory_id: (r.section, r.tier, r.place) for r in scoring.context_sections(m, accesses, near, NOW, 50).collect()}
    assert found == {2: ("lessons", "critical", 1), 1: ("identity", "critical", 2), 4: ("recent", "relevant", 1), 3: ("projects", "background", 1)}
    wide = {r.memory_id for r in scoring.context_sections(m, accesses, near, NOW, 500).collect()}
    assert wide == {1, 2, 3, 4, 7}


def test_context_sections_put_the_current_project_first(spark):
    at = lambda hours: datetime.datetime(2024, 1, 31) - datetime.timedelta(hours=hours)
    names = "memory_id long, raw string, effective double, layer string, memory_type string, safety_critical boolean, created_at timestamp, superseded_by long, consolidated_into long"
    rows = [
        (1, "Building Apollo Lander, stage two", 0.9, "PROJECT", None, False, at(2), None, None), (2, "we are working on apollo lander.", 0.8, "PROJECT", None, False, at(3), None, None),
        (3, "Developing gemini", 0.9, "PROJECT", None, False, at(4), None, None), (4, "old notes on Apollo Lander", 0.5, "PROJECT", None, False, at(24 * 10), None, None),
        (5, "old notes on mercury", 0.5, "PROJECT", None, False, at(24 * 10), None, None), (6, "task: call about apollo lander", 0.7, "SESSION", "TASK", False, at(30), None, None),
        (7, "apollo lander is nice", 0.7, "SESSION", None, False, at(30), None, None), (8, "project gemini", 0.4, "PROJECT", None, False, at(1), None, None), (9, None, 0.9, "PROJECT", None, False, at(1), None, None),
    ]
    m = spark.createDataFrame(rows, names).withColumn("user_id", F.lit("u"))
    assert [tuple(r) for r in scoring.current_projects(m, NOW).collect()] == [("u", "apollo lander")]
    nothing = spark.createDataFrame([], "memory_id long, ts timestamp"), spark.createDataFrame([], "left_id long, right_id long")
    found = {r.memory_id: (r.section, r.tier, r.place) for r in scoring.context_sections(m.where("raw is not null"), *nothing, NOW, 5000).collect()}
    assert {i: found[i] for i in (4, 1, 2, 6)} == {4: ("current", "critical", 1), 1: ("current", "critical", 2), 2: ("current", "critical", 3), 6: ("current", "critical", 4)}
    assert found[5][:2] == ("projects", "background") and {found[i][:2] for i in (3, 7, 8)} == {("recent", "relevant")}
    assert scoring.current_projects(m.limit(0), NOW).count() == 0


def test_formation_guard(spark):
    turns = spark.createDataFrame([(1, 0, "assistant"), (1, 1, "user"), (1, 2, "assistant")], "conv_id long, turn long, role string")
    facts = spark.createDataFrame([(1, 1, "User likes tea", [0]), (2, 1, "User likes tea", [2]), (3, 1, "3 blocked", [1]), (4, 1, "User likes tea", []), (5, 9, "The user naps", [4]), (6, 1, None, None)], "fact_id long, conv_id long, content string, cites array<long>")
    found = {r.fact_id: r.reason for r in extracting.formation_guard(facts, turns).collect()}
    assert found == {1: "user_subject_from_assistant", 2: None, 3: "status_chatter", 4: None, 5: "user_subject_from_assistant", 6: None}


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text('full name,kind,text,stars\n"Ann ""A"" Lee",person,"two\nlines",4.5\n,brand,x,1\nBob,robot,,\n')
    sheet = extracting.read_csv(spark, f"{tmp_path}/in.csv")
    mapping = {"name": "full name", "kind": "kind", "content": "text", "importance": "stars"}
    assert extracting.missing_headers(sheet.columns, mapping | {"kind": "PERSON", "content": "gone"}) == ["gone"]
    profiles, attributes, memories, errors = extracting.map_import(sheet, mapping)
    assert [(r.name, r.kind) for r in profiles.orderBy("row").collect()] == [('Ann "A" Lee', "PERSON"), ("Bob", "PERSON")]
    assert attributes.count() == 0 and [(r.content, r.importance) for r in memories.collect()] == [("two\nlines", 5)]
    assert sorted(r.message for r in errors.collect()) == ["name is required", "unknown kind"]
    out = spark.createDataFrame([("u", [(1, "x,\"y\"")])], "user_id string, memories array<struct<memory_id:long,raw:string>>")
    extracting.write_export(out, f"{tmp_path}/nd", "ndjson")
    assert spark.read.schema(out.schema).json(f"{tmp_path}/nd").collect() == out.collect()
    extracting.write_export(out, f"{tmp_path}/csv", "csv")
    back = spark.read.csv(f"{tmp_path}/csv", header=True, escape='"').select("user_id", F.from_json("memories", out.schema["memories"].dataType).alias("memories"))
    assert back.collect() == out.collect()
    assert math.isclose(extracting.SHORT_FACTOR, 0.8)
