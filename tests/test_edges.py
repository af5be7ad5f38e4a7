"""Word edges that are cheap to look for stand where the plain ones do."""

import random
import re

from pyspark.sql import functions as F

from loomwork.operators import extracting, texts

PATTERNS = [
    *texts.PREFERENCE_SIGNS, *texts.FACT_SIGNS, *extracting.STATE_SIGNS.values(), *[p for p, _ in texts.SAFETY_PATTERNS], *[p for p, _ in extracting.PREFERENCES],
    r"\b(?:a|b)?c\b", r"\b(ab|c?d)\b", r"\b[ab]|c\b", r"(\b(x)\b)|y", r"\b(a[)|]|b)c",
]


def test_edges_stand_where_they_did():
    rng = random.Random(7)
    pieces = ["a", "b", "c", "d", "x", "y", " ", "_", "é", "-", "ab", "I like", "goal", "my son", "drug", "i  prefer tea", "a)c", "done", "1"]
    said = ["".join(rng.choice(pieces) for _ in range(rng.randrange(9))) for _ in range(3000)]
    for p in PATTERNS:
        plain = "(?i)" + p.replace(r"\b", texts._EDGE)
        assert [[m.span() for m in re.finditer(plain, s)] for s in said] == [[m.span() for m in re.finditer(texts.java(p), s)] for s in said], p


def test_signs_share_an_edge(spark):
    """durability (F33): one look back for all signs, where each had four looks around."""
    assert texts.java(r"\bi like").count("(?<") == 1
    plan = spark.range(1).select(texts.any_of(F.col("id").cast("string"), texts.PREFERENCE_SIGNS).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("(?<![A-Za-z0-9_])(?:i prefer") == 1
    rows = spark.createDataFrame([("zI like tea, more than anything else",), ("so I LIKE tea, more than anything else",), ("I like",), (None,)], "t string")
    assert [r[0] for r in rows.select(texts.durability(F.col("t"))).collect()] == ["EPHEMERAL", "DURABLE", "EPHEMERAL", "EPHEMERAL"]


def test_phrases_are_worked_out_once(spark):
    """preference_signals (F29): the rules' array is named once, however often the answer needs it."""
    t = spark.createDataFrame([("I prefer dark, always use tabs. I like DARK", "X"), ("plain", "PREFERENCE"), ("plain", None)], "raw string, kind string")
    got = t.select(extracting.preference_signals(F.col("raw"), F.col("kind")).alias("p"))
    assert got._jdf.queryExecution().analyzed().toString().count(r"usually\s+([^") == 2
    assert [[tuple(x) for x in r.p] for r in got.collect()] == [[("dark", "strong"), ("tabs", "strong")], [("plain", "moderate")], []]
