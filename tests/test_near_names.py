"""Names that lie far from all profiles, or a few edits from one, are found by keys and not by all pairs."""

import random

from loomwork.operators.dedup import _few_edits, edit_ratio
from loomwork.operators.searching import _far_by_trigrams
from pyspark.sql import functions as F


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def grams(text):
    text = "  " + text.lower() + " "
    return {text[i : i + 3] for i in range(len(text) - 2)}


def people():
    r = random.Random(5)
    profiles = [f"Person#{i:06d}"[: 9 + i % 5] + "abcabc"[: i % 7] for i in range(0, 4000, 37)] + ["Ann", "Bo", "", "Person#0001"]

    def edited(text, n):
        text = list(text)
        for _ in range(n):
            at = r.randrange(len(text) + 1)
            text[at : at + r.randrange(2)] = [r.choice("xyz01a")] * r.randrange(2)
        return "".join(text)

    names = sorted({edited(p, r.randrange(1, 6)) for p in profiles for _ in range(2)} | {"", "qqq", "0000000000000000"})
    return names, profiles


def frames(spark):
    names, profiles = people()
    return names, profiles, spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(list(enumerate(profiles)), "profile_id long, profile_name string")


def test_far_names_by_trigrams(spark):
    names, profiles, a, b = frames(spark)
    for least in (0.4, 0.6):
        want = {}
        for n in names:
            s = [(round(len(grams(n) & grams(p)) / len(grams(n) | grams(p)), 6), -i) for i, p in enumerate(profiles)]
            if max(s)[0] > least:
                want[n] = (-max(s)[1], max(s)[0])
        assert {r[0]: (r[1], r[2]) for r in _far_by_trigrams(a, b, least).collect()} == want


def test_names_within_a_few_edits(spark):
    names, profiles, a, b = frames(spark)
    low = b.select(F.lit(0).alias("grp"), "profile_id", F.lower("profile_name").alias("text"))
    texts = low.select("text").distinct()
    ratios = {(n, i): (distance(n.lower(), p.lower()), max(len(n), len(p))) for n in names for i, p in enumerate(profiles)}
    best = lambda n, most: max(((round(1 - d / size, 6), -i) for (x, i), (d, size) in ratios.items() if x == n and size and d <= most and round(1 - d / size, 6) > 0.75), default=None)
    for edits in (2, 3):
        found = {r[0]: (r[2], -r[1]) for r in _few_edits(a, texts, low, texts.select(F.length("text").alias("n")).distinct(), edits, 0.75).collect()}
        assert found == {n: best(n, edits) for n in names if len(n) > edits * (edits + 1) and best(n, edits)}
    assert {r[0]: (r[2], -r[1]) for r in edit_ratio(a, b).collect()} == {n: best(n, 99) for n in names if best(n, 99)}
