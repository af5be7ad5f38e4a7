"""edit_pairs finds every near pair of texts made of few syllables, and compares few others."""

import random

from loomwork.operators import dedup
from pyspark.sql import functions as F
from test_near_names import distance


def told(n, length):
    r = random.Random(7)
    words = ["th", "er", "an", "on", "in", "the", "ing", "tion", "ea", "ha", "wh", "of"]
    out = []
    for i in range(n):
        text = "".join(r.choice(words) + (" " if r.random() < 0.4 else "") for _ in range(r.randrange(1, length)))
        out.append(text)
        for _ in range(i % 3):
            at, cut = r.randrange(len(text) + 1), r.randrange(1 + max(1, len(text) // 9))
            out.append(text[:at] + "".join(r.choice("xyz ") for _ in range(r.randrange(3))) + text[at + cut :])
    return out


def test_near_texts_loses_none(spark):
    for least, length in ((0.9, 60), (0.75, 12)):
        df = spark.createDataFrame(list(enumerate(told(60, length))), "memory_id long, raw string").withColumn("user_id", F.lit("u"))
        texts = sorted({r.text for r in dedup.text_members(df).collect()})
        want = {(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if a and abs(len(a) - len(b)) <= (1 - least) * max(len(a), len(b)) + 1e-9 and distance(a, b) <= int((1 - least) * max(len(a), len(b)) + 1e-9)}
        assert want and {(r.left_text, r.right_text) for r in dedup.edit_pairs(df, least).collect()} == want


def test_few_others_are_compared(spark):
    texts = sorted({t for t in told(150, 150) if len(t) > 200})
    df = spark.createDataFrame([("u", i, t) for i, t in enumerate(texts)], "grp string, id long, text string")
    met = dedup.near_texts(df, 0.1).where("long_id <> short_id").count()
    before = dedup.edit_candidates(df, df, 0.1, 4).where("left_id < right_id").count()
    assert met < before / 5
