"""Near word sets meet as blocks: against all pairs, in blocks of any size, without moving the pairs that share a word."""

import random

import numpy as np
import pandas as pd
from loomwork.operators import dedup
from pyspark.sql import functions as F


def sets(n):
    r = random.Random(3)
    out = []
    for i in range(n):
        ws = {f"w{min(r.randrange(400), r.randrange(400))}" for _ in range(r.randrange(1, 40))} | {"the", "of", f"own{i}"}
        out.append((f"u{i % 2}", i, sorted(ws)))
        if i % 3 == 0:
            out.append((f"u{i % 2}", 1000 + i, sorted(set(r.sample(sorted(ws), max(1, len(ws) * 9 // 10))) | {f"new{i}"})))
    return out


def test_near_words_in_blocks(spark):
    rows = sets(150)
    df = spark.createDataFrame([(u, i, w, len(w)) for u, i, w in rows], "user_id string, id long, ws array<string>, n int")
    want = set()
    for u, i, a in rows:
        for v, j, b in rows:
            c = len(set(a) & set(b))
            if u == v and i < j and (c / (len(a) + len(b) - c) > 0.7 or c >= 0.8 * min(len(a), len(b))):
                want.add((i, j))
    assert len(want) > 30
    for block in (dedup.SET_BLOCK, 7):
        met = [(min(r), max(r)) for r in dedup.near_word_sets(df, 0.7, 0.8, block=block).collect()]
        assert len(met) == len(set(met)) and want <= set(met) and len(met) < 2 * len(want)
    found = dedup.text_near_dup(df.select("user_id", F.col("id").alias("memory_id"), F.col("ws").alias("words")))
    assert {tuple(r) for r in found.collect()} == want


def test_chunks_of_counts_change_nothing(spark, monkeypatch):
    rng = random.Random(1)
    ws = [sorted(rng.sample(range(60), rng.randrange(4, 20))) for _ in range(80)]
    right = pd.DataFrame({"b": range(80), "nb": [len(w) for w in ws], "wb": [np.array(w, np.int32) for w in ws]})
    left = right.set_axis(["a", "na", "wa"], axis=1).assign(need=[max(1, len(w) // 2) for w in ws], least=[min(2, max(1, len(w) // 2)) for w in ws], first=[len(w) - max(1, len(w) // 2) + min(2, max(1, len(w) // 2)) for w in ws])
    whole = dedup._near_sets(left, right)
    monkeypatch.setattr(dedup, "COUNTED", 100)
    parts = dedup._near_sets(left, right)
    want = {(i, j) for i in range(80) for j in range(80) if i != j and (len(ws[i]), i) < (len(ws[j]), j) and len(set(ws[i]) & set(ws[j])) >= max(1, len(ws[i]) // 2)}
    assert want <= {tuple(x) for x in whole.to_numpy()} and {tuple(x) for x in whole.to_numpy()} == {tuple(x) for x in parts.to_numpy()}


def test_pairs_are_told_where_they_meet(spark):
    from tests.test_shared_answers import rows_made

    df = spark.createDataFrame([(u, i, w) for u, i, w in sets(150)], "user_id string, memory_id long, words array<string>")
    out = dedup.text_near_dup(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # one join, with the users' numbers of blocks: words of pairs are not fetched
    assert plan.count("Join") == 1 and "array_intersect" not in plan
    assert rows_made(out) <= 210


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    real, seeds = F.xxhash64, []

    def poor(*c):
        if len(c) == 2 and c[1]._jc.toString() == "0":
            seeds.append(0)
            return F.length(c[0]).cast("long") + (1 << 40)
        return real(*c)

    monkeypatch.setattr(F, "xxhash64", poor)
    df = spark.createDataFrame([("u", 1, ["aa", "bb", "cc"]), ("u", 2, ["dd", "ee", "ff"]), ("u", 3, ["aa", "bb", "cc", "gg"])], "user_id string, memory_id long, words array<string>")
    assert [tuple(r) for r in dedup.text_near_dup(df).collect()] == [(1, 3)] and seeds
