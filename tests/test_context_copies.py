"""context_sections over texts with the same words: a copy goes as a near text does, and stands for the others of its words."""

import random
import shutil

from loomwork.operators import scoring
from loomwork.plans import registry
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_copies_are_near_texts(spark, tmp_path):
    r = random.Random(5)
    kinds = [[f"w{k}x{i}" for i in range(8)] for k in range(12)]
    docs = []
    for i in range(1, 400):
        ws = list(r.choice(kinds))
        if r.random() < 0.5:
            ws[r.randrange(8)] = f"own{r.randrange(4)}"
        r.shuffle(ws)
        docs.append((i, " ".join(ws), "en", f"s{i % 2}", 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    shutil.copy(f"{DATA}/events.parquet", tmp_path)
    live = {}
    touched = {r[0] for r in spark.read.parquet(f"{DATA}/events.parquet").where("ts >= timestamp '2024-01-17'").select(F.get_json_object("props", "$.k").cast("long")).collect()}
    for i, text, _, user, _ in docs:
        score = i * 53 % 101 / 100
        if score >= 0.3 and i % 31 and i % 59 and (i * 7919 % 2592000 >= 16 * 86400 or i in touched):
            live[i] = (user, score, -i, set(text.split()))
    near = lambda a, b: len(a & b) / len(a | b) > 0.7 or len(a & b) >= 0.8 * min(len(a), len(b))
    want = {i for i, (u, s, o, ws) in live.items() if not any(v == u and (s, o) < (t, p) and near(ws, xs) for v, t, p, xs in live.values())}
    assert any(live[i][3] == live[j][3] and live[i][0] == live[j][0] and i < j for i in live for j in live)
    assert {r.memory_id for r in registry.queries()["context_sections"](spark, str(tmp_path)).collect()} == want


def test_ids_stand_for_all_members(spark):
    m = spark.createDataFrame([(i, f"text {i}", s) for i, s in ((2, 0.5), (3, 0.9), (4, 0.7), (5, 0.9), (6, 0.4))], "memory_id long, raw string, effective double")
    m = m.selectExpr("*", "'u' as user_id", "'SESSION' as layer", "cast(null as string) as memory_type", "false as safety_critical", "timestamp '2024-01-30' as created_at", "cast(null as long) as superseded_by", "cast(null as long) as consolidated_into")
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6)], "memory_id long, id long")
    near = spark.createDataFrame([(1, 4), (5, 6)], "left_id long, right_id long")
    accesses = spark.createDataFrame([], "memory_id long, ts timestamp")
    # 1 is gone itself, yet its copies 2 and 3 meet each other and 4
    assert {r.memory_id for r in scoring.context_sections(m, accesses, near, "2024-01-31 00:00:00", 1000, members=members).collect()} == {3, 5}


def test_near_pairs_are_sought_among_rows_in_use(spark, tmp_path, monkeypatch):
    from loomwork.operators import dedup

    # all texts are alike; one row in two is too weak, replaced or stale
    docs = spark.range(1, 201).selectExpr("id as doc_id", "concat('a b c d e f g h i ', id) as text", "'en' as lang", "'s' as source", "0L as n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    shutil.copy(f"{DATA}/events.parquet", tmp_path)
    asked = []
    real = dedup.text_near_dup
    monkeypatch.setattr(dedup, "text_near_dup", lambda df: asked.append(df.count()) or real(df))
    found = registry.queries()["context_sections"](spark, str(tmp_path)).collect()
    assert len(found) == 1 and asked[0] <= 140
