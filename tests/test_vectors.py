"""Vector searches by pivots and by probes, and groups by leaders, against plain versions."""

import numpy as np
import pytest

from loomwork.operators import lifecycle, running, vectors


def unit_rows(seed, users, each, centres=6, spread=0.25, d=16):
    """(vec_id, user_id, v): vectors around centres, some equal, one of zeros for each user."""
    rng, rows = np.random.default_rng(seed), []
    for user in range(users):
        middle = rng.normal(size=(centres, d))
        for i in range(each[user]):
            v = middle[i % centres] + spread * rng.normal(size=d) if i % 17 else middle[0]
            v = v / np.linalg.norm(v) if i != 5 else np.zeros(d)
            rows.append((len(rows), user, [float(x) for x in v]))
    return rows


def plain_pairs(rows, asked):
    out = []
    for q in asked:
        for i, user, v in rows:
            if user == q[1] and i != q[0]:
                out.append((q[0], i, round(float(np.dot(q[2], v)), 6)))
    return out


@pytest.fixture(scope="module")
def placed(spark):
    rows = unit_rows(3, 3, [300, 40, 3])
    asked = [r for r in rows if r[0] % 4 == 0]
    return rows, asked, spark.createDataFrame(asked, "query_id long, user_id long, q array<double>"), spark.createDataFrame(rows, "vec_id long, user_id long, v array<double>").repartition(3)


@pytest.mark.parametrize("least", [0.9, 0.3, -0.5])
def test_pairs_by_pivots_lose_none(placed, least):
    rows, asked, q, v = placed
    want = {(a, b): s for a, b, s in plain_pairs(rows, asked) if s >= least}
    got = {(r.query_id, r.vec_id): r.similarity for r in vectors.similarities(q, v, least=least, block=16).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_nearest_by_pivots(placed):
    rows, asked, q, v = placed
    pairs = plain_pairs(rows, asked)
    for k in (1, 7):
        got = {}
        found = vectors.ranked(vectors.similarities(q, v, k=k, block=16), ["query_id"], [vectors.F.col("similarity").desc(), vectors.F.col("vec_id")], k)
        for r in found.collect():
            got.setdefault(r.query_id, []).append((-r.similarity, r.vec_id))
        for a in asked:
            want = sorted((-s, b) for x, b, s in pairs if x == a[0])[:k]
            assert [round(s, 5) for s, _ in sorted(got.get(a[0], []))] == [round(s, 5) for s, _ in want]


def test_pivots_skip_most_products_where_vectors_cluster(spark):
    rows = unit_rows(9, 1, [600], centres=12, spread=0.05)
    q = spark.createDataFrame(rows, "query_id long, user_id long, q array<double>")
    r = vectors.skipped_share(q, spark.createDataFrame(rows, "vec_id long, user_id long, v array<double>"), 0.95, 16).first()
    assert r.skipped > 0.5


def test_probes_find_what_is_near(spark):
    rows = unit_rows(4, 2, [700, 300], centres=40, spread=0.3)
    asked = [r for r in rows if r[0] % 10 == 0 and r[0] % 1000 != 5]
    q, v = spark.createDataFrame(asked, "query_id long, user_id long, q array<double>"), spark.createDataFrame(rows, "vec_id long, user_id long, v array<double>")
    exact = vectors.knn(q, v, 5)
    curve = vectors.recall_curve(exact, q, v, 16, tables=4, bits=8, probes=12).orderBy("probes").collect()
    assert [r.probes for r in curve] == list(range(1, 13))
    assert [r.recall for r in curve] == sorted(r.recall for r in curve) and [r.candidates for r in curve] == sorted(r.candidates for r in curve)
    assert curve[-1].recall >= 0.95 and curve[0].recall < curve[-1].recall
    every = sum(sum(1 for r in rows if r[1] == a[1]) - 1 for a in asked)
    assert curve[-1].candidates < 0.35 * every
    one = vectors.ann_candidates(q, v, 16, tables=4, bits=8, probes=12)
    assert one.count() == curve[-1].candidates
    found = {(r.query_id, r.vec_id): r.similarity for r in vectors.knn_by_probes(q, v, 5, 16, tables=4, bits=8, probes=12).collect()}
    want = {(r.query_id, r.vec_id): r.similarity for r in exact.collect()}
    assert sum(k in found for k in want) >= 0.95 * len(want)
    assert all(abs(found[k] - want[k]) < 2e-6 for k in want if k in found)


def test_probes_move_no_pairs(spark):
    rows = unit_rows(5, 2, [150, 90], centres=10, spread=0.3)
    asked = [r for r in rows if r[0] % 5 == 0]
    q, v = spark.createDataFrame(asked, "query_id long, user_id long, q array<double>"), spark.createDataFrame(rows, "vec_id long, user_id long, v array<double>")
    shape = {"dimensions": 16, "tables": 3, "bits": 4, "probes": 3}
    met = {(r.query_id, r.vec_id): r.probe for r in vectors.ann_probes(q, v, **shape).collect()}
    want = {}
    for a, b, s in plain_pairs(rows, asked):
        if (a, b) in met:
            want.setdefault(a, []).append((-s, b))
    got = {}
    for r in vectors.knn_by_probes(q, v, 4, **shape, block=16).collect():
        got.setdefault(r.query_id, []).append((-r.similarity, r.vec_id))
    assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x)[:4] for k, x in want.items()}
    counts = {r.probe: r.pairs for r in vectors.candidate_counts(q, v, **shape, block=16).collect()}
    assert counts == {p: list(met.values()).count(p) for p in set(met.values())}
    every = spark.createDataFrame([(a[0], r[0]) for a in asked for r in rows], "query_id long, vec_id long")
    assert {(r.query_id, r.vec_id): r.probe for r in vectors.probed(every, q, v, **shape).where("probe is not null").collect()} == met


def test_models_are_searched_within_a_bound(spark, monkeypatch):
    from loomwork.plans import deduping

    bounds, search = [], vectors.similarities
    monkeypatch.setattr(vectors, "similarities", lambda *a, **k: bounds.append((k.get("least"), k.get("k"))) or search(*a, **k))
    found = deduping.knn_multi_model(spark, "/root/testdata/sf0.001")
    assert bounds and all(b != (None, None) for b in bounds)
    assert found.groupBy("query_id", "model_id").count().where("count > 5").isEmpty() and not found.isEmpty()


def loop(n, links, least):
    near = {i: set() for i in range(n)}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    gone, out = set(), set()
    for i in range(n):
        if i not in gone:
            free = {x for x in near[i] if x not in gone}
            gone.add(i)
            if len(free) + 1 >= least:
                gone |= free
                out |= {(i, x) for x in free | {i}}
    return out


@pytest.mark.parametrize("least,most", [(1, 5), (2, 8), (3, 40), (3, 100_000)])
def test_leader_groups_in_prefixes(spark, least, most):
    rng = np.random.default_rng(least * 100 + most)
    n = 60
    links = {(int(a), int(b)) for a, b in rng.integers(0, n, (90, 2)) if a < b} | {(0, int(x)) for x in rng.integers(40, n, 8)}
    items = spark.createDataFrame([(i, i) for i in range(n)], "id long, place long")
    got = lifecycle.leader_groups(spark.createDataFrame(sorted(links), "a long, b long"), items, least, most)
    assert {(r.leader, r.id) for r in got.collect()} == loop(n, links, least)


def test_leader_groups_of_a_long_chain(spark, monkeypatch):
    n, calls = 10_000, []
    star, decide = lifecycle.connected_components, lifecycle._decide_in_order
    monkeypatch.setattr(lifecycle, "_decide_in_order", lambda *a: calls.append(1) or decide(*a))
    monkeypatch.setattr(lifecycle, "connected_components", lambda *a: calls.append(1) or star(*a))
    items = spark.range(n).selectExpr("id", "id as place")
    got = lifecycle.leader_groups(spark.range(n - 1).selectExpr("id as a", "id + 1 as b"), items, 2)
    assert {(r.leader, r.id) for r in got.collect()} == {(i - i % 2, i) for i in range(n)}
    assert len(calls) < 30


def test_global_rank_needs_no_single_task(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 as k").repartition(5)
    out = running.global_rank(df, [running.F.col("k").desc(), running.F.col("id")])
    want = sorted(range(1000), key=lambda i: (-(i % 7), i))
    assert [r.id for r in sorted(out.collect(), key=lambda r: r["rank"])] == want
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
    assert running.global_rank(df.limit(0), [running.F.col("id")]).count() == 0


def test_similarities_switch_to_cells_only_for_large_users(spark, placed):
    _, _, q, v = placed
    few = {tuple(r) for r in vectors.similarities(q, v, least=0.9).collect()}
    assert few == {tuple(r) for r in vectors.similarities(q, v, least=0.9, block=40).collect()} and few


def test_scratch_tables_go_with_their_scope(spark):
    from loomwork.session import scratch, written

    kept = written(spark.range(5), "kept")
    with scratch(spark):
        inside = written(spark.range(7), "inside")
        assert inside.count() == 7
    assert kept.count() == 5
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(inside.inputFiles()[0])
