"""traverse from all nodes at once: against a plain search, and without rows for each start on the way."""

import random

from loomwork import session
from loomwork.operators import graphs


def plain(starts, edges, depth):
    hop, out = {}, set()
    for a, b in edges:
        hop.setdefault(a, set()).add(b)
    for s in set(starts):
        seen, frontier = {s}, {s}
        for level in range(1, depth + 1):
            frontier = {b for a in frontier for b in hop.get(a, ())} - seen
            seen |= frontier
            out |= {(s, n, level) for n in frontier}
    return out


def test_as_a_plain_search(spark, monkeypatch):
    monkeypatch.setattr(graphs, "START_BLOCK", 3)
    r = random.Random(4)
    # 30 nodes with the same neighbours (some among themselves), others with sets of their own, loops and repeated edges
    edges = [(s, t) for s in range(30) for t in (3, 5, 40, 41)] + [(r.randrange(40, 60), r.randrange(70)) for _ in range(60)] + [(7, 3), (61, 61), (62, 61), (62, 62)]
    starts = [*range(35), 45, 50, 50, 61, 62, 99]
    e, s = spark.createDataFrame(edges, "source_id long, target_id long"), spark.createDataFrame([(x,) for x in starts], "node long")
    for depth in (1, 2, 4):
        found = [tuple(x) for x in graphs.traverse(s, e, depth).collect()]
        assert len(found) == len(set(found)) and set(found) == plain(starts, edges, depth)


def test_equal_digests_are_compared(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(0).cast("long"))
    hop = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 7), (3, 5), (3, 6), (4, 8), (4, 9)], "node long, next long")
    whose = graphs._same_neighbours(hop.select("node").distinct(), hop)
    assert {tuple(r) for r in whose.collect()} == {(1, 1), (2, 2), (3, 1), (4, 4)}


def test_no_rows_for_each_start_are_written(spark, monkeypatch):
    rows = []

    def spy(df, name):
        rows.append(df.count())
        return session.written(df, name)

    monkeypatch.setattr(graphs, "written", spy)
    e = spark.range(300).selectExpr("id + 100 as source_id", "explode(sequence(0L, 9L)) as target_id")
    assert graphs.traverse(e.selectExpr("source_id as node"), graphs.symmetric(e), 2).count() == 300 * 309
    # nothing but the edges, both ways
    assert max(rows) <= 2 * 3000
