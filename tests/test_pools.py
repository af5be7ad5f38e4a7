"""visible_pools against a plain loop."""

import random

from loomwork.operators import ingesting


def test_visible_pools(spark):
    """pairs that can be seen in one way only are not told apart; the others are, once each."""
    rng = random.Random(3)
    sessions = [(f"s{rng.randrange(12)}", rng.choice("uvw"), rng.choice(["a", "b", None])) for _ in range(20)] + [("s20", "u", "a"), ("s21", "v", "b")]
    pools = [(rng.randrange(30), rng.choice("uvw"), f"s{rng.randrange(24)}", rng.choice(["GLOBAL", "SHARED", "PRIVATE"]), rng.random() < 0.2) for _ in range(60)]
    grants = [(rng.randrange(30), rng.choice(["a", "b", "s1", "s20", "s21"]), rng.choice(["session", "agent"])) for _ in range(60)]
    want = set()
    for s, u, a in sessions:
        for p, owner, made, kind, archived in pools:
            granted = {(g, k) for q, g, k in grants if q == p}
            seen = {"GLOBAL": owner == u, "SHARED": (s, "session") in granted, "PRIVATE": made == s or (a, "agent") in granted}[kind]
            if seen and not archived:
                want.add((s, p))
    df = ingesting.visible_pools(
        spark.createDataFrame(sessions, "session_id string, user_id string, agent string"),
        spark.createDataFrame(pools, "pool_id long, user_id string, created_by string, kind string, archived boolean"),
        spark.createDataFrame(grants, "pool_id long, grantee string, grantee_kind string"),
    )
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert df._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
