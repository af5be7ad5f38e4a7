"""mention_detect against a plain loop."""

import random
import re

from loomwork.operators import graphs


def test_names_of_the_same_profiles_are_one_set(spark):
    """a text takes a set of profiles once, however many of their names it holds."""
    rng = random.Random(11)
    texts = [(i, rng.choice([" ", "-", "  "]).join(rng.choice(["red", "Fox", "a", "b2"]) for _ in range(rng.randrange(9)))) for i in range(50)] + [(99, None)]
    names = [(rng.randrange(6), " ".join(rng.choice(["red", "fox", "A", "b2"]) for _ in range(rng.randrange(1, 4))), rng.choice([0.9, 1.0])) for _ in range(30)] + [(7, "--", 1.0)]
    plain = lambda t: " ".join(re.findall("[a-z0-9]+", (t or "").lower()))
    want = {}
    for m, raw in texts:
        for p, name, c in names:
            if plain(name) and f" {plain(name)} " in f" {plain(raw)} ":
                want[m, p] = max(c, want.get((m, p), 0))
    found = graphs.mention_detect(spark.createDataFrame(texts, "memory_id long, raw string"), spark.createDataFrame(names, "profile_id long, name string, confidence double"))
    rows = found.collect()
    assert len(rows) == len(want) and {(r.memory_id, r.profile_id): r.confidence for r in rows} == want
    assert "holders" in found._jdf.queryExecution().analyzed().toString()
