"""Tables that grow with the input are not broadcast, however small their files are: every copy of them passes through the driver."""

import importlib
import re

import pytest
from loomwork import session
from pyspark.sql import functions as F


@pytest.fixture
def plans(spark, monkeypatch):
    """The plans of what an operator writes, as they were run."""
    seen = []

    def spy(df, name):
        df.collect()
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return session.written(df, name)

    for module in ("dedup", "searching"):
        monkeypatch.setattr(importlib.import_module(f"loomwork.operators.{module}"), "written", spy)
    return seen


def broadcast_keys(plans):
    """The keys of joins by broadcast, but for pieces of two or three letters, of which there are only so many."""
    found = {re.sub("#[0-9]+L?", "", x) for p in plans for x in re.findall(r"BroadcastHashJoin \[(.*?)\]", p)}
    return found - {"g", "grp, g", "nb, t", "t"}


@pytest.fixture
def people(spark):
    i, name = F.col("id"), F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 9, "0"))
    return session.written(spark.range(40).select(i.alias("profile_id"), name.alias("profile_name"), F.array(F.concat(F.lit("kay "), i)).alias("aliases")), "people")


def test_edit_ratio_shuffles_its_names(spark, plans, people):
    from loomwork.operators import dedup

    # one edit, three, and more than three
    wrong = F.expr("case profile_id % 3 when 0 then overlay(profile_name placing 'y' from 10) when 1 then concat('xyz', profile_name) else concat('vwxyz', profile_name) end")
    out = dedup.edit_ratio(session.written(people.select(wrong.alias("name")), "asked"), people)
    assert {(r.name.lstrip("vwxyz")[-2:], r.profile_id) for r in out.collect()} == {(f"{i:02}", i) for i in range(40)}
    assert len(plans) > 5 and not broadcast_keys(plans)


def test_resolve_names_shuffles_its_names(spark, plans, people):
    from loomwork.operators import searching

    n = F.expr("substring(profile_name, 9, 10)")
    asked = people.select(F.expr("case profile_id % 4 when 0 then profile_name when 1 then concat('Who is ', profile_name, '?') when 2 then concat(substring(profile_name, 1, 9), substring(profile_name, 11, 9)) else concat('xusy', substring(profile_name, 5, 4), 'z', substring(profile_name, 10, 9)) end").alias("name"), n.alias("n"))
    out = searching.resolve_names(session.written(asked.select("name"), "asked"), people)
    rows = out.collect()
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(rows) == 40 and {r.how for r in rows} >= {"exact", "trigram"}
    assert not broadcast_keys(plans)
