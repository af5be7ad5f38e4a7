"""Clustering, consolidation, tiering, rescoring and corrections of memories."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.analytics import count_if, hours_before
from loomwork.operators.components import connected_components
from loomwork.operators.scoring import ranked
from loomwork.session import written


def dbscan(neighbours: DataFrame, nodes: DataFrame, min_points: int = 3) -> DataFrame:
    """(id, cluster, role) from neighbours(a, b) within the radius, both directions given, a row not its own neighbour.

    Rows with min_points neighbours or more are core; linked cores are a cluster, named by its smallest core. A border row goes to
    the smallest of the clusters it touches, whatever the order of visits; the rest is noise with a null cluster.
    """
    core = neighbours.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= min_points).select(F.col("a").alias("core"))
    between = neighbours.where("a < b").join(core.withColumnRenamed("core", "a"), "a").join(core.withColumnRenamed("core", "b"), "b").select("a", "b")
    named = core.join(connected_components(between, "a", "b").withColumnRenamed("node", "core"), "core", "left").select("core", F.coalesce("component", "core").alias("cluster"))
    border = neighbours.join(core.withColumnRenamed("core", "a"), "a", "left_anti").join(named.withColumnRenamed("core", "b"), "b").groupBy("a").agg(F.min("cluster").alias("border"))
    rows = nodes.select("id").join(named.withColumnRenamed("core", "id"), "id", "left").join(border.withColumnRenamed("a", "id"), "id", "left")
    role = F.when(F.col("cluster").isNotNull(), "core").when(F.col("border").isNotNull(), "border").otherwise("noise")
    return rows.select("id", F.coalesce("cluster", "border").alias("cluster"), role.alias("role"))


def cluster_centroids(members: DataFrame) -> DataFrame:
    """(cluster, size, centroid): element-wise means of members(cluster, embedding)."""
    size = members.groupBy("cluster").agg(F.count("*").alias("size"))
    means = members.select("cluster", F.posexplode("embedding").alias("i", "x")).groupBy("cluster", "i").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("x"))
    vector = means.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centroid"))
    return size.join(vector, "cluster")


def cluster_labels(members: DataFrame, n: int = 3) -> DataFrame:
    """(cluster, label): the n most frequent words of more than three letters of members(cluster, raw), joined; ties by the word."""
    words = members.select("cluster", F.explode(F.split(F.lower("raw"), "[^a-z0-9]+")).alias("w")).where(F.length("w") > 3)
    counts = words.groupBy("cluster", "w").agg(F.count("*").alias("c"))
    top = ranked(counts, ["cluster"], [F.col("c").desc(), F.col("w")], n)
    return top.groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "w"))), lambda p: p["w"]), ", ").alias("label"))


#: Links of a component that one task decides in order; more is far beyond what a task should take minutes for.
MOST_LINKS = 200_000


def leader_groups(pairs: DataFrame, items: DataFrame, least_size: int = 3, most_links: int = MOST_LINKS) -> DataFrame:
    """(leader, id): in order of items(id, place), each row that no earlier leader took leads those linked to it that are still free.

    Groups under least_size release their members, and their leader is left out. Rows that share no links, directly or over others, do
    not bear on each other, so components of up to most_links links are each decided by one loop in their task. What is larger is taken in
    prefixes of the order, whose rows depend on no later ones: a prefix is cut until its components are small, and grows again
    while they are. Where even so a component is too large, as around a hub, the rows that nothing stands before are decided
    at once. Places must be numbers; equal ones go by id.
    """
    place = items.select("id", "place")
    at = lambda x: place.select(F.col("id").alias(x), F.col("place").alias(f"p{x}"))
    both = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    before = F.struct("pa", "a") < F.struct("pb", "b")
    links = written(both.join(at("a"), "a").join(at("b"), "b").where(before).select("a", "pa", "b", "pb"), "links")
    done, share = [], 1.0
    while True:
        part = _prefix(links, share)
        if part is None:
            break
        members = connected_components(part, "a", "b")
        named = part.join(members.withColumnRenamed("node", "a"), "a")
        sizes = written(named.groupBy("component").agg((F.count("*") > most_links).alias("large")), "component-sizes")
        too_large = sizes.where("large").limit(1).count() > 0
        small = named.join(sizes.where("not large").select("component"), "component", "left_semi")
        decided = _decide_in_order(small, least_size)
        settled = small.select("a")
        if too_large:
            firsts, gone = _decide_first(named.join(sizes.where("large").select("component"), "component", "left_semi"), least_size)
            decided, settled = decided.unionAll(firsts), settled.unionAll(gone)
        decided = written(decided, "decided")
        done.append(decided)
        if share == 1.0 and not too_large:
            break
        gone = settled.unionAll(decided.select("id")).distinct()
        gone = written(gone.select(F.col("a").alias("gone")), "gone")
        links = written(links.join(gone, links["a"] == gone["gone"], "left_anti").join(gone, links["b"] == gone["gone"], "left_anti"), "links")
        share = share / 8 if too_large else min(1.0, share * 4)
    out = place.select(F.col("id").alias("leader"), "id").limit(0)
    for df in done:
        out = out.unionAll(df)
    if least_size <= 1:  # then a row that none took leads, if only itself
        out = out.unionAll(place.join(out.select("id"), "id", "left_anti").select(F.col("id").alias("leader"), "id"))
    return out


def _prefix(links: DataFrame, share: float) -> DataFrame | None:
    """The links of about this share of the rows that lead to others, from the first in order; None if there are none."""
    if share == 1.0:
        return links if links.limit(1).count() else None
    places = links.select("a", "pa").distinct()
    cut = places.agg(F.percentile_approx("pa", share, 10_000).alias("cut")).first()["cut"]
    return None if cut is None else links.where(F.col("pa") <= F.lit(cut))


def _decide_in_order(links: DataFrame, least_size: int) -> DataFrame:
    """(leader, id) of links(component, a, pa, b, pb) from each a to the later b, a component in one task."""
    kind = dict(links.dtypes)["a"]

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        rows, gone, out = rows.sort_values(["pa", "a", "pb", "b"]), set(), []
        for a, others in rows.groupby(["pa", "a"], sort=False)["b"]:
            if a[1] not in gone:
                free = [b for b in others if b not in gone]
                if len(free) + 1 >= least_size:
                    gone.update(free)
                    out += [(a[1], a[1]), *((a[1], b) for b in free)]
        return pd.DataFrame(out, columns=["leader", "id"])

    return links.groupBy("component").applyInPandas(decide, f"leader {kind}, id {kind}")


def _decide_first(links: DataFrame, least_size: int) -> tuple[DataFrame, DataFrame]:
    """((leader, id), (a)): what rows decide that stand before all rows they compete with, and those rows."""
    first = links.groupBy("b").agg(F.min(F.struct("pa", "a")).alias("first"))
    rows = links.select("a", "pa").distinct().join(links.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    alone = links.join(rows.select("a"), "a", "left_semi").join(first, "b").groupBy("a").agg(F.min((F.col("first.a") == F.col("a"))).alias("ok"), F.count("*").alias("n")).where("ok")
    lead = alone.where(F.col("n") + 1 >= least_size).select("a")
    taken = links.join(lead, "a", "left_semi").select(F.col("a").alias("leader"), F.col("b").alias("id"))
    return taken.unionAll(lead.select("a", F.col("a").alias("id"))), alone.select("a")


def tier(now: str) -> Column:
    """HOT for pinned, lately used or new rows, COLD for old ones hardly used, else WARM."""
    used, age = hours_before(now, F.col("last_retrieved_at")) / 24, hours_before(now, F.col("created_at")) / 24
    hot = F.col("user_pinned") | F.coalesce(used <= 7, F.lit(False)) | (age <= 2)
    cold = F.coalesce(used > 30, F.lit(True)) & (F.col("retrieval_count") < 3) & (age > 90)
    return F.when(hot, "HOT").when(F.coalesce(used <= 30, F.lit(False)) | (F.col("retrieval_count") >= 3), "WARM").when(cold, "COLD").otherwise("WARM")


def tier_changes(df: DataFrame, before: str = "tier_before", after: str = "tier_after") -> DataFrame:
    """(user_id, promoted, demoted, unchanged)."""
    height = lambda c: F.when(F.col(c) == "HOT", 2).when(F.col(c) == "WARM", 1).otherwise(0)
    up = height(after) - height(before)
    return df.groupBy("user_id").agg(count_if(up > 0).alias("promoted"), count_if(up < 0).alias("demoted"), count_if(up == 0).alias("unchanged"))


# Factors of a layer.
RESCORE_LAYERS = {"IDENTITY": 1.5, "PROJECT": 1.3, "INSIGHT": 1.2, "SESSION": 1.0, "TASK": 0.8}


def rescore(now: str) -> Column:
    """importance * recency * usage * decay * layer, within 0.35 (0 if kept from search) and 1; changes under 0.001 don't count."""
    days, age = hours_before(now, F.col("last_retrieved_at")) / 24, hours_before(now, F.col("created_at")) / 24
    recency = F.when(days.isNull(), 0.5).otherwise(F.greatest(F.lit(0.3), F.exp(-0.05 * days)))
    usage = 1 + 0.3 * F.log10(F.greatest(F.lit(1), F.col("used_count")).cast("double"))
    decay = F.when(F.col("retrieval_count") == 0, F.greatest(F.lit(0.2), F.exp(-0.02 * age))).otherwise(1.0)
    layer = F.coalesce(*[F.when(F.col("layer") == x, f) for x, f in RESCORE_LAYERS.items()], F.lit(1.0))
    s = F.least(F.lit(1.0), F.greatest(F.when(F.col("searchable"), 0.35).otherwise(0.0), F.col("importance") * recency * usage * decay * layer))
    return F.when(F.abs(s - F.col("effective")) < 0.001, F.col("effective")).otherwise(s)


def archival_candidates(df: DataFrame, now: str, importance: float = 0.15, days: int = 90, idle: int = 30) -> DataFrame:
    """Rows that could be archived; reported only, nothing is archived."""
    since = lambda c: hours_before(now, F.col(c)) / 24
    unused = F.coalesce(since("last_retrieved_at") > idle, F.lit(True)) & F.coalesce(since("last_used_at") > idle, F.lit(True))
    return df.where((F.col("effective") < importance) & (since("created_at") > days) & unused & (F.col("used_count") <= 5) & ~F.col("user_pinned") & ~F.col("layer").isin("IDENTITY", "PROJECT"))


def sanity_gate(counts: DataFrame, share: float = 0.9, least: int = 10) -> DataFrame:
    """Adds passed to counts(touched, total): a stage must touch its share of the rows, if there are `least` or more."""
    return counts.withColumn("passed", (F.col("total") < least) | (F.col("touched") >= F.floor(F.col("total") * share)))


def consolidation_audit(df: DataFrame) -> DataFrame:
    """(problem, n) over rows that name a replacement: it is missing, another user's, hidden, or has no vector."""
    old = df.where("consolidated_into is not null").select("memory_id", "user_id", "consolidated_into")
    new = df.select(F.col("memory_id").alias("consolidated_into"), F.col("user_id").alias("owner"), (F.col("user_hidden") | ~F.col("searchable")).alias("hid"), (F.col("embedding_status") != "DONE").alias("bare"))
    rows = old.join(new, "consolidated_into", "left")
    problem = F.when(F.col("owner").isNull(), "missing").when(F.col("owner") != F.col("user_id"), "wrong owner").when(F.col("hid"), "hidden").when(F.col("bare"), "no vector").otherwise("ok")
    return rows.groupBy(problem.alias("problem")).agg(F.count("*").alias("n"))


def promote_pool(members: DataFrame, shared: DataFrame, least: float = 0.7) -> DataFrame:
    """Rows of a finished session's pool to add to the shared one: effective enough and not yet in it."""
    return members.where(F.col("effective") >= least).join(shared.select("memory_id"), "memory_id", "left_anti")


def apply_corrections(originals: DataFrame, corrections: DataFrame) -> DataFrame:
    """(correction_id, original_id, status, importance): applied unless the original is missing, deleted or replaced already."""
    rows = corrections.join(originals.select(F.col("memory_id").alias("original_id"), "importance", "deleted_at", "superseded_by"), "original_id", "left")
    status = F.when(F.col("importance").isNull(), "missing").when(F.col("deleted_at").isNotNull(), "deleted").when(F.col("superseded_by").isNotNull(), "superseded").otherwise("applied")
    return rows.select("correction_id", "original_id", status.alias("status"), F.when(status == "applied", F.round(F.least(F.lit(1.0), F.col("importance") + 0.1), 6)).alias("importance"))


def entity_anchors(mentions: DataFrame, existing_tags: DataFrame) -> DataFrame:
    """(user_id, tag): an anchor tag for each person or organisation of mentions(user_id, name, kind) that has none yet."""
    tag = F.concat(F.lit("entity:"), F.regexp_replace(F.lower(F.trim("name")), "[^a-z0-9]+", "-"))
    wanted = mentions.where(F.col("kind").isin("person", "organization")).select("user_id", tag.alias("tag")).distinct()
    return wanted.join(existing_tags.select("user_id", F.explode("tags").alias("tag")).distinct(), ["user_id", "tag"], "left_anti")


def recurring_patterns(groups: DataFrame, items: DataFrame) -> DataFrame:
    """(leader, canonical, size, importance): of each group the longest text, then the most important, newest and smallest id; it gains 0.2."""
    rows = groups.join(items.select("id", F.length("raw").alias("n"), "importance", F.unix_timestamp("created_at").alias("at")), "id")
    out = rows.groupBy("leader").agg(F.max_by(F.struct("id", "importance"), F.struct("n", "importance", "at", -F.col("id"))).alias("c"), F.count("*").alias("size"))
    return out.select("leader", F.col("c.id").alias("canonical"), "size", F.round(F.least(F.lit(1.0), F.col("c.importance") + 0.2), 6).alias("importance"))


def pattern_candidates(groups: DataFrame, known: DataFrame, least: int = 3) -> DataFrame:
    """(leader, size, score): groups of `least` or more that share no row with a known pattern(source_id)."""
    taken = groups.join(known.select(F.col("source_id").alias("id")), "id", "left_semi").select("leader").distinct()
    rows = groups.join(taken, "leader", "left_anti").groupBy("leader").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return rows.withColumn("score", F.round(F.least(F.lit(0.9), 0.5 + 0.05 * F.col("size")), 6))
