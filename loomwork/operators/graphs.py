"""Graph traversal, entity resolution and recall over edge tables, from all starts at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.analytics import count_if
from loomwork.operators.scoring import ranked
from loomwork.session import shared_dir, shuffled, spread, written


def symmetric(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), *[c for c in edges.columns if c not in ("source_id", "target_id")])
    return edges.unionByName(back)


def traverse(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(start_id, node, depth): what each start reaches over directed edges within `depth` steps, at its smallest depth.

    Level by level: a level joins the frontier with the edges and drops what the start has seen. The start itself is left out. Starts with the same neighbours reach the same
    nodes at the same depths, but for themselves, so one of them goes for all, and what it reaches meets the others at the end.
    """
    shared_dir(starts.sparkSession)
    hop = written(edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("next")).distinct(), "hops")
    whose = written(_same_neighbours(starts.select("node").distinct(), hop), "whose-neighbours")
    # its own node is kept for the others, who may reach it
    firsts = whose.select(F.col("as_id").alias("start_id")).distinct()
    seen = written(firsts.join(shuffled(hop.withColumnRenamed("node", "start_id")), "start_id").select("start_id", F.col("next").alias("node"), F.lit(1).alias("depth")), "reached")
    frontier = seen.select("start_id", "node")
    for level in range(2, depth + 1):
        reached = frontier.join(shuffled(hop), "node").select("start_id", F.col("next").alias("node")).distinct()
        frontier = written(reached.join(shuffled(seen.select("start_id", "node")), ["start_id", "node"], "left_anti"), "reached")
        seen = seen.unionAll(frontier.withColumn("depth", F.lit(level)))
    # many starts of one set of neighbours are dealt into blocks, each of which meets what they reach
    sizes = whose.groupBy("as_id").agg(F.ceil(F.count("*") / START_BLOCK).cast("int").alias("blocks"))
    blocks = seen.withColumnRenamed("start_id", "as_id").join(shuffled(sizes), "as_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = whose.join(shuffled(sizes), "as_id").select("as_id", F.pmod(F.xxhash64("start_id"), F.col("blocks")).cast("int").alias("block"), "start_id")
    return blocks.join(shuffled(asked), ["as_id", "block"]).where(f"node <> start_id and depth <= {depth}").select("start_id", "node", "depth")


#: Starts with the same neighbours that meet in a task.
START_BLOCK = 1024


def _same_neighbours(starts: DataFrame, hop: DataFrame) -> DataFrame:
    """(start_id, as_id): for each of starts(node) that hop(node, next) leads on from, one start with the same neighbours.

    Sets of neighbours are found by digests of them and then compared, neighbour by neighbour; a start that only has another's digest stands for itself.
    """
    own = hop.join(shuffled(starts), "node", "left_semi")
    marks = own.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("next")).alias("a"), F.bit_xor(F.xxhash64("next", F.lit(1))).alias("b"))
    marks = written(marks, "neighbour-digests")
    named = marks.join(shuffled(marks.groupBy("n", "a", "b").agg(F.min("node").alias("as_id"))), ["n", "a", "b"]).select("node", "as_id", "n")
    both = own.join(shuffled(named), "node").join(shuffled(hop.select(F.col("node").alias("as_id"), "next", F.lit(1).alias("hit"))), ["as_id", "next"], "left")
    return both.groupBy("node", "as_id", "n").agg(F.count("hit").alias("c")).select(F.col("node").alias("start_id"), F.when(F.col("c") == F.col("n"), F.col("as_id")).otherwise(F.col("node")).alias("as_id"))


def shortest_paths(pairs: DataFrame, edges: DataFrame, depth: int = 4) -> DataFrame:
    """(start_id, end_id, hops, path): for each pair the fewest hops, of those paths the one whose nodes come first.

    A node keeps its first path from a start only, so a level has at most one row for each start and node.
    """
    shared_dir(pairs.sparkSession)
    hop = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("next")).distinct()
    seen = pairs.select("start_id").distinct().select("start_id", F.col("start_id").alias("node"), F.array("start_id").alias("path"))
    frontier = seen
    for _ in range(depth):
        far = frontier.join(hop, "node").groupBy("start_id", F.col("next").alias("node")).agg(F.min(F.concat("path", F.array("next"))).alias("path"))
        frontier = far.join(seen.select("start_id", "node"), ["start_id", "node"], "left_anti").checkpoint()
        seen = seen.unionAll(frontier)
    return pairs.join(seen.withColumnRenamed("node", "end_id"), ["start_id", "end_id"]).select("start_id", "end_id", (F.size("path") - 1).alias("hops"), "path")


def shared_entity_edges(mentions: DataFrame, most: int = 10) -> DataFrame:
    """(low_id, high_id, shared, confidence): memories that share entities, among each entity's `most` most important ones.

    mentions(entity, memory_id, importance, created_at). The bound is the operator's: an entity gives 45 pairs at most.
    """
    top = ranked(mentions, ["entity"], [F.col("importance").desc(), F.col("created_at").desc(), F.col("memory_id")], most).select("entity", "memory_id")
    pairs = top.select("entity", F.col("memory_id").alias("low_id")).join(top.select("entity", F.col("memory_id").alias("high_id")), "entity").where("low_id < high_id")
    n = pairs.groupBy("low_id", "high_id").agg(F.count("*").alias("shared"))
    return n.withColumn("confidence", F.round(0.5 + F.least(F.lit(0.4), 0.05 * F.col("shared")), 6))


def restrict_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are among nodes(node)."""
    return edges.join(nodes.select(F.col("node").alias("source_id")), "source_id", "left_semi").join(nodes.select(F.col("node").alias("target_id")), "target_id", "left_semi")


def mention_detect(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(memory_id, profile_id, confidence): profiles whose name (1.0) or alias (0.9) stands in a text as whole words.

    texts(memory_id, raw), names(profile_id, name, confidence). The text's runs of as many words as names have are looked up, so texts
    and profiles meet by equality. The names' different numbers of words are read first: a few rows. Names that the same profiles have are one set of
    profiles to a text, which takes each set once, whatever the number of its names.
    """
    from loomwork.operators.searching import asked_keys_only, runs_of_words

    known = names.select("profile_id", F.trim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", " ")).alias("name"), "confidence").where("name <> ''")
    known = known.groupBy("name").agg(F.sort_array(F.collect_set(F.struct("profile_id", "confidence"))).alias("holders"))
    known = written(known.withColumn("key", F.xxhash64("name")), "names")
    sets = written(known.select("holders").distinct().withColumn("set", F.monotonically_increasing_id()), "profile-sets")
    named = written(known.join(sets, "holders").select("name", "key", "set"), "set-names")
    sizes = sorted(r[0] for r in named.select(F.size(F.split("name", " "))).distinct().collect())
    runs = spread(texts.select("memory_id", "raw")).select("memory_id", F.explode(runs_of_words(F.col("raw"), sizes)).alias("name"))
    runs = asked_keys_only(runs.withColumn("key", F.xxhash64("name")), named).select("memory_id", "name")
    met = runs.join(named.select("name", "set"), "name").select("memory_id", "set").distinct()
    rows = met.join(sets, "set").select("memory_id", F.inline("holders"))
    return rows.groupBy("memory_id", "profile_id").agg(F.max("confidence").alias("confidence"))


def attach_profiles(mentions: DataFrame, near: DataFrame, attached: DataFrame, least: float = 0.75) -> DataFrame:
    """(memory_id, profile_id, method, score): mentions, else vector neighbours, of `least` or more that aren't attached yet."""
    both = mentions.select("memory_id", "profile_id", F.lit(0).alias("order"), F.col("confidence").alias("score")).unionAll(near.select("memory_id", "profile_id", F.lit(1), "similarity"))
    best = both.where(F.col("score") >= least).join(attached, ["memory_id", "profile_id"], "left_anti")
    best = best.groupBy("memory_id", "profile_id").agg(F.min_by(F.struct("order", "score"), F.struct("order", -F.col("score"))).alias("b"))
    return best.select("memory_id", "profile_id", F.when(F.col("b.order") == 0, "mention").otherwise("vector").alias("method"), "b.score")


def resolve_entities(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, kind, entity_id, how): exact name and kind, else alias, else a name with the same first word at an edit distance up to 2, else new."""
    m = mentions.select("name", "kind").distinct()
    exact = m.join(entities.select("entity_id", F.col("entity_name").alias("name"), "kind"), ["name", "kind"]).select("name", "kind", "entity_id", F.lit(0).alias("tier"))
    alias = m.join(entities.select("entity_id", "kind", F.explode("aliases").alias("name")), ["name", "kind"]).select("name", "kind", "entity_id", F.lit(1).alias("tier"))
    first = lambda c: F.substring_index(c, " ", 1)
    near = m.withColumn("f", first(F.col("name"))).join(entities.select("entity_id", "entity_name", "kind", first(F.col("entity_name")).alias("f")), ["f", "kind"])
    near = near.where((F.length("f") > 2) & (F.expr("levenshtein(name, entity_name, 2)") >= 0)).select("name", "kind", "entity_id", F.lit(2).alias("tier"))
    best = exact.unionAll(alias).unionAll(near).groupBy("name", "kind").agg(F.min(F.struct("tier", "entity_id")).alias("b"))
    how = F.element_at(F.array(*map(F.lit, ("exact", "alias", "similar"))), F.col("b.tier") + 1)
    return m.join(best, ["name", "kind"], "left").select("name", "kind", F.col("b.entity_id").alias("entity_id"), F.coalesce(F.when(F.col("b.tier").isNotNull(), how), F.lit("new")).alias("how"))


def upsert_relationships(seen: DataFrame, symmetric_types: list[str]) -> DataFrame:
    """(source_id, target_id, edge_type, weight, n): one edge for each pair and type, its weight 0.8 old + 0.2 new in order of time.

    seen(source_id, target_id, edge_type, at, weight). Self loops are dropped; symmetric types get the inverse edge too. The fold has a closed
    form: the k-th of n observations counts 0.2 * 0.8 ** (n - k), the first 0.8 ** (n - 1), so any order of rows adds up the same.
    """
    rows = seen.where("source_id <> target_id")
    back = rows.where(F.col("edge_type").isin(symmetric_types))
    rows = rows.unionByName(back.withColumns({"source_id": F.col("target_id"), "target_id": F.col("source_id")}))
    keys = ["source_id", "target_id", "edge_type"]
    late = ranked(rows, keys, [F.col("at").desc(), F.col("weight").desc()], None, "late")
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    part = F.pow(F.lit(0.8), F.col("late") - 1.0) * F.when(F.col("late") == F.col("n"), 1.0).otherwise(0.2)
    return late.join(n, keys).groupBy(*keys).agg(F.round(F.sum(F.col("weight") * part), 6).alias("weight"), F.count("*").alias("n"))


def entity_stats(edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """(entity, mentions, relations)."""
    ends = symmetric(edges).groupBy(F.col("source_id").alias("entity")).agg(F.countDistinct("target_id").alias("relations"))
    n = mentions.groupBy("entity").agg(F.count("*").alias("mentions"))
    return n.join(ends, "entity", "full").select("entity", F.coalesce("mentions", F.lit(0)).alias("mentions"), F.coalesce("relations", F.lit(0)).alias("relations"))


def alike(queries: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(query_id, column) of one query for each set of values, and (query_id, as_id): whose answer each query takes.

    What follows from the set alone is worked out once for a set, so queries that ask the same don't meet the memories again.
    """
    sets = queries.where(F.col(column).isNotNull()).groupBy("query_id").agg(F.sort_array(F.collect_set(column)).alias("set"))
    firsts = sets.groupBy("set").agg(F.min("query_id").alias("as_id"))
    asked = firsts.select(F.col("as_id").alias("query_id"), F.explode("set").alias(column))
    return asked, sets.join(firsts, "set").select("query_id", "as_id")


def _each(answers: DataFrame, whose: DataFrame) -> DataFrame:
    return whose.join(answers.withColumnRenamed("query_id", "as_id"), "as_id").drop("as_id")


def graph_recall(query_entities: DataFrame, edges: DataFrame, mentions: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, memory_id, score): memories of a query's entities and of those one hop away, 0.7 + 0.1 for each further hit, at most 1."""
    one = symmetric(edges).select(F.col("source_id").alias("entity"), F.col("target_id").alias("near")).distinct()
    asked, whose = alike(query_entities, "entity")
    both = asked.unionAll(asked.join(one, "entity").select("query_id", F.col("near").alias("entity"))).distinct()
    hits = both.join(mentions.select("entity", "memory_id").distinct(), "entity").groupBy("query_id", "memory_id").agg(F.count("*").alias("hits"))
    rows = hits.withColumn("score", F.round(F.least(F.lit(1.0), 0.7 + 0.1 * (F.col("hits") - 1)), 6))
    best = ranked(rows, ["query_id"], [F.col("score").desc(), F.col("memory_id")], k)
    return _each(best, whose).select("query_id", "memory_id", "score", "rank")


def radiate(query_entities: DataFrame, edges: DataFrame, mentions: DataFrame, k: int = 3, least: float = 0.3) -> DataFrame:
    """(query_id, memory_id, salience): the best memory of each neighbour by edge weight * effective * max(.1, 1 - days / 90)."""
    asked, whose = alike(query_entities, "entity")
    near = asked.join(edges.select(F.col("source_id").alias("entity"), F.col("target_id").alias("near"), "weight"), "entity")
    near = near.groupBy("query_id", "near").agg(F.max("weight").alias("weight"))
    rows = near.join(mentions.withColumnRenamed("entity", "near"), "near")
    s = F.round(F.col("weight") * F.col("effective") * F.greatest(F.lit(0.1), 1 - F.col("days") / 90), 6)
    rows = rows.withColumn("salience", s).where(F.col("salience") >= least)
    # the best is an aggregate, which is made before rows of a common neighbour meet in one task
    rows = rows.groupBy("query_id", "near").agg(F.max_by(F.struct("memory_id", "salience"), F.struct("salience", -F.col("memory_id"))).alias("b"))
    rows = rows.groupBy("query_id", "b.memory_id").agg(F.max("b.salience").alias("salience"))
    best = ranked(rows, ["query_id"], [F.col("salience").desc(), F.col("memory_id")], k)
    return _each(best, whose).select("query_id", "memory_id", "salience")


def related_links(similar: DataFrame, low: float = 0.65, high: float = 0.93, k: int = 10) -> DataFrame:
    """(source_id, target_id, similarity): up to k neighbours whose similarity is in the band."""
    rows = similar.where((F.col("similarity") >= low) & (F.col("similarity") < high))
    return ranked(rows, ["source_id"], [F.col("similarity").desc(), F.col("target_id")], k).select("source_id", "target_id", "similarity")


def unlinked(nodes: DataFrame, links: DataFrame, similar: DataFrame, low: float, high: float) -> DataFrame:
    """Nodes without links although they have neighbours in the band, and how many."""
    band = similar.where((F.col("similarity") >= low) & (F.col("similarity") < high)).groupBy(F.col("source_id").alias("node")).agg(F.count("*").alias("near"))
    linked = links.select(F.col("source_id").alias("node")).unionAll(links.select(F.col("target_id").alias("node"))).distinct()
    return nodes.select("node").join(linked, "node", "left_anti").join(band, "node")


def attach_chains(links: DataFrame) -> DataFrame:
    """(node, outgoing, incoming): sorted ids on either side."""
    out = links.groupBy(F.col("source_id").alias("node")).agg(F.sort_array(F.collect_set("target_id")).alias("outgoing"))
    into = links.groupBy(F.col("target_id").alias("node")).agg(F.sort_array(F.collect_set("source_id")).alias("incoming"))
    none = F.array().cast("array<bigint>")
    return out.join(into, "node", "full").select("node", F.coalesce("outgoing", none).alias("outgoing"), F.coalesce("incoming", none).alias("incoming"))


def entity_search(queries: DataFrame, entities: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, entity_id, how): name, else alias, else a word of the description equal to the query's text; the first that hits."""
    q = queries.select("query_id", F.lower(F.trim("text")).alias("key"))
    exact = q.join(entities.select("entity_id", F.lower("entity_name").alias("key")), "key").select("query_id", "entity_id", F.lit(0).alias("tier"))
    alias = q.join(entities.select("entity_id", F.explode("aliases").alias("a")).select("entity_id", F.lower("a").alias("key")), "key").select("query_id", "entity_id", F.lit(1).alias("tier"))
    told = q.join(entities.select("entity_id", F.explode(F.array_distinct(F.split(F.lower("description"), "[^a-z0-9]+"))).alias("key")), "key").select("query_id", "entity_id", F.lit(2).alias("tier"))
    best = exact.unionAll(alias).unionAll(told).groupBy("query_id", "entity_id").agg(F.min("tier").alias("tier"))
    rows = ranked(best, ["query_id"], [F.col("tier"), F.col("entity_id")], limit)
    return rows.select("query_id", "entity_id", F.element_at(F.array(*map(F.lit, ("exact", "alias", "description"))), F.col("tier") + 1).alias("how"))


def profile_recall(matched: DataFrame, attached: DataFrame, linked: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, memory_id, relevance): attached memories at their relevance, else linked ones at 0.7, by importance."""
    asked, whose = alike(matched, "profile_id")
    rows = asked.join(attached.select("profile_id", "memory_id", "importance", F.col("relevance")), "profile_id").select("query_id", "memory_id", "importance", "relevance", F.lit(0).alias("order"))
    more = asked.join(linked.select("profile_id", "memory_id", "importance"), "profile_id").select("query_id", "memory_id", "importance", F.lit(0.7), F.lit(1))
    best = rows.unionAll(more).groupBy("query_id", "memory_id").agg(F.min_by(F.struct("relevance", "importance"), F.struct("order", -F.col("relevance"))).alias("b")).select("query_id", "memory_id", "b.*")
    best = ranked(best, ["query_id"], [F.col("importance").desc(), F.col("memory_id")], k)
    return _each(best, whose).select("query_id", "memory_id", "relevance", "rank")


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"), count_if(F.col("source_id") < F.col("target_id")).alias("rising"))


def names_in_query(text: Column) -> Column:
    """Up to five names: quoted ones, possessives, and capitalised words that don't open the text."""
    quoted = F.regexp_extract_all(text, F.lit('"([^"]+)"'))
    owners = F.regexp_extract_all(text, F.lit("([A-Z][a-z]+)'s"))
    inner = F.regexp_extract_all(text, F.lit("[a-z,;] ([A-Z][a-z]+)"))
    return F.slice(F.array_distinct(F.concat(quoted, owners, inner)), 1, 5)
