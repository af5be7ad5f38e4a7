"""Duplicates of memories: finding pairs, clusters, decisions, merges and their lineage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.analytics import count_if, hours_before
from loomwork.operators.components import connected_components
from loomwork.session import shuffled, written


def content_hash(raw: Column) -> Column:
    return F.sha2(F.lower(F.trim(raw)), 256)


def exact_duplicates(df: DataFrame) -> DataFrame:
    """(user_id, hash, n, first_id): texts that a user has more than once."""
    return df.groupBy("user_id", content_hash(F.coalesce("raw", F.lit(""))).alias("hash")).agg(F.count("*").alias("n"), F.min("memory_id").alias("first_id")).where("n > 1")


def duplicate_ratio(df: DataFrame) -> DataFrame:
    n = df.groupBy("user_id", content_hash(F.coalesce("raw", F.lit(""))).alias("h")).agg(F.count("*").alias("c"))
    return n.groupBy("user_id").agg(F.round(F.sum(F.col("c") - 1) / F.sum("c"), 6).alias("ratio"))


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def edit_candidates(left: DataFrame, right: DataFrame, share: float, q: int) -> DataFrame:
    """(grp, left_id, right_id): pairs of a group that may be within `share` of the longer text's length in edits; none within it is missing.

    left and right(grp, id, text). An edit destroys at most q of a text's q-grams, and what it leaves moves by no more places than there are
    edits. So two texts within t edits have a gram in common among the q * t + 1 first of each, in any one order of grams: the rarest of the
    group come first. Grams meet by group, class of length and block of places, so that a common gram is spread over its places.
    Texts are padded, so that short ones have grams enough.
    """
    growth = 1.01 / (1 - share)

    def grams(df: DataFrame) -> DataFrame:
        padded = F.concat(F.lit("\x01" * (q - 1)), F.col("text"), F.lit("\x02" * (q - 1)))
        one = F.transform(F.sequence(F.lit(1), F.length("text") + q - 1), lambda i: F.substr(padded, i, F.lit(q)))
        return df.where(F.length("text") > 0).select("grp", "id", F.length("text").alias("n"), F.posexplode(one).alias("p", "g"))

    counts = grams(left.unionByName(right)).groupBy("grp", "g").agg(F.count("*").alias("df"))

    def rarest(df: DataFrame) -> DataFrame:
        most = F.floor(share * F.floor(F.col("n") / (1 - share) + 1e-9) + 1e-9)
        by = grams(df).join(counts, ["grp", "g"]).groupBy("grp", "id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g", "p"))).alias("by"))
        return by.select("grp", "id", "n", F.explode(F.slice("by", F.lit(1), (q * most + 1).cast("int"))).alias("x")).select("grp", "id", "n", "x.g", "x.p")

    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(growth))).cast("int")
    width = lambda c: F.floor(share * F.pow(F.lit(growth), c + 2)) + 1
    held = rarest(right).withColumn("c", size).select("grp", "c", "g", F.floor(F.col("p") / width(F.col("c"))).alias("block"), F.col("id").alias("right_id"), F.col("n").alias("right_n"), F.col("p").alias("right_p"))
    asked = rarest(left).withColumn("c", F.explode(F.array(size - 1, size, size + 1)))
    asked = asked.withColumn("block", F.floor(F.col("p") / width(F.col("c")))).withColumn("block", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)))
    edits = F.floor(share * F.greatest("n", "right_n") + 1e-9)
    near = (F.abs(F.col("p") - F.col("right_p")) <= edits) & (F.abs(F.col("n") - F.col("right_n")) <= edits)
    return asked.join(shuffled(held), ["grp", "c", "g", "block"]).where(near).select("grp", F.col("id").alias("left_id"), "right_id").distinct()


def near_texts(texts: DataFrame, share: float, q: int = 8, agree: int = 4) -> DataFrame:
    """(grp, long_id, short_id): pairs of a group of texts(grp, id, text) that may be within `share` of the longer text's length in edits; none within it is missing.

    The longer text is cut into pieces of up to q letters, more than it may have edits, so what is more of them stands unchanged in the shorter one, shifted by no more letters than
    there are edits before and behind it. Of its pieces, the rarest of the group first, as many as there may be edits and `agree` hold `agree` of these (all, if there are fewer). They meet
    the shorter text's runs of as many letters by equality.
    """
    edits, size = (lambda n: f"cast(floor({share} * {n} + 1e-9) as int)"), (lambda n: f"greatest(1, least({q}, {n} div (floor({share} * {n} + 1e-9) + 2)))")
    run = lambda i: F.xxhash64(F.substr("text", i + 1, F.col("z")))
    # texts give many times their size in keys, so they are dealt to all tasks
    rows = texts.select("grp", "id", "text", F.length("text").alias("n")).where("n > 0").repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    long = rows.withColumns({"e": F.expr(edits("n")), "z": F.expr(f"cast({size('n')} as int)")}).where("e > 0").withColumn("p", F.expr("cast(n div z as int)"))
    pieces = long.select("grp", "id", "n", "e", "z", "p", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: run(i * F.col("z")))).alias("i", "h"))
    counts = pieces.groupBy("grp", "z", "h").agg(F.count("*").alias("df"))
    by = pieces.join(counts, ["grp", "z", "h"]).groupBy("grp", "id", "n", "e", "z", "p").agg(F.sort_array(F.collect_list(F.struct("df", "h", "i"))).alias("by"))
    by = by.withColumn("agree", F.least(F.lit(agree), F.col("p") - F.col("e")))
    asked = by.select("grp", F.col("id").alias("long_id"), F.col("n").alias("long_n"), "e", "z", "agree", F.explode(F.slice("by", F.lit(1), F.col("e") + F.col("agree"))).alias("x"))
    asked = asked.select("grp", "long_id", "long_n", "e", "z", "agree", "x.h", (F.col("x.i") * F.col("z")).alias("at"))
    sizes = F.array_distinct(F.expr(f"transform(sequence(n, cast(floor(n / (1 - {share}) + 1e-9) as int)), m -> cast({size('m')} as int))"))
    held = rows.withColumn("z", F.explode(sizes)).where("n >= z")
    held = held.select("grp", F.col("id").alias("short_id"), F.col("n").alias("short_n"), "z", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - F.col("z")), run)).alias("place", "h"))
    shift, more = F.col("place") - F.col("at"), F.col("short_n") - F.col("long_n")
    met = asked.join(held, ["grp", "z", "h"]).where((more <= 0) & (F.abs(shift) + F.abs(more - shift) <= F.col("e")))
    return met.groupBy("grp", "long_id", "short_id", "agree").agg(F.count("*").alias("c")).where("c >= agree").select("grp", "long_id", "short_id")


def edit_pairs(df: DataFrame, least: float = 0.9, q: int = 8) -> DataFrame:
    """(user_id, left_text, right_text, similarity): a user's distinct normalised texts whose edit similarity is at least `least`.

    Candidates are those of near_texts, which loses none; Spark's levenshtein stops at the threshold. Copies are one text:
    membership is text_members(). Texts carry a hash through the search; where two have one hash, both are checked.
    """
    texts = text_members(df).select("user_id", "text").distinct().withColumn("id", F.xxhash64("text"))
    found = near_texts(texts.select(F.col("user_id").alias("grp"), "id", "text"), 1 - least, q)
    found = found.select("grp", F.col("long_id").alias("left_id"), F.col("short_id").alias("right_id"))
    side = lambda name: texts.select(F.col("user_id").alias("grp"), F.col("id").alias(f"{name}_id"), F.col("text").alias(name))
    pairs = found.join(side("left"), ["grp", "left_id"]).join(side("right"), ["grp", "right_id"]).where(F.col("left") != F.col("right"))
    pairs = pairs.select(F.col("grp").alias("user_id"), F.least("left", "right").alias("left_text"), F.greatest("left", "right").alias("right_text")).distinct()
    longest = F.greatest(F.length("left_text"), F.length("right_text"))
    pairs = pairs.withColumn("edits", F.expr(f"levenshtein(left_text, right_text, cast(floor((1 - {least}) * greatest(length(left_text), length(right_text)) + 1e-9) as int))"))
    return pairs.where("edits >= 0").select("user_id", "left_text", "right_text", F.round(1 - F.col("edits") / longest, 6).alias("similarity"))


def edit_ratio(names: DataFrame, profiles: DataFrame, above: float = 0.75, q: int = 2) -> DataFrame:
    """(name, profile_id, ratio): each name's best profile by edit similarity, above `above`; ties by id.

    names(name), profiles(profile_id, profile_name), compared in lower case. First come profiles within one edit, then within two and three, for names so long that no farther one beats them.
    Names of no profile's length, give or take the edits, have none. Other candidates are those of edit_candidates, which loses none: first those within a quarter of the edits, then within half and all,
    each time for the names that have no profile so near yet. So a name meets the many profiles that are far from it only if none is near.
    """
    out = written(_one_edit(names, profiles, above), "edit-ratio")
    b = profiles.select(F.lit(0).alias("grp"), "profile_id", F.lower("profile_name").alias("text"))
    texts = written(b.select("grp", F.col("text").alias("id"), "text").distinct(), "profile-names")
    sizes = texts.select(F.length("text").alias("n")).distinct()
    m, n = F.length(F.lower("name")), F.col("n")
    reach = F.abs(m - n) <= F.lit(1 - above) * F.greatest(m, n) + 1e-6
    left = names.select("name").distinct().join(shuffled(out.select("name")), "name", "left_anti")
    left = written(left.join(F.broadcast(sizes), reach, "left_semi"), "names-left")
    for edits in (2, 3):
        if left.isEmpty():
            return out
        best = written(_few_edits(left, texts, b, sizes, edits, above), "edit-ratio")
        left = written(left.join(shuffled(best.select("name")), "name", "left_anti"), "names-left")
        out = out.unionAll(best)
    if left.isEmpty():
        return out
    for part in (4, 2, 1):
        share = (1 - above) / part
        a = left.select(F.lit(0).alias("grp"), F.col("name").alias("id"), F.lower("name").alias("text"))
        met = edit_candidates(a, texts, share, q).select(F.col("left_id").alias("name"), F.col("right_id").alias("text")).join(shuffled(b.select("profile_id", "text")), "text")
        met = met.withColumn("ratio", F.round(edit_similarity(F.lower("name"), F.col("text")), 6)).where((F.col("ratio") > above) & (F.col("ratio") >= 1 - share - 1e-6))
        best = met.groupBy("name").agg(F.max_by(F.struct("profile_id", "ratio"), F.struct("ratio", -F.col("profile_id"))).alias("b"))
        best = written(best.select("name", "b.profile_id", "b.ratio"), "edit-ratio")
        left = left.join(shuffled(best), "name", "left_anti")
        out = out.unionAll(best)
    return out


def _one_edit(names: DataFrame, profiles: DataFrame, above: float) -> DataFrame:
    """edit_ratio of the names of three letters or more with a profile within one edit.

    Two texts within one edit are equal once a letter, or none, is left out of each; so they meet by equality. From three letters on two
    edits always give less than one, whatever the lengths.
    """
    cut = lambda c: F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1)))))
    a = names.select("name", F.lower("name").alias("low")).distinct().where(F.length("low") >= 3)
    b = profiles.select("profile_id", F.lower("profile_name").alias("text")).where("text <> ''")
    held = b.select("text").distinct().select("text", F.explode(cut(F.col("text"))).alias("cut"))
    met = a.select("name", "low", F.explode(cut(F.col("low"))).alias("cut")).join(shuffled(held), "cut").where(F.levenshtein("low", "text", 1) >= 0)
    met = met.select("name", "low", "text").distinct().join(shuffled(b), "text").withColumn("ratio", F.round(edit_similarity(F.col("low"), F.col("text")), 6)).where(F.col("ratio") > above)
    best = met.groupBy("name").agg(F.max_by(F.struct("profile_id", "ratio"), F.struct("ratio", -F.col("profile_id"))).alias("b"))
    return best.select("name", "b.profile_id", "b.ratio")


def _few_edits(names: DataFrame, texts: DataFrame, profiles: DataFrame, sizes: DataFrame, edits: int, above: float) -> DataFrame:
    """edit_ratio of the names of more than edits * (edits + 1) letters with a profile within `edits`: more edits give less for them, whatever the lengths.

    A profile is cut into two pieces more than edits, so two of them at least stand unchanged in the name. What is shifted before a piece, between two and behind them
    takes as many edits as letters, which bounds where they can stand. Each two pieces of a profile are a key, as are all that a name may have as such; they meet by equality.
    """
    e, p = edits, edits + 2
    start = lambda i: F.expr(f"cast(({i} * n) div {p} as int)")
    pairs = [(i, j) for i in range(p) for j in range(i + 1, p)]

    def key(text: str, i: int, j: int, a: Column, b: Column) -> Column:
        piece = lambda k, shift: F.substr(F.col(text), start(k) + shift + 1, start(k + 1) - start(k))
        return F.xxhash64(F.col("n"), F.lit(i), F.lit(j), piece(i, a), piece(j, b))

    zero = F.lit(0)
    held = texts.select("text").withColumn("n", F.length("text")).where(f"n >= {p}")
    held = held.select("text", F.explode(F.array(*[key("text", i, j, zero, zero) for i, j in pairs])).alias("key"))
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-e, e + 1) for b in range(-e, e + 1) if abs(a) + abs(b - a) <= e])
    asked = names.select("name", F.lower("name").alias("low")).withColumn("m", F.length("low")).where(f"m > {e * (e + 1)}")
    asked = asked.join(F.broadcast(sizes.where(f"n >= {p}")), F.abs(F.col("m") - F.col("n")) <= e).withColumn("move", F.explode(moves))
    asked = asked.where(F.abs("move.a") + F.abs(F.col("move.b") - F.col("move.a")) + F.abs(F.col("m") - F.col("n") - F.col("move.b")) <= e)
    inside = lambda i, j: (start(i) + F.col("move.a") >= 0) & (start(j + 1) + F.col("move.b") <= F.col("m"))
    keys = F.array(*[F.when(inside(i, j), key("low", i, j, F.col("move.a"), F.col("move.b"))) for i, j in pairs])
    asked = asked.select("name", "low", F.explode(F.array_compact(keys)).alias("key")).distinct()
    met = asked.join(shuffled(held), "key").where(F.levenshtein("low", "text", e) >= 0)
    met = met.select("name", "low", "text").distinct().join(shuffled(profiles.select("profile_id", "text")), "text").withColumn("ratio", F.round(edit_similarity(F.col("low"), F.col("text")), 6)).where(F.col("ratio") > above)
    best = met.groupBy("name").agg(F.max_by(F.struct("profile_id", "ratio"), F.struct("ratio", -F.col("profile_id"))).alias("b"))
    return best.select("name", "b.profile_id", "b.ratio")


def text_members(df: DataFrame) -> DataFrame:
    """(user_id, memory_id, text): each row's text in lower case with single spaces."""
    return df.select("user_id", "memory_id", F.trim(F.regexp_replace(F.lower(F.coalesce("raw", F.lit(""))), r"[ \t\r\n\f]+", " ")).alias("text"))


def candidate_upsert(pairs: DataFrame) -> DataFrame:
    """(low_id, high_id, similarity): one row for each unordered pair, with its highest score."""
    return pairs.groupBy(F.least("left_id", "right_id").alias("low_id"), F.greatest("left_id", "right_id").alias("high_id")).agg(F.max("similarity").alias("similarity"))


def duplicate_clusters(pairs: DataFrame) -> DataFrame:
    """(cluster, size, links, avg_similarity, min_similarity, centroid) of connected pairs(left_id, right_id, similarity).

    The centroid is the member with the highest mean similarity to those it is linked with; the smaller id of equals.
    """
    members = connected_components(pairs, "left_id", "right_id")
    named = pairs.join(members.withColumnRenamed("node", "left_id"), "left_id")
    sums = named.groupBy("component").agg(F.count("*").alias("links"), F.round(F.avg("similarity"), 6).alias("avg_similarity"), F.min("similarity").alias("min_similarity"))
    both = named.select("component", F.col("left_id").alias("id"), "similarity").unionAll(named.select("component", F.col("right_id").alias("id"), "similarity"))
    means = both.groupBy("component", "id").agg(F.round(F.avg("similarity"), 9).alias("mean"))
    best = means.groupBy("component").agg(F.count("*").alias("size"), F.max_by("id", F.struct("mean", -F.col("id"))).alias("centroid"))
    return sums.join(best, "component").select(F.col("component").alias("cluster"), "size", "links", "avg_similarity", "min_similarity", "centroid")


# Words that keep a memory from being merged without review.
PROTECTED_WORDS = [
    "allergy", "allergic", "allergies", "medication", "medicine", "drug", "medical", "health", "diagnosis", "emergency", "epipen",
    "anaphylaxis", "danger", "dangerous", "warning", "never", "must not", "do not", "critical", "fatal", "lethal", "password",
    "secret", "confidential", "ssn", "social security",
]


def merge_safety(df: DataFrame, now: str, words: list[str] = PROTECTED_WORDS) -> DataFrame:
    """(memory_id, reasons, is_protected, auto): why a row must not be merged by itself."""
    text = F.lower(F.coalesce("raw", F.lit("")))
    word = F.lit(False)
    for w in words:
        word = word | text.contains(w)
    kind = F.coalesce(F.col("memory_type") == "CONSTRAINT", F.lit(False))
    recent = F.coalesce(hours_before(now, F.col("last_retrieved_at")) < 24, F.lit(False))
    checks = [("protected type", kind), ("protected word", word), ("important", F.col("importance") >= 0.9), ("recently used", recent), ("pinned", F.col("user_pinned"))]
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in checks]))
    return df.select("memory_id", reasons.alias("reasons"), (kind | word).alias("is_protected"), (F.size(reasons) == 0).alias("auto"))


def detail_score(text: Column) -> Column:
    """Up to 100 points for length, different words, numbers, capitalised words, punctuation and connecting words."""
    words = F.size(F.array_distinct(F.split(F.lower(text), r"[ \t\r\n\f]+")))
    numbers = F.when(text.rlike(r"[0-9]{4}|[0-9]+[ \t\r\n\f]*(years?|months?|days?|weeks?)"), 15).otherwise(0)
    capitals, marks = F.regexp_count(text, F.lit("[A-Z][a-z]+")), F.regexp_count(text, F.lit("[.,;:!?]"))
    joined = F.when(F.lower(text).rlike("because|therefore|since|when|where|who|which"), 10).otherwise(0)
    return F.least(F.length(text) / 500, F.lit(1.0)) * 30 + F.least(words / 50, F.lit(1.0)) * 20 + numbers + F.least(2 * capitals, F.lit(15)) + F.least(2 * marks, F.lit(10)) + joined


# How rows of a type are merged; others keep the most detailed.
STRATEGIES = {"CONSTRAINT": "COMBINE", "LESSON": "NEWEST", "PREFERENCE": "NEWEST", "FACT": "DETAILED", "EVENT": "NEWEST", "TASK": "NEWEST"}


def merge(members: DataFrame, forced: str | None = None) -> DataFrame:
    """(cluster, survivor, strategy, importance, accesses, last_access, combined, absorbed): the row that a cluster keeps, and what it takes over.

    members(cluster, memory_id, memory_type, event_seconds, detail, importance, accesses, last_access, raw). The strategy is `forced`, one of NEWEST,
    OLDEST, DETAILED, IMPORTANT and COMBINE, or that of the first member's type; ties go to the smaller id. COMBINE keeps the
    most important row and puts the members' different texts, by id, one below the other; else combined is null.
    """
    strategy = F.lit(forced) if forced else F.coalesce(*[F.when(F.col("memory_type") == t, s) for t, s in STRATEGIES.items()], F.lit("DETAILED"))
    rows = members.withColumn("strategy", strategy)
    small = -F.col("memory_id")
    by = lambda *c: F.max_by("memory_id", F.struct(*c, small))
    out = rows.groupBy("cluster").agg(
        F.min_by("strategy", "memory_id").alias("strategy"), by(F.col("event_seconds")).alias("newest"), by(-F.col("event_seconds")).alias("oldest"), by(F.col("detail")).alias("detailed"), by(F.col("importance")).alias("important"),
        F.max("importance").alias("importance"), F.sum("accesses").alias("accesses"), F.max("last_access").alias("last_access"), F.sort_array(F.collect_list("memory_id")).alias("ids"),
        F.sort_array(F.collect_list(F.struct("memory_id", F.coalesce("raw", F.lit("")).alias("raw")))).alias("texts"),
    )
    kept = F.when(F.col("strategy") == "NEWEST", F.col("newest")).when(F.col("strategy") == "OLDEST", F.col("oldest")).when(F.col("strategy") == "DETAILED", F.col("detailed")).otherwise(F.col("important"))
    combined = F.when(F.col("strategy") == "COMBINE", F.array_join(F.array_distinct(F.transform("texts", lambda t: t["raw"])), "\n"))
    return out.withColumn("survivor", kept).withColumn("combined", combined).select("cluster", "survivor", "strategy", "importance", "accesses", "last_access", "combined", F.array_except("ids", F.array("survivor")).alias("absorbed"))


def cluster_decision(any_protected: Column, all_auto: Column, any_review: Column, min_similarity: Column) -> Column:
    return (
        F.when(any_protected, "skip").when((min_similarity >= 0.88) & all_auto, "merge").when((min_similarity >= 0.82) & ~any_review, "resolve")
        .when(min_similarity >= 0.80, "merge").otherwise("review")
    )


def incremental_dedup(best: DataFrame, rejected: DataFrame, safety: DataFrame, least: float = 0.8) -> DataFrame:
    """(new_id, old_id, similarity, action) for each new row's best match, but for pairs that were rejected before."""
    pairs = best.where(F.col("similarity") >= least).join(rejected, ["new_id", "old_id"], "left_anti")
    return pairs.join(safety.select(F.col("memory_id").alias("new_id"), "auto"), "new_id").select("new_id", "old_id", "similarity", F.when(F.col("auto"), "merge").otherwise("queue").alias("action"))


def pair_signal(similarity: Column, left: Column, right: Column, authority: Column) -> Column:
    """0.7 similarity + 0.2 share of common words of four letters or more + 0.1 authority."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), "[^a-z0-9]+"), lambda w: F.length(w) >= 4))
    a, b = words(left), words(right)
    return 0.7 * similarity + 0.2 * F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.greatest(F.size(a), F.size(b))), F.lit(0.0)) + 0.1 * authority


def resolve_pairs(pairs: DataFrame) -> DataFrame:
    """Adds action, winner and append: what a labelled pair leads to, who stays, and whether the loser's text is added.

    pairs(left_id, right_id, left_importance, right_importance, left_seconds, right_seconds, left_text, right_text, label, confidence, auto).
    """
    sure = F.col("confidence")
    action = (
        F.when(~F.col("auto"), "queue").when(F.col("label").isin("DUPLICATE", "SUPPORTING") & (sure >= 0.7), "merge")
        .when((F.col("label") == "OVERLAPPING") & (sure >= 0.9), "consolidate").when(F.col("label") == "CONFLICTING", "queue").when(F.col("label") == "RELATED", "none").otherwise("queue")
    )
    left = F.struct("left_importance", "left_seconds", -F.col("left_id")) >= F.struct("right_importance", "right_seconds", -F.col("right_id"))
    loser, kept = F.when(left, F.col("right_text")).otherwise(F.col("left_text")), F.when(left, F.col("left_text")).otherwise(F.col("right_text"))
    return pairs.withColumns({"action": action, "winner": F.when(left, F.col("left_id")).otherwise(F.col("right_id")), "append": ~kept.contains(loser)})


def pending_decision(similarity: Column) -> Column:
    return F.when(similarity >= 0.9, "merge").when(similarity < 0.82, "reject").otherwise("needs label")


def backlog_state(similarity: Column, hours: Column, auto: Column) -> Column:
    return F.when((similarity >= 0.93) & (hours > 24) & auto, "backlog").when(hours > 14 * 24, "stale").otherwise("open")


def text_near_dup(df: DataFrame, jaccard: float = 0.7, contained: float = 0.8, agree: int = 3) -> DataFrame:
    """(left_id, right_id): texts(user_id, memory_id, words array) of a user that share enough words.

    Word Jaccard above `jaccard`, or `contained` of the smaller set in the larger. Equal word sets are one, named by the smallest id.
    """
    sets = df.select("user_id", F.col("memory_id").alias("id"), F.sort_array(F.array_distinct("words")).alias("ws")).where(F.size("ws") > 0)
    return near_word_sets(sets, jaccard, contained, agree).select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"))


def word_set_members(df: DataFrame) -> DataFrame:
    """(memory_id, id): the id by which text_near_dup names each of texts(user_id, memory_id, words array): the smallest of the user's with the same words."""
    words = F.sort_array(F.array_distinct("words"))
    # words meet by a digest of them, which is smaller than they are
    one = df.select("user_id", "memory_id", words.alias("ws")).where(F.size("ws") > 0).select("user_id", "memory_id", F.sha2(F.to_json("ws"), 256).alias("key"))
    return one.join(one.groupBy("user_id", "key").agg(F.min("memory_id").alias("id")), ["user_id", "key"]).select("memory_id", "id")


#: Word sets of a user that a task holds of either side, pairs of sets that it counts at once, frequent words that have a number of their own, and users whose numbers of blocks are broadcast.
SET_BLOCK, COUNTED, LISTED, FEW_USERS = 32_768, 1 << 22, 1 << 17, 100_000


def near_word_sets(sets: DataFrame, jaccard: float, contained: float, agree: int = 3, block: int = SET_BLOCK) -> DataFrame:
    """(a, b): of sets(user_id, id, ws sorted) all pairs of a user that share enough words, the smaller one first. Equal sets are one, named by the smallest id.

    Words stand in one order for all, from the rarest on. A smaller set of n words that has `need` of them in the other has `agree` of its first
    n - need + agree there (all of need, if that is less). Every two blocks of a user's sets meet in a task, which counts the first words that pairs share and then all words of the
    pairs that are left, so no pair is moved. Words are hashes of 64 bits that no two words of the table share, the most frequent ones their places in the order, which are shorter.
    """
    kind = dict(sets.dtypes)
    vocabulary = sets.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    vocabulary = written(vocabulary, "vocabulary")
    for seed in range(64):
        hashed = vocabulary.select(F.xxhash64("w", F.lit(seed)).alias("h"), "df")
        # no hash may be a place in the order either
        if hashed.groupBy("h").agg(F.count("*").alias("c")).where(f"c > 1 or h between 0 and {LISTED}").isEmpty():
            break
    else:
        raise ValueError("words share hashes")
    # a bounded list, from the rarest on
    listed = hashed.where("df > 1").orderBy(F.desc("df"), "h").limit(LISTED).select("h").toPandas()["h"].to_numpy(np.int64)[::-1]
    place = np.argsort(listed).astype(np.int32)
    by_hash = listed[place]

    def coded(parts):
        for part in parts:
            if not len(part):
                continue
            sizes, words = part["hs"].map(len).to_numpy(), np.concatenate(part["hs"].to_numpy())
            row, at = np.repeat(np.arange(len(part)), sizes), np.searchsorted(by_hash, words)
            known = np.zeros(len(words), bool)
            known[at < len(by_hash)] = by_hash[at[at < len(by_hash)]] == words[at < len(by_hash)]
            for name, mine, values in (("rare", ~known, words), ("common", known, place[np.minimum(at, len(place) - 1)] if len(place) else at)):
                r, v = row[mine], values[mine]
                part[name] = np.split(v[np.lexsort((v, r))], np.cumsum(np.bincount(r, minlength=len(part)))[:-1])
            yield part[["user_id", "id", "key", "rare", "common"]]

    rows = sets.select("user_id", "id", F.unhex(F.sha2(F.to_json("ws"), 256)).alias("key"), F.transform("ws", lambda w: F.xxhash64(w, F.lit(seed))).alias("hs"))
    rows = rows.mapInPandas(coded, f"user_id {kind['user_id']}, id {kind['id']}, key binary, rare array<bigint>, common array<int>")
    one = rows.groupBy("user_id", "key").agg(F.min("id").alias("id"), F.first("rare").alias("rare"), F.first("common").alias("common"))
    one = written(one.where(F.col("user_id").isNotNull()).drop("key"), "word-sets")
    sizes = one.groupBy("user_id").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = written(sizes, "blocks-of-users")
    few = sizes.count() <= FEW_USERS
    own = one.join(F.broadcast(sizes) if few else shuffled(sizes), "user_id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = each.select("user_id", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "rare", "common")
    # small cells are much work, so they are dealt to so many tasks and not put together
    spark = sets.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    cells = cells.repartition(tasks, "user_id", "x", "y").groupBy("user_id", "x", "y")
    names = {"id": "b", "n": "nb", "ws": "wb"}

    def cell(part: pd.DataFrame) -> pd.DataFrame:
        x, y = part["x"].iat[0], part["y"].iat[0]
        part["ws"] = [np.concatenate([r, c]).astype(np.int64) for r, c in zip(part["rare"], part["common"])]
        part["n"] = part["ws"].map(len)
        n = part["n"].to_numpy()
        part["need"] = np.minimum(np.ceil(contained * n - 1e-9), np.floor(2 * jaccard / (1 + jaccard) * n) + 1).astype(np.int64)
        part["least"] = np.minimum(agree, part["need"])
        part["first"] = part["n"] - part["need"] + part["least"]
        part = part[["own", "id", "n", "need", "least", "first", "ws"]]
        sides = [part[part["own"] == s] for s in ([x] if x == y else [x, y])]
        return pd.concat([_shared_words(a.rename(columns={"id": "a", "n": "na", "ws": "wa"}), b.rename(columns=names)) for a, b in zip(sides, sides[::-1])])

    met = cells.applyInPandas(cell, f"a {kind['id']}, b {kind['id']}, na bigint, nb bigint, c bigint")
    both = F.col("c")
    return met.where((both / (F.col("na") + F.col("nb") - both) > jaccard) | (both >= contained * F.least("na", "nb"))).select("a", "b")


def _near_sets(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """(a, b) of _shared_words."""
    return _shared_words(left, right)[["a", "b"]]


def _shared_words(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """(a, b, na, nb, c): the pairs of a block of smaller and one of larger sets that have `need` words or more in common, and how many."""
    if not len(left) or not len(right):
        return pd.DataFrame({"a": [], "b": [], "na": [], "nb": [], "c": []})
    a_id, a_n, need, least = (left[c].to_numpy() for c in ("a", "na", "need", "least"))
    b_id, b_n, held = right["b"].to_numpy(), right["nb"].to_numpy(), list(right["wb"])
    # words are numbered from 0; those of the left alone have the last number, which has no owners
    names, words = np.unique(np.concatenate(held), return_inverse=True)
    sizes = np.array([len(w) for w in held])
    begins, order = np.cumsum(sizes) - sizes, np.argsort(words, kind="stable")
    owners, upto_word = np.repeat(np.arange(len(held)), sizes)[order], np.append(np.searchsorted(words[order], np.arange(len(names) + 1)), len(words))
    none = np.zeros(0, np.int64)
    found = [(a_id[:0], b_id[:0], none, none, none)]

    def numbered(w: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(names, w), len(names) - 1)
        return np.where(names[at] == w, at, len(names))

    def places(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())

    asked = numbered(np.concatenate([w[:k] for w, k in zip(left["wa"], left["first"])]))
    lo, n = upto_word[asked], upto_word[asked + 1] - upto_word[asked]
    row = np.repeat(np.arange(len(left)), [min(len(w), k) for w, k in zip(left["wa"], left["first"])])
    upto = np.cumsum(np.bincount(row, n, len(left)))
    has = np.zeros(len(names) + 1, bool)
    start, rows = 0, max(1, COUNTED // len(held))
    while start < len(left):
        base = upto[start - 1] if start else 0
        end = min(len(left), start + rows, max(start + 1, int(np.searchsorted(upto, base + COUNTED, "right"))))
        at = slice(*np.searchsorted(row, [start, end]))
        counts = np.bincount(np.repeat(row[at] - start, n[at]) * len(held) + owners[places(lo[at], n[at])], minlength=(end - start) * len(held)).reshape(end - start, -1)
        i, j = np.nonzero(counts >= least[start:end, None])
        i += start
        ok = (a_n[i] < b_n[j]) | ((a_n[i] == b_n[j]) & (a_id[i] < b_id[j]))
        i, j = i[ok], j[ok]
        firsts = np.flatnonzero(np.diff(i, prepend=-1))
        for k, others in zip(i[firsts], np.split(j, firsts[1:])):
            own = numbered(left["wa"].iat[k])
            posted = upto_word[own + 1] - upto_word[own]
            # by the words' owners or by the others' words, whichever are fewer
            if posted.sum() < sizes[others].sum():
                c = np.bincount(owners[places(upto_word[own], posted)], minlength=len(held))[others]
            else:
                has[own] = True
                c = np.add.reduceat(has[words[places(begins[others], sizes[others])]], np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
                has[own] = False
            near = others[c >= need[k]]
            found.append((np.full(len(near), a_id[k]), b_id[near], np.full(len(near), a_n[k]), b_n[near], c[c >= need[k]]))
        start = end
    return pd.DataFrame(dict(zip(("a", "b", "na", "nb", "c"), map(np.concatenate, zip(*found)))))


def lineage(events: DataFrame) -> DataFrame:
    """(memory_id, final_id, steps): where each absorbed row ended up, along merges that were not rolled back.

    events(survivor, absorbed array, rolled_back). Followed by doubling: each round joins every row's target with its target's. A path
    without a cycle is no longer than there are rows, so rows that still move after that many doublings lead into a cycle: they have no
    final row, and null for it and for the steps.
    """
    from loomwork.session import shared_dir

    shared_dir(events.sparkSession)
    hop = events.where("not rolled_back").select(F.explode("absorbed").alias("memory_id"), F.col("survivor").alias("final_id")).groupBy("memory_id").agg(F.min("final_id").alias("final_id"))
    hop = hop.where("memory_id <> final_id").select("memory_id", "final_id", F.lit(1).cast("long").alias("steps"), F.lit(True).alias("moved")).checkpoint()
    for _ in range(hop.count().bit_length() + 1):
        on = hop.select(F.col("memory_id").alias("final_id"), F.col("final_id").alias("next"), F.col("steps").alias("more"))
        hop = hop.join(on, "final_id", "left").select("memory_id", F.coalesce("next", "final_id").alias("final_id"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved")).checkpoint()
        if not hop.where("moved").limit(1).count():
            break
    settled = lambda c: F.when(~F.col("moved"), F.col(c))
    return hop.select("memory_id", settled("final_id").alias("final_id"), settled("steps").cast("int").alias("steps"))


def dedup_stats(df: DataFrame) -> DataFrame:
    """(user_id, total, live, pending, merged, compression)."""
    gone = F.col("deleted_at").isNotNull()
    return df.groupBy("user_id").agg(
        F.count("*").alias("total"), count_if(~gone).alias("live"), count_if(F.col("is_duplicate_of").isNotNull() & ~gone).alias("pending"), count_if(gone).alias("merged"),
        F.round(count_if(gone) / F.count("*"), 6).alias("compression"),
    )


def ingest_reinforce(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(memory_id, used_count, confidence): existing rows that incoming texts repeat, used once more for each.

    Confidence becomes the larger of both plus 0.05, at most 1.
    """
    new = incoming.groupBy("user_id", content_hash(F.coalesce("raw", F.lit(""))).alias("h")).agg(F.count("*").alias("times"), F.max("confidence").alias("c"))
    rows = existing.withColumn("h", content_hash(F.coalesce("raw", F.lit("")))).join(new, ["user_id", "h"])
    return rows.select("memory_id", (F.col("used_count") + F.col("times")).alias("used_count"), F.round(F.least(F.lit(1.0), F.greatest("confidence", "c") + 0.05), 6).alias("confidence"))
