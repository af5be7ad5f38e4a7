"""Retrieval quality: coverage, rank, isolation, sweeps, regressions and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.analytics import count_if
from loomwork.operators.scoring import ranked


def score_queries(gold: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, required_at_5, expected_at_20, mrr, isolated, no_answer_ok) for gold(query_id, must_top5, should_top20, must_absent, expect_no_answer).

    results(query_id, doc_id, rank). A label that isn't given leaves its score null.
    """
    labels = gold.select("query_id", F.explode(F.concat(
        F.transform(F.coalesce("must_top5", F.array()), lambda x: F.struct(F.lit("must").alias("kind"), x.alias("doc_id"))),
        F.transform(F.coalesce("should_top20", F.array()), lambda x: F.struct(F.lit("should").alias("kind"), x.alias("doc_id"))),
        F.transform(F.coalesce("must_absent", F.array()), lambda x: F.struct(F.lit("absent").alias("kind"), x.alias("doc_id"))),
    )).alias("l")).select("query_id", "l.kind", "l.doc_id").distinct()
    best = results.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    hit = labels.join(best, ["query_id", "doc_id"], "left")
    kind = lambda k: F.col("kind") == k
    s = hit.groupBy("query_id").agg(
        F.avg(F.when(kind("must"), F.coalesce((F.col("rank") <= 5).cast("int"), F.lit(0)))).alias("required_at_5"),
        F.avg(F.when(kind("should"), F.coalesce((F.col("rank") <= 20).cast("int"), F.lit(0)))).alias("expected_at_20"),
        F.min(F.when(kind("must"), F.col("rank"))).alias("first"), count_if(kind("must")).alias("musts"),
        count_if(kind("absent")).alias("forbidden"), count_if(kind("absent") & F.col("rank").isNotNull()).alias("leaked"),
    )
    any_result = results.select("query_id").distinct().withColumn("has", F.lit(True))
    rows = gold.select("query_id", "expect_no_answer").join(s, "query_id", "left").join(any_result, "query_id", "left")
    return rows.select(
        "query_id", F.round("required_at_5", 6).alias("required_at_5"), F.round("expected_at_20", 6).alias("expected_at_20"),
        F.when(F.col("musts") > 0, F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6)).alias("mrr"),
        F.when(F.col("forbidden") > 0, F.col("leaked") == 0).alias("isolated"), F.when(F.col("expect_no_answer"), F.col("has").isNull()).alias("no_answer_ok"),
    )


def score_report(scores: DataFrame, gold: DataFrame, gate: float = 0.95) -> DataFrame:
    """(category, queries, required_at_5, expected_at_20, mrr, isolated, passed): means over labelled queries."""
    rows = scores.join(gold.select("query_id", "category"), "query_id")
    out = rows.groupBy("category").agg(
        F.count("*").alias("queries"), F.round(F.avg("required_at_5"), 6).alias("required_at_5"), F.round(F.avg("expected_at_20"), 6).alias("expected_at_20"),
        F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg(F.col("isolated").cast("int")), 6).alias("isolated"),
    )
    return out.withColumn("passed", (F.coalesce("required_at_5", F.lit(1.0)) >= gate) & (F.coalesce("isolated", F.lit(1.0)) == 1.0))


def score_sweep(cosines: DataFrame, gold: DataFrame, weights: list[float], cutoffs: list[float], k: int = 5) -> DataFrame:
    """(weight, cutoff, coverage): share of required documents in the first k, for each blend of cosine and importance and each cut-off.

    cosines(query_id, doc_id, cosine, importance); gold(query_id, doc_id). Configurations are a few rows exploded on each pair.
    """
    configs = F.array(*[F.struct(F.lit(w).alias("weight"), F.lit(c).alias("cutoff")) for w in weights for c in cutoffs])
    rows = cosines.withColumn("c", F.explode(configs)).select("query_id", "doc_id", "cosine", "c.weight", "c.cutoff", (F.col("c.weight") * F.col("cosine") + (1 - F.col("c.weight")) * F.col("importance")).alias("s"))
    rows = ranked(rows.where(F.col("cosine") >= F.col("cutoff")).withColumn("s", F.round("s", 9)), ["weight", "cutoff", "query_id"], [F.col("s").desc(), F.col("doc_id")], k)
    found = rows.join(gold.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").groupBy("weight", "cutoff").agg(F.count("*").alias("hits"))
    total = gold.agg(F.count("*").alias("all"))  # a single row
    return found.crossJoin(F.broadcast(total)).select("weight", "cutoff", F.round(F.col("hits") / F.col("all"), 6).alias("coverage"))


def ops_summary(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p50, p95, most, results, tokens): interpolated percentiles of latency, mean result count, characters over four."""
    return samples.groupBy(*keys).agg(
        F.round(F.percentile("latency_ms", 0.5), 4).alias("p50"), F.round(F.percentile("latency_ms", 0.95), 4).alias("p95"), F.max("latency_ms").alias("most"),
        F.round(F.avg("result_count"), 4).alias("results"), F.round(F.avg(F.ceil(F.col("chars") / 4)), 4).alias("tokens"),
    )


def regression(runs: DataFrame, recall_drop: float = 0.05, slower: float = 0.5) -> DataFrame:
    """(suite, recall_change, latency_ratio, regressed): the newest of runs(suite, at, recall, p50) against the mean of up to three before."""
    rows = ranked(runs, ["suite"], [F.col("at").desc()], 4)
    out = rows.groupBy("suite").agg(F.max(F.when(F.col("rank") == 1, F.col("recall"))).alias("r"), F.avg(F.when(F.col("rank") > 1, F.col("recall"))).alias("r0"), F.max(F.when(F.col("rank") == 1, F.col("p50"))).alias("t"), F.avg(F.when(F.col("rank") > 1, F.col("p50"))).alias("t0"))
    bad = F.coalesce((F.col("r") - F.col("r0") < -recall_drop) | (F.col("t") > F.col("t0") * (1 + slower)), F.lit(False))
    return out.select("suite", F.round(F.col("r") - F.col("r0"), 6).alias("recall_change"), F.round(F.try_divide("t", "t0"), 6).alias("latency_ratio"), bad.alias("regressed"))


def fragment_eval(answers: DataFrame) -> DataFrame:
    """(query_id, share, grade) of answers(query_id, text, fragments): the share of fragments that the text has, in either case."""
    hit = F.size(F.filter("fragments", lambda f: F.contains(F.lower(F.col("text")), F.lower(f))))
    share = F.round(hit / F.size("fragments"), 6)
    return answers.select("query_id", share.alias("share"), F.when(share >= 0.8, "good").when(share >= 0.6, "fair").when(share >= 0.4, "poor").otherwise("failed").alias("grade"))


def accuracy_by_category(judged: DataFrame) -> DataFrame:
    return judged.groupBy("category").agg(F.count("*").alias("n"), count_if(F.col("correct")).alias("right"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))


def precision_at(results: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(query_id, p_at_k ...): relevant results among the first k, over k."""
    rows = results.where(F.col("rank") <= max(ks)).join(relevant.select("query_id", "doc_id", F.lit(1).alias("ok")), ["query_id", "doc_id"], "left")
    return rows.groupBy("query_id").agg(*[F.round(count_if((F.col("rank") <= k) & (F.col("ok") == 1)) / k, 6).alias(f"p_at_{k}") for k in ks])


def compare_reports(before: DataFrame, after: DataFrame, same: float = 0.001) -> DataFrame:
    """(key, delta, state): same, better, worse, new or gone for each key of two reports(key, value)."""
    rows = before.select("key", F.col("value").alias("b")).join(after.select("key", F.col("value").alias("a")), "key", "full")
    delta = F.round(F.col("a") - F.col("b"), 6)
    state = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "gone").when(F.abs(delta) < same, "same").when(delta > 0, "better").otherwise("worse")
    return rows.select("key", delta.alias("delta"), state.alias("state"))


def group_flags(df: DataFrame, key: str, value: str, high: float = 1.2) -> DataFrame:
    """(key, mean, ratio, flag): a group's mean over the mean of the groups; high or low beyond the ratio."""
    per = df.groupBy(key).agg(F.avg(value).alias("m"))
    ratio = F.col("m") / F.avg("m").over(Window.partitionBy())  # a row for each group
    return per.select(key, F.round("m", 6).alias("mean"), F.round(ratio, 6).alias("ratio"), F.when(ratio >= high, "high").when(ratio <= 1 / high, "low").otherwise("usual").alias("flag"))


def nearest_rank(values: Column, p: float) -> Column:
    """The nearest-rank percentile of an array."""
    return F.element_at(F.sort_array(values), F.greatest(F.lit(1), F.ceil(F.lit(p) * F.size(values)).cast("int")))
