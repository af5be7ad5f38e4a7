"""Mixing sources to target weights, as a curriculum whose weights change over the training run.

A source's weight at time t (0 to 1) is its share times 1 + slope * (t - 1/2), so over the run it gives its target. The
integral of a source's schedule is its cumulative demand for words; inverting it at the place that a copy of a document
has in its source's stream gives the time at which it is trained on. The mix is range-sorted by that time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.running import running_sum
from loomwork.session import written

#: A target is at most so many times its source's size.
MOST_REPEATS = 3


def word_count(text: Column) -> Column:
    r"""Runs of characters other than the ASCII white space \x20 and \x09-\x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target, slope) from (source, source_size), a row for each source.

    Sources in order of code points, null last, weigh as given, repeating. All sizes are shared by weight; a source whose
    share is above MOST_REPEATS times its size gets that, and the rest is shared anew. Filling in order of size over
    weight finds the same shares without rounds: sources up to some place in it are full. Only this table, a row for
    each source, is windowed as a whole.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    n = F.row_number().over(by_name) - 1
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int")).cast("long"))
    rows = rows.withColumn("slope", (F.lit(1) - (n % 3)).cast("double") * 0.8)
    rows = rows.withColumn("full", F.lit(MOST_REPEATS) * F.col("source_size"))
    order = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("before", F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("after", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("left", F.sum("source_size").over(whole) - F.col("before"))
    rows = rows.withColumn("is_open", F.col("full") * F.col("after") >= F.col("left") * F.col("weight"))
    first = F.min(F.when(F.col("is_open"), F.struct("before", "left", "after"))).over(whole)
    rows = rows.withColumn("first", first)
    target = F.when(F.col("is_open"), F.col("weight") * F.col("first.left") / F.col("first.after")).otherwise(F.col("full").cast("double"))
    return rows.select("source", "source_size", target.cast("double").alias("target"), "slope")


def training_time(share: Column, slope: Column) -> Column:
    """The time in 0 to 1 by which a source has given this share of its target."""
    b = 1 - slope / 2
    root = F.sqrt(b * b + 2 * slope * share)
    return F.when(slope == 0, share).otherwise((root - b) / slope)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken, whole, extra, before, position), a row for each document.

    A source's stream is its documents in the order of a hash of their ids, again and again; the mix takes the first
    `target` words of it. So each document is taken `whole` times, and `extra` of its words once more: all, none, or at
    the stream's end the first ones. taken counts both; it never exceeds MOST_REPEATS times the size. position is the
    training time of the first word taken, null if none is. Null and empty texts have size 0 and are not taken; null is a source of its own. Rows that repeat an id are documents
    like others. An empty table gives an empty one. The texts are read once: ids, sources and sizes are written.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"))
    return _mix_sizes(written(rows, "sizes"), weights, seed).withColumnRenamed("id", id_col).drop("source", "slope")


def _mix_sizes(rows: DataFrame, weights: tuple[int, ...], seed: str) -> DataFrame:
    more = [c for c in rows.columns if c == "content"]  # orders rows that are alike else
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights).withColumnRenamed("source", "__source")
    rows = rows.withColumn("key", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    rows = running_sum(rows, ["source"], F.substring("key", 1, 3), [F.col("key"), F.col("id"), F.col("size"), *map(F.col, more)], F.col("size"), "before")
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "key")
    words = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("whole", whole)
    rest = words - F.col("whole") * F.col("source_size") - F.col("before")
    rows = rows.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), rest)).cast("long"))
    rows = rows.withColumn("taken", F.col("whole") * F.col("size") + F.col("extra"))
    share = F.when((F.col("taken") > 0) & (F.col("target") > 0), F.least(F.lit(1.0), F.col("before") / F.col("target")))
    rows = rows.withColumn("position", training_time(share, F.col("slope")))
    return rows.select("id", "source", "size", *more, "source_size", "target", "taken", "whole", "extra", "before", "slope", "position")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars") -> DataFrame:
    """The rows the mix trains on, in the order of their training times; a document taken k times is k rows.

    The last copy of a stream may be cut: such a row keeps its first words, single-spaced, and its length_col, if there is one, is made to fit.
    Rows alike in id, source and size stand in the order of a hash of their content; rows alike throughout are numbered, in whatever order,
    which tells in the result which of them is which no more than before. So reruns agree, however the rows are dealt. Null and empty texts have no words and go;
    null is a source of its own; an empty table stays empty; columns of any other names are kept as they are.
    """
    columns = docs.columns
    plain = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t else F.col(f"`{c}`") for c, t in docs.dtypes]
    content = F.xxhash64(*plain, *[F.col(f"`{c}`").isNull() for c in columns])  # nulls add nothing to a hash
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__all"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), content.alias("content"),
    ).where("size > 0")
    plan = _mix_sizes(written(rows.select("id", "source", "size", "content"), "sizes"), weights, seed)
    plan = plan.groupBy(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("content").alias("__content")).agg(
        F.count("*").alias("alike"), F.sum("extra").alias("extra"), F.min(F.struct("before", "whole", "source_size", "target", "slope")).alias("p"),
    ).where("p.whole > 0 or extra > 0")
    plan = written(plan, "plan")
    on = F.col("id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size")) & (F.col("content") == F.col("__content"))
    met = lambda some: rows.join(plan.where(some), on).select("__all", "content", "size", "extra", "p.*")
    taken = met("alike = 1")
    if plan.where("alike > 1").limit(1).count():
        several = running_sum(met("alike > 1"), ["content", "size"], F.spark_partition_id(), [F.col("before")], F.col("size"), "ahead")
        several = several.withColumns({"extra": F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("ahead"))), "before": F.col("before") + F.col("ahead")})
        taken = taken.unionByName(several.drop("ahead"))
    copies = F.sequence(F.lit(0), F.col("whole") + F.when(F.col("extra") > 0, 1).otherwise(0) - 1)
    taken = taken.where("whole > 0 or extra > 0").withColumn("copy", F.explode(copies))
    share = F.least(F.lit(1.0), (F.col("copy") * F.col("source_size") + F.col("before")) / F.col("target"))
    taken = taken.withColumn("position", training_time(share, F.col("slope")))
    cut = (F.col("copy") == F.col("whole")) & (F.col("extra") < F.col("size"))
    own = F.col(f"__all.`{text_col}`")
    first = F.array_join(F.slice(F.regexp_extract_all(own, F.lit(r"([^\x20\x09-\x0D]+)")), F.lit(1), F.col("extra").cast("int")), " ")
    taken = taken.withColumn("text", F.when(cut, first).otherwise(own))
    out = []
    for c in columns:
        value = F.col(f"__all.`{c}`")
        if c == text_col:
            value = F.col("text")
        elif c == length_col:
            value = F.when(cut, F.length("text")).otherwise(value).cast(docs.schema[c].dataType)
        out.append(value.alias(c))
    return taken.orderBy("position", F.col(f"__all.`{id_col}`"), "copy").select(out)
