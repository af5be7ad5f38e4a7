"""Two-sided reconciliation, pushes, anti-entropy and merging of users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.analytics import latest_by


def reconcile(left: DataFrame, right: DataFrame, key: str = "hash", order: str = "memory_id") -> DataFrame:
    """(hash, left_id, right_id, side): the last row of each hash on either side; shared, left_only or right_only."""
    last = lambda df, name: df.groupBy(key).agg(F.max(order).alias(name))
    rows = last(left, "left_id").join(last(right, "right_id"), key, "full")
    side = F.when(F.col("right_id").isNull(), "left_only").when(F.col("left_id").isNull(), "right_only").otherwise("shared")
    return rows.withColumn("side", side)


def apply_push(target: DataFrame, batch: DataFrame, mapped: DataFrame) -> DataFrame:
    """(local_id, cloud_id, status) for batch(local_id, user_id, hash): map where the user has the hash, update where the id is mapped, else insert.

    target(cloud_id, user_id, hash); mapped(local_id, cloud_id).
    """
    same = target.groupBy("user_id", "hash").agg(F.min("cloud_id").alias("same_id"))
    rows = batch.join(same, ["user_id", "hash"], "left").join(mapped.withColumnRenamed("cloud_id", "mapped_id"), "local_id", "left")
    status = F.when(F.col("same_id").isNotNull(), "skipped").when(F.col("mapped_id").isNotNull(), "updated").otherwise("created")
    return rows.select("local_id", F.coalesce("same_id", "mapped_id").alias("cloud_id"), status.alias("status"))


def digest(*fields: Column) -> Column:
    """SHA-256 of the fields, each led by its length in bytes, so no two lists of fields run together."""
    texts = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    return F.sha2(F.concat(*[F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]), 256)


def anti_entropy(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """(fact_id, version, outcome) for facts(fact_id, version, content, digest) of two sides.

    A fact whose digest doesn't verify is corrupt. Verified beats corrupt, then the higher version; of equals the held one stays. Outcomes: kept,
    adopted (new or newer), healed (a corrupt held one replaced), rejected (a corrupt incoming one).
    """
    check = lambda df, p: df.select("fact_id", F.col("version").alias(f"{p}_version"), (digest(F.col("fact_id"), F.col("version"), F.col("content")) == F.col("digest")).alias(f"{p}_ok"))
    rows = check(held, "h").join(check(incoming, "i"), "fact_id", "full")
    outcome = (
        F.when(F.col("i_ok").isNull(), "kept").when(~F.col("i_ok"), "rejected").when(F.col("h_ok").isNull(), "adopted")
        .when(~F.col("h_ok"), "healed").when(F.col("i_version") > F.col("h_version"), "adopted").otherwise("kept")
    )
    return rows.select("fact_id", F.when(outcome.isin("adopted", "healed"), F.col("i_version")).otherwise(F.col("h_version")).alias("version"), outcome.alias("outcome"))


def canonical_users(users: DataFrame) -> DataFrame:
    """(user_id, canonical_id) of users(user_id, account_id, external_id, created): the oldest of each account and external id."""
    oldest = users.groupBy("account_id", "external_id").agg(F.min_by("user_id", F.struct("created", "user_id")).alias("canonical_id"))
    return users.join(oldest, ["account_id", "external_id"]).select("user_id", "canonical_id")


def merge_users(facts: DataFrame, mapping: DataFrame) -> DataFrame:
    """facts with user_id replaced by its canonical one, and whether the row moved."""
    rows = facts.join(mapping, "user_id", "left")
    return rows.withColumn("moved", F.coalesce(F.col("canonical_id") != F.col("user_id"), F.lit(False))).withColumn("user_id", F.coalesce("canonical_id", "user_id")).drop("canonical_id")


def newest_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return latest_by(df, keys, order)
