"""Queries of loomwork.operators.reconciling."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import reconciling as R
from loomwork.operators.dedup import content_hash
from loomwork.plans.registry import query
from loomwork.sources.views import view, view_sql

M = view_sql("memories")
_HASH = ", m as (select *, sha256(lower(trim(coalesce(raw, '')))) as hash from memories)"


def _hashed(spark, d):
    return view(spark, d, "memories").withColumn("hash", content_hash(F.coalesce("raw", F.lit(""))))


@query(M + _HASH + ", a as (select hash, max(memory_id) as left_id from m where memory_id % 3 <> 0 group by 1), b as (select hash, max(memory_id) as right_id from m where memory_id % 3 <> 1 group by 1) select coalesce(a.hash, b.hash) as hash, left_id, right_id, case when right_id is null then 'left_only' when left_id is null then 'right_only' else 'shared' end as side from a full join b on a.hash = b.hash")
def reconcile(spark, d):
    m = _hashed(spark, d)
    return R.reconcile(m.where("memory_id % 3 <> 0"), m.where("memory_id % 3 <> 1"))


@query(M + _HASH + ", t as (select user_id, hash, min(memory_id) as same_id from m where memory_id % 2 = 0 group by 1, 2), b as (select * from m where memory_id % 3 = 0) select b.memory_id as local_id, coalesce(same_id, case when b.memory_id % 5 = 0 then b.memory_id + 1000000 end) as cloud_id, case when same_id is not null then 'skipped' when b.memory_id % 5 = 0 then 'updated' else 'created' end as status from b left join t on t.user_id = b.user_id and t.hash = b.hash")
def apply_push(spark, d):
    m = _hashed(spark, d)
    target = m.where("memory_id % 2 = 0").select(F.col("memory_id").alias("cloud_id"), "user_id", "hash")
    batch = m.where("memory_id % 3 = 0").select(F.col("memory_id").alias("local_id"), "user_id", "hash")
    mapped = m.where("memory_id % 5 = 0").select(F.col("memory_id").alias("local_id"), (F.col("memory_id") + 1000000).alias("cloud_id"))
    return R.apply_push(target, batch, mapped)


@query(M + ", f as (select memory_id, memory_id % 11 <> 0 as h_ok, memory_id % 13 <> 0 as i_ok, memory_id % 4 as hv, memory_id % 7 as iv, memory_id % 3 <> 0 as h, memory_id % 5 <> 0 as i from memories), r as (select *, case when not i then 'kept' when not i_ok then 'rejected' when not h then 'adopted' when not h_ok then 'healed' when iv > hv then 'adopted' else 'kept' end as outcome from f where h or i) select memory_id as fact_id, case when outcome in ('adopted', 'healed') then iv when h then hv end as version, outcome from r")
def anti_entropy(spark, d):
    m = view(spark, d, "memories")

    def side(n, bad):
        v = F.col("memory_id") % n
        good = R.digest(F.col("memory_id"), v, F.col("raw"))
        return m.select(F.col("memory_id").alias("fact_id"), v.alias("version"), F.col("raw").alias("content"), F.when(F.col("memory_id") % bad == 0, F.lit("broken")).otherwise(good).alias("digest"))

    return R.anti_entropy(side(4, 11).where("fact_id % 3 <> 0"), side(7, 13).where("fact_id % 5 <> 0"))


_USERS = "with u as (select c_custkey as user_id, c_nationkey as account_id, c_mktsegment as external_id, c_custkey * 37 % 101 as created from customer), o as (select account_id, external_id, arg_min(user_id, (created, user_id)) as canonical_id from u group by 1, 2), m as (select user_id, canonical_id from u join o using (account_id, external_id))"


def _users(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("account_id"), F.col("c_mktsegment").alias("external_id"), (F.col("c_custkey") * 37 % 101).alias("created"))


@query(_USERS + " select * from m")
def canonical_users(spark, d):
    return R.canonical_users(_users(spark, d))


@query(_USERS + " select coalesce(canonical_id, o_custkey) as user_id, coalesce(canonical_id <> o_custkey, false) as moved, count(*) as n from orders left join m on user_id = o_custkey group by 1, 2")
def merge_users(spark, d):
    facts = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("user_id"), "o_orderkey")
    return R.merge_users(facts, R.canonical_users(_users(spark, d))).groupBy("user_id", "moved").agg(F.count("*").alias("n"))
