"""Size-tiered compaction of document shards, with DataFrame operations only.

append() writes arrivals as small immutable shards, compact() merges runs of similarly sized shards into files of up to
the target size, and both commit a new version of the manifest: a Parquet table that appears under its name by one
rename that fails if the version exists. Readers take the files that a manifest names, so they never see half a step.
A file is named by the folder of the commit that made it and its number there; folders are never reused, so no name recurs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.common import unused
from loomwork.operators.running import running_sum
from loomwork.session import shared_dir, written

#: Rows up to which a plan, about 60 bytes a row, is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 500_000
FANOUT = 4
SMALLEST_TIER = 4 << 20
TARGET_BYTES = 64 << 20
BLOCK_SHARDS = 4096
#: What a row counts besides its text.
ROW_BYTES = 16
TIERS = 20
_MANIFEST = "made string, shard long, rows long, bytes long"


def row_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def tier_of(size: Column, fanout: int = FANOUT, smallest: int = SMALLEST_TIER) -> Column:
    """0 for sizes under smallest, and one more for each factor of fanout from there."""
    return sum((F.when(size >= smallest * fanout**i, 1).otherwise(0) for i in range(TIERS)), F.lit(0))


def merge_plan(files: DataFrame, target: int = TARGET_BYTES, fanout: int = FANOUT, smallest: int = SMALLEST_TIER) -> DataFrame:
    """(made, shard, tier, run, merged) for each of files(made, shard, rows, bytes), a row for each file.

    Files above half the target stay as they are. The others of a tier stand in order of arrival and are cut into runs
    wherever their bytes pass a multiple of the target less the tier's largest size, so that no run exceeds the target.
    A run of two or more is merged.
    """
    small = 2 * F.col("bytes") <= target
    rows = files.where(small).withColumn("tier", tier_of(F.col("bytes"), fanout, smallest))
    block = F.struct("made", F.floor(F.col("shard") / BLOCK_SHARDS))
    rows = running_sum(rows, ["tier"], block, [F.col("made"), F.col("shard")], F.col("bytes"), "ahead")
    largest = F.least(F.lit(target // 2), F.lit(smallest) * F.pow(F.lit(fanout), F.col("tier"))).cast("long")
    rows = rows.withColumn("__stride", F.lit(target) - largest).withColumn("run", F.expr("ahead div __stride"))
    size = rows.groupBy("tier", "run").agg(F.count("*").alias("n"))
    planned = rows.join(size, ["tier", "run"]).select("made", "shard", "tier", "run", (F.col("n") > 1).alias("merged"))
    kept = files.where(~small).select("made", "shard", F.lit(None).cast("int").alias("tier"), F.lit(None).cast("long").alias("run"), F.lit(False).alias("merged"))
    return planned.unionByName(kept)


def _commit(spark: SparkSession, root: str, version: int, manifest: DataFrame) -> None:
    jvm = spark._jvm
    aside = f"{root}/manifest/.{uuid.uuid4().hex}"
    manifest.coalesce(1).write.parquet(aside)
    path, conf = jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(root).toUri(), conf)
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    files.rename(path(aside), path(f"{root}/manifest/v{version:08d}"), no_options)


def newest_version(spark: SparkSession, root: str) -> int:
    """0 if there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return max((int(n[1:]) for n in names if n[0] == "v"), default=0)


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(made, shard, rows, bytes) of the files of a version, the newest by default; empty before the first."""
    version = version or newest_version(spark, root)
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest/v{version:08d}") if version else spark.createDataFrame([], _MANIFEST)


def _place(columns: list[str]) -> tuple[str, str]:
    """The names of the two folder levels of a file, which none of the documents' columns has."""
    return unused(columns, "__made"), unused(columns, "__shard")


def _write(rows: DataFrame, root: str, made: str, columns: list[str], number: Column) -> None:
    level, shard = _place(columns)
    rows.select(*[F.col(f"`{c}`") for c in columns], number.cast("long").alias(shard)).write.partitionBy(shard).option("compression", "zstd").parquet(f"{root}/data/{level}={made}")


def append(docs: DataFrame, root: str, shard: Column, text_col: str = "text", gather: bool = True) -> int:
    """Writes docs as new shards, `shard` (long, not null) giving each row's, and commits them. Returns the version.

    gather shuffles the rows so that each shard is one file. Without it each task writes a file of each shard that it has rows of,
    which is cheaper where rows of a shard already stand together, as in tables that arrive in order. Null texts count
    ROW_BYTES bytes. An empty table commits no shard. Shard numbers may recur from append to append.
    """
    spark = docs.sparkSession
    version = newest_version(spark, root)
    made = f"{version + 1:08d}-{uuid.uuid4().hex[:8]}"
    number = unused(docs.columns, "__number")
    rows = docs.withColumn(number, shard.cast("long"))
    _write(rows.repartition(number) if gather else rows, root, made, docs.columns, F.col(number))
    new = docs.select(shard.cast("long").alias("shard"), row_bytes(F.col(f"`{text_col}`")).alias("b")).groupBy("shard").agg(F.count("*").alias("rows"), F.sum("b").alias("bytes"))
    new = new.select(F.lit(made).alias("made"), "shard", "rows", "bytes")
    _commit(spark, root, version + 1, manifest(spark, root, version).unionByName(new) if version else new)
    return version + 1


def current(spark: SparkSession, root: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest by default, with two more columns: the commit's folder and the number of the file that holds them.

    They are called __made and __shard, with underscores behind if the documents have such columns. One read lists the
    folders that still have files: a short name for each commit, which compaction keeps few, passes the driver.
    """
    level, shard = _place(schema.names)
    typed = T.StructType([*schema.fields, T.StructField(level, T.StringType()), T.StructField(shard, T.LongType())])
    files = manifest(spark, root, version).select(F.col("made").alias(level), F.col("shard").alias(shard))
    folders = [r[0] for r in files.select(level).distinct().collect()]
    if not folders:
        return spark.createDataFrame([], typed)
    rows = spark.read.option("basePath", f"{root}/data").schema(typed).parquet(*[f"{root}/data/{level}={made}" for made in folders])
    return rows.join(_small(files), [level, shard], "left_semi").select(typed.names)


def _small(files: DataFrame) -> DataFrame:
    return F.broadcast(files) if files.count() <= BROADCAST_ROWS else files


def compact(spark: SparkSession, root: str, schema: T.StructType, target: int = TARGET_BYTES, fanout: int = FANOUT, smallest: int = SMALLEST_TIER) -> tuple[int, DataFrame]:
    """Merges the newest version's runs into files and commits them. Returns the version and the plan that was followed.

    schema: that of the documents. Single shards keep their files. A merged file, up to the target, is written by one task from
    one shuffle of the merged rows alone. Nothing is committed where nothing merges. Old files stay for readers of old versions.
    """
    version = newest_version(spark, root)
    now = manifest(spark, root, version)
    plan = written(merge_plan(now, target, fanout, smallest), "merge-plan")
    moving = plan.where("merged")
    runs = moving.select("tier", "run").distinct().count()
    if not runs:
        return version, plan
    made = f"{version + 1:08d}-{uuid.uuid4().hex[:8]}"
    number = F.col("tier").cast("long") * F.lit(1 << 40) + F.col("run")
    level, shard = _place(schema.names)
    number_of = unused(schema.names, "__number")
    to = moving.select(F.col("made").alias(level), F.col("shard").alias(shard), number.alias(number_of))
    moved = current(spark, root, schema).join(_small(to), [level, shard]).select(*[F.col(f"`{c}`") for c in schema.names], number_of)
    _write(moved.repartition(runs, number_of), root, made, schema.names, F.col(number_of))
    told = now.join(plan, ["made", "shard"])
    new = told.where("merged").groupBy(number.alias("shard")).agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    new = new.select(F.lit(made).alias("made"), "shard", "rows", "bytes")
    _commit(spark, root, version + 1, new.unionByName(told.where("not merged").select("made", "shard", "rows", "bytes")))
    return version + 1, plan


def new_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/loomwork/shards-{uuid.uuid4().hex}"
