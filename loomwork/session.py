"""Session helpers: the shared scratch folder, written intermediates, table loading."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local: list[str] = []
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the setting is absent in one process on one machine, as in tests, a temporary folder is made and set; on a cluster that is an error.
    """
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{_SETTING} must name a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="loomwork-"))
            atexit.register(shutil.rmtree, _local[0], True)
        found = f"file://{_local[0]}"
        spark.conf.set(_SETTING, found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder as Parquet and return the reread table.

    Cuts lineage and keeps a costly result for several readers; it outlives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomwork/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables that written() wrote inside; their readers must be done by then."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly where it is read by fewer tasks than can run, as a table of one row group is; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast. Spark guesses sizes from compressed files and doesn't see what explode() adds, so a table that grows with the input could go through the driver."""
    return df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
