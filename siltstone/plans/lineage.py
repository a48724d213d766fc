"""Cutting long plans through the folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: With this setting Spark removes a query's shuffle files from the executors once the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names its shared folder in spark.checkpoint.dir.  A local session without one gets a folder of its own machine, a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="siltstone-checkpoint-"))


@contextmanager
def without_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that are made inside leave no shuffle files behind.  Spark looks at the setting when it makes a query, not when it runs it."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder, so that what follows neither recomputes them nor loses them with an executor.

    What follows reads the written rows, so the shuffle files behind them go at once and not with some later garbage collection of the driver.
    """
    ensure_checkpoint_dir(df.sparkSession)
    with without_shuffles(df.sparkSession):
        last = df.select("*")
    return last.checkpoint()


def forget(df: DataFrame) -> None:
    """Remove the written rows of a cut() that nothing reads any more."""
    written = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if written.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(written.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
