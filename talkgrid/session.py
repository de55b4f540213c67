"""Session construction and durable intermediate results."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int = 8, app: str = "talkgrid", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench share."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TALKGRID_DRIVER_MEMORY", "12g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or a temporary one where that is unset and all runs in one process (tests, a single machine).

    On a cluster without the setting it is an error, as executors see no folder of the driver's own.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="talkgrid-ckpt-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in any store that Spark can write to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Shuffled bytes of a partition of what is kept, at least: each partition is a file, or two with its checksum.
FILE_BYTES = 32 << 20
_CLEANUP, _ADVISORY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def _bounded(df: DataFrame) -> DataFrame:
    """df, a checkpoint, its estimated size held to 63 bits.

    A checkpoint takes over the estimate of the plan that made it, which is a
    product for a join. Where a round joins what the rounds before have kept,
    the number's digits grow threefold a round, all in the driver's memory.
    """
    plan = df._jdf.queryExecution().analyzed()
    if plan.stats().sizeInBytes() < 1 << 63:
        return df
    jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
    unknown = session.internalCreateDataFrame(plan.rdd(), df._jdf.schema(), False).queryExecution().analyzed().stats()
    some = lambda x: jvm.scala.Option.apply(x)
    held = jvm.org.apache.spark.sql.execution.LogicalRDD(
        plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, some(None), session, some(unknown), some(plan.constraints())
    )
    return DataFrame(getattr(jvm.org.apache.spark.sql.classic, "Dataset$").__getattr__("MODULE$").ofRows(session, held), df.sparkSession)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of df by a checkpoint in the shared folder, in files that are not too small; the shuffle files that made it go at once."""
    spark = df.sparkSession
    shared_folder(spark)
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_ADVISORY, "64m"))
    wanted = {_CLEANUP: "true"} | ({_ADVISORY: str(FILE_BYTES)} if size < FILE_BYTES else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        return _bounded(df.select("*").checkpoint(eager=True))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
