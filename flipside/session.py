"""Session defaults used by the tests and the benchmark.

On a cluster the session comes from outside; nothing in the library depends on
these values except for performance.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "flipside") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    A session in one process (local master) that names none gets a temporary
    folder; a cluster session that names none is an error, since executors and
    driver share no local disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="flipside-ckpt-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def shuffle_files_released(spark: SparkSession):
    """Inside, a query's shuffle files go as soon as its result is written."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as they are now, as a table in the shared folder; the plan starts anew from there.

    Unlike DataFrame.checkpoint() this computes the rows once, and later passes
    read the columns they need.  The shuffle files of the way there are released.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    with shuffle_files_released(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def given_up(*tables: DataFrame) -> None:
    """Delete tables that `checkpointed` made and that nothing will read again; other tables are left alone."""
    for df in tables:
        path = getattr(df, "kept_path", None)
        if path is not None:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def own_method(df: DataFrame) -> DataFrame:
    """The same rows; what follows is compiled apart from what came before.

    Spark generates one method from a chain of projections and broadcast joins,
    and the JVM leaves methods of more than 8,000 bytes uncompiled, several
    times slower.  `coalesce` ends the chain; asked for more partitions than
    there are, it moves no row.
    """
    return df.coalesce(1 << 20)
