"""Session helpers: a tuned local session and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", name: str = "turfline") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, only a session with an explicit local master gets a temporary folder
    (one machine, removed at exit); any other session must name a shared one.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        current = context._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if base is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-turfline-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/turfline-{name}-{uuid.uuid4().hex[:12]}"


_SETTLED: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete the tables that ``settle`` has written; no frame over them may be used after."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _SETTLED:
        path = jvm.org.apache.hadoop.fs.Path(_SETTLED.pop())
        path.getFileSystem(conf).delete(path, True)


def settle(df: DataFrame, name: str = "cut", a_file: int = 0) -> DataFrame:
    """Cut lineage with a written table every executor can read back.

    ``a_file`` rows at most share a file (0: any number). Spark's writer looks at what it holds only every
    100 rows and its reader takes up to 4,096 rows at once, whatever their size, but both end with a file.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("maxRecordsPerFile", a_file).parquet(path)
    _SETTLED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def together(*makers: Callable[[], DataFrame]) -> list[DataFrame]:
    """Frames whose jobs do not need each other, made side by side: many small jobs wait on the driver, not on cores."""
    with ThreadPoolExecutor(len(makers)) as pool:
        return [made.result() for made in [pool.submit(maker) for maker in makers]]
