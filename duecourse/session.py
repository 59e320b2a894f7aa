"""Spark session for tests, checks and the bench; a cluster brings its own."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


# The JVM does not compile methods above 8000 bytes. Parsing a wide table in one generated method
# exceeds that and runs many times slower than Spark's smaller per-operator code.
HUGE_METHOD = "8000"
# Folders made for one-process sessions, by application; removed at exit.
_OWN_FOLDERS: dict[str, str] = {}
# Where the frames that ``stored`` gave lie.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def tuned(spark: SparkSession) -> SparkSession:
    """Set what wide projections need, unless the session has its own value."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name) == "65535":
        spark.conf.set(name, HUGE_METHOD)
    return spark


def local_session(cpus: int | str | None = None) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("duecourse")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        # As many shuffle partitions as cores: merging them would leave cores idle.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.codegen.hugeMethodLimit", HUGE_METHOD)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it in ``spark.checkpoint.dir``.

    Only a session that runs in one process on this machine gets a folder of its own when it has
    none; on a cluster such a folder would be another one on each machine, so that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    key = context.applicationId
    if key not in _OWN_FOLDERS:
        _OWN_FOLDERS[key] = tempfile.mkdtemp(prefix="duecourse-")
        atexit.register(shutil.rmtree, _OWN_FOLDERS[key], ignore_errors=True)
    return _OWN_FOLDERS[key]


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage and survives the
    loss of executors, and later reads prune columns and partitions."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    frame = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[frame] = path
    return frame


def path_of(frame: DataFrame) -> str:
    """Where a frame that ``stored`` gave lies."""
    return _PATHS[frame]


def forget(*frames: DataFrame) -> None:
    """Delete the files of stored frames. Only for steps whose readers have been stored themselves:
    nothing can be computed from these frames again."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(frame))
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
