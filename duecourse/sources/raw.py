"""Raw loan files in, typed tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from duecourse.functions.parsing import blank_to_null


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, missing-value spellings as NULL.

    A blank first header (a left-over row index) arrives as ``_c0`` and is dropped. Files are
    split by Spark; they must be plain ``.csv``, not inside an archive.
    """
    rows = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"')
    rows = rows.drop("_c0")
    return rows.select(*(blank_to_null(F.col(c)).alias(c) for c in rows.columns))


def write_table(
    df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "error"
) -> int:
    """Write zstd parquet and return the rows written, counted during the same pass."""
    written = Observation()
    counted = df.observe(written, F.count(F.lit(1)).alias("rows"))
    counted.write.mode(mode).partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    return written.get["rows"]


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def write_splits(assigned: DataFrame, path: str) -> int:
    """One table partitioned by split; a filter on the split reads only its files."""
    return write_table(assigned, path, ("split",))


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("split") == split)
