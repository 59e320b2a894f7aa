"""Small result tables as JSON or CSV, and nested reports as (metric, value) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_json(report: DataFrame, path: str) -> None:
    """For reports of a few rows; they end up in one file."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_csv(report: DataFrame, path: str, digits: int = 5) -> None:
    """A small table with a header row, fractions rounded."""
    rounded = [
        F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in report.schema
    ]
    report.select(*rounded).coalesce(1).write.mode("overwrite").csv(path, header=True)


def numeric_leaves(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted names of the numeric leaves; booleans are not numbers."""
    leaves = []
    for field in schema:
        path = f"{prefix}{field.name}"
        if isinstance(field.dataType, T.StructType):
            leaves += numeric_leaves(field.dataType, f"{path}.")
        elif isinstance(field.dataType, T.NumericType):
            leaves.append(path)
    return leaves


def flatten(report: DataFrame, prefix: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """Nested report rows -> ``(keep..., metric, value)``."""
    leaves = [p for p in numeric_leaves(report.schema) if p not in keep]

    def entry(path: str) -> Column:
        return F.struct(
            F.lit(f"{prefix}{path}").alias("metric"), F.col(path).cast("double").alias("value")
        )

    return report.select(*keep, F.inline(F.array(*map(entry, leaves))))
