"""The scoring log: one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duecourse.operators import requests as R
from duecourse.operators.scoring import log_record
from duecourse.registry import SCORE, Registry

# ``features`` stays text here: the request contract reads it, as it does for new requests.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField(SCORE, T.DoubleType()),
        T.StructField("decision", T.StringType()),
        T.StructField("policy_flags", T.ArrayType(T.StringType())),
        T.StructField("features", T.StringType()),
    ]
)


def append_log(decided: DataFrame, path: str, registry: Registry, request_id=None, when=None):
    """Append one line per application. All applications of a call may share a request id."""
    records = decided.select(
        *log_record(
            registry,
            F.expr("uuid()") if request_id is None else request_id,
            F.current_timestamp() if when is None else when,
        )
    )
    records.write.mode("append").option("ignoreNullFields", "false").json(path)


def raw_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines as they are. Blank lines are skipped; a line that is not JSON fails the job."""
    return spark.read.schema(LOG_SCHEMA).option("mode", "FAILFAST").json(path)


def stream_log(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(LOG_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("mode", "FAILFAST")
        .json(path)
    )


def served_applications(log: DataFrame, registry: Registry) -> DataFrame:
    """Log lines -> typed applications with ``pd, decision, model_version`` (batch or stream)."""
    read = R.read_requests(log, registry, body="features")
    return R.applications(read, registry).drop("features")
