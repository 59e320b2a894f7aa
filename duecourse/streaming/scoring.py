"""Structured Streaming over the same functions the batch code uses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from duecourse.operators import drift, ordering, scoring
from duecourse.operators import requests as R
from duecourse.registry import EVENT_DATE, KEY, SCORE, Registry
from duecourse.session import forget, stored
from duecourse.streaming.live import LiveTable

Scorer = Callable[[DataFrame], DataFrame]
#: Request files that one task of a replay writes.
CHUNKS_A_TASK = 20


def request_stream(
    spark: SparkSession, path: str, registry: Registry, files_per_batch: int = 1000
) -> DataFrame:
    """JSON bodies, one per line, checked against the request contract."""
    return R.read_requests(body_stream(spark, path, files_per_batch).withColumnRenamed("value", "body"), registry)


def body_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .text(path)
    )


def score_to_log(
    read: DataFrame,
    decide: Scorer,
    registry: Registry,
    log_path: str,
    checkpoint: str,
    request_id: Column | None = None,
) -> StreamingQuery:
    """Score accepted requests and append log lines. Only projections: no state, no shuffle."""
    decided = decide(R.applications(read, registry))
    identity = F.md5("body") if request_id is None else request_id
    records = decided.select(*scoring.log_record(registry, identity, F.current_timestamp()))
    return (
        records.writeStream.format("json")
        .option("path", log_path)
        .option("ignoreNullFields", "false")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def quarantine(read: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write rejected bodies with their reasons."""
    return (
        R.quarantined(read)
        .writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def count_bins(
    served: DataFrame, edges: DataFrame, registry: Registry, path: str, checkpoint: str
) -> StreamingQuery:
    """Drift counts per micro-batch, in a folder named after the batch.

    A batch that is run again after a failure overwrites its own folder, so nothing is counted
    twice; late rows add to their month in whatever batch they arrive.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # Stored, as several aggregates read it: the requests of a batch are parsed once.
        rows = stored(drift.monitored(batch, registry), "batch-rows")
        counts = drift.bin_counts(rows, listed, registry, ["month"])
        counts.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        forget(rows)

    listed = stored(edges, "edges")  # a row a feature, which every batch reads
    return _each_batch(served, write, checkpoint)


def counted_bins(spark: SparkSession, path: str) -> DataFrame:
    """Counts of all batches summed up, as the batch job would have counted them."""
    return (
        spark.read.parquet(path)
        .groupBy("month", "feature", "bin")
        .agg(F.sum("n").alias("n"))
    )


def live_decision_rates(served: DataFrame, table: LiveTable, checkpoint: str) -> StreamingQuery:
    """Decision counts per event month, added to a live table; no state is held."""

    def write(batch: DataFrame, batch_id: int) -> None:
        def count(decision: str) -> Column:
            return F.count_if(F.col("decision") == decision)

        months = batch.groupBy(F.trunc(EVENT_DATE, "MM").alias("month")).agg(
            F.count("*").alias("loans"), F.sum(SCORE).alias("pd_sum"),
            count("reject").alias("rejected"), count("refer").alias("referred"),
        )
        table.write(months, batch_id)

    return _each_batch(served, write, checkpoint)


def live_rates(spark: SparkSession, table: LiveTable) -> DataFrame:
    """``month, loans, mean_pd, reject_rate, refer_rate`` as ``drift.decision_rates`` gives them."""
    rows = F.col("loans")
    rates = {"mean_pd": "pd_sum", "reject_rate": "rejected", "refer_rate": "referred"}
    return table.read(spark).select("month", "loans", *(F.round(F.col(c) / rows, 4).alias(n) for n, c in rates.items()))


def _each_batch(frame: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        frame.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def record_arrivals(lines: DataFrame, table: LiveTable, checkpoint: str) -> StreamingQuery:
    """A ledger row for each file and month of the request bodies in ``value``. A micro-batch takes many
    files, so the number of batches does not grow with the number of chunks. The month is read from the
    body's date alone: the request contract, checked where the bodies are scored, is not needed."""
    file = F.struct(
        F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_path").alias("file")
    )
    month = F.substring(F.get_json_object("value", f"$.{R.DATE_FIELD}"), 1, 7)
    read = lines.select(file.alias("of"), month.alias("month")).select("of.*", "month")

    def write(batch: DataFrame, batch_id: int) -> None:
        table.write(batch.groupBy("modified", "file", "month").agg(F.count("*").alias("n_rows")), batch_id)

    return _each_batch(read, write, checkpoint)


def write_requests_by_month(
    loans: DataFrame, registry: Registry, path: str, chunk: int = 500
) -> list[str]:
    """Write loans as request files, month after month, and return the months.

    A file stream takes files in the order in which they were written, so it replays the months in
    order. A file holds ``chunk`` loans, the last one of a month what is left: loans are numbered within
    their month by ranges of the id, so no month has to go through one task. The loans are stored by
    month once; the loop then reads only the month it writes. A task writes ``CHUNKS_A_TASK`` files, all
    whole but for the last one of the month.
    """
    month = F.date_format(EVENT_DATE, "yyyy-MM")
    body = stored(loans.select(month.alias("month"), KEY, R.request_json(registry).alias("body")), "bodies")
    places = ordering.running_totals(ordering.distinct_values(body, KEY, "month"), KEY, "month", ["n"])
    part = F.floor(F.col("before_n") / (chunk * CHUNKS_A_TASK)).cast("int")
    parts = places.select("month", KEY, part.alias("part"))
    by_month = stored(body.join(parts, ["month", KEY]).drop(KEY), "replay", ("month",))
    last = {r["month"]: r["last"] for r in by_month.groupBy("month").agg(F.max("part").alias("last")).collect()}
    for name in sorted(last):
        rows = by_month.filter(F.col("month") == name)
        # No task is without rows, which would write an empty file.
        tasks = rows.repartitionById(last[name] + 1, F.col("part")).select("body")
        tasks.write.option("maxRecordsPerFile", chunk).text(f"{path}/{name}")
    return sorted(last)
