"""A table that streams keep up to date and batch jobs may read at any time.

Each micro-batch adds the sums it makes to a folder of its own and then says so in a commit row. Readers
take the folders of committed batches alone and add them up by key, so a key appears once, a batch that
fails half-way is not seen, and one that is run again replaces itself. ``compact`` adds up what is
committed into one folder, which is committed the same way; readers go on from the last one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duecourse.session import stored

NO_BATCH = -1


@dataclass(frozen=True)
class LiveTable:
    """``keys`` tell rows apart, ``sums`` are numbers that add up; ``schema`` types both."""

    path: str
    schema: str
    keys: tuple[str, ...]
    sums: tuple[str, ...]

    def create(self, spark: SparkSession) -> LiveTable:
        """Make the folders that readers expect; what is there stays."""
        empty = spark.createDataFrame([], self.schema)
        marks = spark.createDataFrame([(NO_BATCH,)], "id long")
        empty.write.mode("ignore").parquet(f"{self.path}/data/batch_id={NO_BATCH}")
        empty.write.mode("ignore").parquet(f"{self.path}/compacted/upto={NO_BATCH}")
        marks.write.mode("ignore").parquet(f"{self.path}/commits/batch={NO_BATCH}")
        marks.write.mode("ignore").parquet(f"{self.path}/compactions/upto={NO_BATCH}")
        return self

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """What a batch adds; writing it again replaces it. The commit comes last."""
        fields = [*self.keys, *self.sums]
        rows.select(*fields).write.mode("overwrite").parquet(f"{self.path}/data/batch_id={batch_id}")
        self._mark(rows.sparkSession, "commits/batch", batch_id)

    def _mark(self, spark: SparkSession, kind: str, number: int) -> None:
        spark.range(number, number + 1).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{kind}={number}")

    def _marked(self, spark: SparkSession, kind: str) -> DataFrame:
        return spark.read.schema("id long").parquet(f"{self.path}/{kind}").select("id").distinct()

    def by_batch(self, spark: SparkSession) -> DataFrame:
        """Rows of committed batches since the last compaction, with ``batch_id``."""
        upto = self._marked(spark, "compactions").agg(F.max("id")).first()[0]
        new = self._marked(spark, "commits").filter(F.col("id") > upto).withColumnRenamed("id", "batch_id")
        schema = T._parse_datatype_string(self.schema).add("batch_id", T.LongType())
        data = spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(f"{self.path}/data")
        # A row for each batch since the last compaction: which folders to read.
        return data.join(F.broadcast(new), "batch_id")

    def read(self, spark: SparkSession) -> DataFrame:
        """One row for each key, with the sums over all committed batches."""
        upto = self._marked(spark, "compactions").agg(F.max("id")).first()[0]
        old = spark.read.schema(self.schema).parquet(f"{self.path}/compacted/upto={upto}")
        rows = old.unionByName(self.by_batch(spark).drop("batch_id"))
        return rows.groupBy(*self.keys).agg(*(F.sum(c).alias(c) for c in self.sums))

    def compact(self, spark: SparkSession) -> None:
        upto = self._marked(spark, "commits").agg(F.max("id")).first()[0]
        self.read(spark).write.mode("overwrite").parquet(f"{self.path}/compacted/upto={upto}")
        self._mark(spark, "compactions/upto", upto)


def decision_table(path: str) -> LiveTable:
    """Decisions by event month."""
    schema = "month date, loans long, pd_sum double, rejected long, referred long"
    return LiveTable(path, schema, ("month",), ("loans", "pd_sum", "rejected", "referred"))


def ledger(path: str) -> LiveTable:
    """Rows of each file and month: in which order, and in what chunks, a replay came."""
    schema = "modified timestamp, file string, month string, n_rows long"
    return LiveTable(path, schema, ("modified", "file", "month"), ("n_rows",))


def arrivals(spark: SparkSession, table: LiveTable) -> DataFrame:
    """``arrival, month, n_rows``: the files of a ledger numbered from 0 in the order in which they came,
    which is that of the batches and, within one, of the times at which they were written."""
    rows = stored(table.by_batch(spark), "arrivals")
    files = rows.select("batch_id", "modified", "file").distinct()
    # A row a batch: the files that came before it.
    earlier = W.orderBy("batch_id").rowsBetween(W.unboundedPreceding, -1)
    starts = files.groupBy("batch_id").agg(F.count("*").alias("files")).select(
        "batch_id", F.coalesce(F.sum("files").over(earlier), F.lit(0)).alias("start")
    )
    inside = F.row_number().over(W.partitionBy("batch_id").orderBy("modified", "file"))
    places = files.withColumn("inside", inside).join(F.broadcast(starts), "batch_id")
    arrival = (F.col("start") + F.col("inside") - 1).alias("arrival")
    return rows.join(places.select("batch_id", "file", arrival), ["batch_id", "file"]).select("arrival", "month", "n_rows")
