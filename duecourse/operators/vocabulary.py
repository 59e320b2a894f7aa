"""Dense category codes as a table, for columns with any number of categories.

The code of a value is its place among the sorted distinct values of its column. Values are counted
first, so a value that a third of the rows share is one row; the distinct values are then cut into
ranges, numbered inside each range, and moved on by the number of values in earlier ranges. No list
of values is ever built, neither on the driver nor in a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duecourse.session import stored

#: Values with a larger share of the learned rows than 1 / HEAVY_SHARE are looked up by broadcast.
HEAVY_SHARE = 256
#: A vocabulary of at most this many values is broadcast whole.
BROADCAST_VALUES = 100_000


def learned(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value, code, n, total_n``: a row for each distinct value of each text column, NULL
    left out. ``code`` counts from 0 in the order of the values, ``n`` is the value's rows and
    ``total_n`` those of its column."""
    long = df.select(columns).unpivot([], columns, "column", "value").filter("value IS NOT NULL")
    counted = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    # Range numbers must not change between the two reads below, hence stored.
    ranged = stored(
        counted.repartitionByRange("column", "value").withColumn("range_no", F.spark_partition_id()), "vocabulary"
    )
    across = W.partitionBy("column")
    earlier = across.orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)
    # At most one row for each range and column.
    offsets = ranged.groupBy("column", "range_no").agg(F.count("*").alias("values"), F.sum("n").alias("rows")).select(
        "column", "range_no", F.coalesce(F.sum("values").over(earlier), F.lit(0)).alias("offset"),
        F.sum("rows").over(across).alias("total_n"),
    )
    inside = W.partitionBy("column", "range_no").orderBy("value")
    return ranged.join(F.broadcast(offsets), ["column", "range_no"]).select(
        "column", "value", (F.col("offset") + F.row_number().over(inside) - 1).alias("code"), "n", "total_n"
    )


def coded(df: DataFrame, vocabulary: DataFrame, columns: list[str], few: int = BROADCAST_VALUES) -> DataFrame:
    """``df`` with ``<column>_code`` for each column; missing and unseen values get NULL.

    A vocabulary of up to ``few`` values is broadcast, after it has been counted. Of a larger one the
    heavy values, 256 a column at most, are broadcast and the others joined by shuffle; rows without
    a value or with a heavy one take no part in that shuffle.
    """
    vocabulary = stored(vocabulary, "codes")
    heavy = F.col("n") * HEAVY_SHARE > F.col("total_n")
    sizes = {r["column"]: r["n"] for r in vocabulary.groupBy("column").agg(F.count("*").alias("n")).collect()}
    for c in columns:
        code = f"{c}_code"
        own = vocabulary.filter(F.col("column") == c).select(
            F.col("value").alias("_value"), F.col("code").cast("double").alias(code), heavy.alias("_heavy")
        )

        def looked_up(rows: DataFrame, codes: DataFrame) -> DataFrame:
            return rows.join(codes.drop("_heavy"), rows[c] == codes["_value"], "left").drop("_value")

        if sizes.get(c, 0) <= few:
            df = looked_up(df, F.broadcast(own))
            continue
        kept = stored(looked_up(df, F.broadcast(own.filter("_heavy"))), "coded")
        done = kept[code].isNotNull() | kept[c].isNull()
        df = kept.filter(done).unionByName(looked_up(kept.filter(~done).drop(code), own.filter("NOT _heavy")))
    return df
