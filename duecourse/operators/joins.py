"""Joins between loans and their auxiliary rows, with the cardinality checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matched(
    left: DataFrame, right: DataFrame, key: str, needed: str | None = None, partner: bool = True
) -> DataFrame:
    """Rows of ``left`` with those of ``right``, joined and checked in one shuffle of both sides.

    One row per key of ``left``; ``problem`` is NULL, or says why the key is no 1:1 match: repeated
    on a side, without partner (if one is wanted), or with ``needed`` NULL. Rows of a key are
    counted before the shuffle, so a repeated key costs one row per task, never a product.
    """
    own = [c for c in left.columns if c != key]
    theirs = [c for c in right.columns if c != key]
    filler = F.lit(True).alias("_present")
    sides = left.select(
        key, F.struct(filler, *own).alias("l"), F.lit(None).cast(_struct(right, theirs)).alias("r")
    ).unionByName(right.select(
        key, F.lit(None).cast(_struct(left, own)).alias("l"), F.struct(filler, *theirs).alias("r")
    ))
    joined = sides.groupBy(key).agg(
        F.first("l", ignorenulls=True).alias("l"), F.first("r", ignorenulls=True).alias("r"),
        F.count("l").alias("n_left"), F.count("r").alias("n_right"),
    ).filter("n_left > 0")
    problem = F.when(F.col("n_left") > 1, "repeated on the left").when(F.col("n_right") > 1, "repeated on the right")
    if partner:
        problem = problem.when(F.col("n_right") == 0, "no partner")
    if needed:
        problem = problem.when(F.col("r")[needed].isNull(), f"{needed} missing")
    return joined.select(
        key, *(F.col("l")[c].alias(c) for c in own), *(F.col("r")[c].alias(c) for c in theirs),
        problem.alias("problem"),
    )


def _struct(df: DataFrame, columns: list[str]) -> str:
    fields = "".join(f", `{c}`: {df.schema[c].dataType.simpleString()}" for c in columns)
    return f"struct<_present: boolean{fields}>"


def join_one_to_one(
    left: DataFrame, right: DataFrame, key: str, needed: str | None = None, partner: bool = True
) -> DataFrame:
    """``matched`` rows; the job fails on the first key that is no 1:1 match."""
    rows = matched(left, right, key, needed, partner)
    fail = F.raise_error(F.concat(F.lit(f"{key} "), F.col(key).cast("string"), F.lit(": "), F.col("problem")))
    return rows.filter(F.when(F.col("problem").isNull(), True).otherwise(fail.cast("boolean"))).drop("problem")


def one_to_one_problems(
    left: DataFrame, right: DataFrame, key: str, needed: str | None = None
) -> DataFrame:
    """``(problem, keys)`` for keys repeated on a side, without partner, or with ``needed`` NULL.

    Both sides are counted per key before the shuffle, so a key repeated without limit costs one
    row per task instead of a product of its rows.
    """
    empty = F.lit(0).cast("bigint")
    counted = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r"), empty.alias("unknown"))
    unknown = F.col(needed).isNull().cast("bigint") if needed else empty
    counted = counted.unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"), unknown.alias("unknown"))
    )
    per_key = counted.groupBy(key).agg(
        F.sum("l").alias("l"), F.sum("r").alias("r"), F.sum("unknown").alias("unknown")
    )
    problems = {
        "repeated on the left": F.col("l") > 1,
        "repeated on the right": F.col("r") > 1,
        "no partner": (F.col("l") > 0) & (F.col("r") == 0),
        f"{needed} missing": (F.col("l") > 0) & (F.col("unknown") > 0),
    }
    counts = per_key.agg(*(F.count_if(c).alias(name) for name, c in problems.items()))
    return counts.unpivot([], list(problems), "problem", "keys").filter("keys > 0")


def aux_for(loans: DataFrame, aux: DataFrame, key: str = "id", needed: str = "funded_amnt"):
    """The auxiliary row of each loan; the job fails if a loan has none, or the key is not unique."""
    return join_one_to_one(loans.select(key), aux, key, needed)
