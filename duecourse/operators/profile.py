"""Table profiling: counts, shares, availability, funnels and descriptions.

Every function makes one pass over the rows, whatever the number of columns profiled; what
follows works on the small aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duecourse.operators import ordering


def shape(raw: DataFrame, key: str, is_row: Column) -> DataFrame:
    """Rows, distinct keys and rows that are not data."""
    per_key = raw.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(~F.coalesce(is_row, F.lit(False))).alias("junk")
    )
    return per_key.agg(
        F.sum("n").alias("rows"), F.count(key).alias("distinct_keys"), F.sum("junk").alias("junk")
    )


def value_counts(df: DataFrame, column: str, digits: int = 4) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(column, "n", F.round(F.col("n") / total, digits).alias("share"))


def latency_profile(df: DataFrame, group: str, value: str, time: str) -> DataFrame:
    """Median, tail percentiles (inclusive method), maximum and rate per second."""
    seconds = F.unix_micros(F.max(time).cast("timestamp")) - F.unix_micros(
        F.min(time).cast("timestamp")
    )
    totals = df.groupBy(group).agg(
        F.count("*").alias("n"),
        F.round(F.max(value), 6).alias("largest"),
        F.round(F.try_divide(F.count("*"), seconds / 1e6), 6).alias("per_second"),
    )
    tails = ordering.percentiles(df.select(group, value), value, group, [0.5, 0.95, 0.99])
    return totals.join(tails, group).select(
        group,
        "n",
        *(F.round(f"p{i}", 6).alias(name) for i, name in enumerate(("p50", "p95", "p99"))),
        "largest",
        "per_second",
    )


def dates_range(df: DataFrame, day: str) -> DataFrame:
    return df.agg(F.min(day).alias("first"), F.max(day).alias("last"))


def resolved_rates(df: DataFrame, period: Column, resolved: Column, bad: Column) -> DataFrame:
    """Loans, share with a final outcome and default rate among those, per period."""
    return df.groupBy(period.alias("period")).agg(
        F.count("*").alias("loans"),
        F.round(F.avg(resolved.cast("int")), 6).alias("share_resolved"),
        F.round(F.avg(F.when(resolved, bad.cast("int"))), 6).alias("default_rate"),
    )


def availability(df: DataFrame, month: str, columns: list[str]) -> DataFrame:
    """``(month, column, share)``: share of rows with a value, for all columns in one scan."""
    shares = df.filter(F.col(month).isNotNull()).groupBy(month).agg(
        *(F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in columns)
    )
    return shares.unpivot([month], columns, "column", "share")


def first_available(shares: DataFrame, month: str, above: float = 0.5) -> DataFrame:
    """``(column, first_month)``; NULL where the share never exceeds the limit."""
    return shares.groupBy("column").agg(
        F.min(F.when(F.col("share") > above, F.col(month))).alias("first_month")
    )


def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Rows left after each filter in turn, and the share kept of the step before."""
    passed, counts = F.lit(True), []
    for name, condition in steps:
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    names = [name for name, _ in steps]
    places = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i)))
    rows = df.agg(*counts).unpivot([], names, "step", "loans")
    # A row per step, so the window without partitions is as small as the list of steps.
    before = F.lag("loans").over(W.orderBy("place"))
    return rows.withColumn("place", places[F.col("step")]).select(
        "step", "loans", F.round(F.try_divide(F.col("loans"), before), 3).alias("kept")
    )


def quality_counts(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``(check, rows)`` for any number of named conditions, in one pass."""
    counts = df.agg(*(F.count_if(c).alias(n) for n, c in checks.items()))
    return counts.unpivot([], list(checks), "check", "rows")


def describe(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """Count, mean, standard deviation, extremes and exact percentiles of each column."""
    long = df.select(columns).unpivot([], columns, "column", "value")
    basics = long.groupBy("column").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("least"),
        F.max("value").alias("largest"),
    )
    tails = ordering.percentiles(long, "value", "column", shares)
    names = [f"p{round(100 * s)}" for s in shares]
    renamed = tails.select("column", *(F.col(f"p{i}").alias(n) for i, n in enumerate(names)))
    return basics.join(renamed, "column", "left")


def band(value: Column, edges: list[float]) -> Column:
    """Number of the right-closed band (e0, e1], (e1, e2], ...; NULL outside."""
    pairs = zip(edges, edges[1:])
    return F.coalesce(*(F.when((value > a) & (value <= b), i) for i, (a, b) in enumerate(pairs)))


def quantile_bands(df: DataFrame, column: str, count: int) -> DataFrame:
    """Add ``band``: equal-share bands from exact interpolated quantiles, lowest edge included."""
    named = df.select(F.lit(column).alias("column"), column)
    shares = [i / count for i in range(1, count)]
    found = ordering.percentiles(named, column, "column", shares)
    edges = found.select(F.array(*(f"p{i}" for i in range(count - 1)))).scalar()
    passed = sum(
        ((F.get(edges, F.lit(i)) < F.col(column)).cast("int") for i in range(count - 1)), F.lit(0)
    )
    return df.withColumn("band", passed)


def rate_by(df: DataFrame, group: str, label: str, digits: int = 6) -> DataFrame:
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.count("*").alias("loans"), F.round(F.avg(label), digits).alias("default_rate")
    )


def rates_by_value(df: DataFrame, columns: list[str], label: str, digits: int = 3) -> DataFrame:
    """``(column, value, n, default_rate)`` for several columns in one aggregation."""
    long = df.unpivot([label], columns, "column", "value").filter("value IS NOT NULL")
    return long.groupBy("column", "value").agg(
        F.count("*").alias("n"), F.round(F.avg(label), digits).alias("default_rate")
    )


def classification_problems(classified: DataFrame, columns: DataFrame) -> DataFrame:
    """``(column, problem)`` for columns classified twice, not at all, or that do not exist."""
    one, none = F.lit(1), F.lit(0)
    both = classified.select("column", one.alias("named"), none.alias("exists")).unionByName(
        columns.select("column", none.alias("named"), one.alias("exists"))
    )
    counts = both.groupBy("column").agg(
        F.sum("named").alias("named"), F.sum("exists").alias("exists")
    )
    problem = (
        F.when(F.col("named") > 1, "classified twice")
        .when(F.col("named") == 0, "not classified")
        .when(F.col("exists") == 0, "does not exist")
    )
    return counts.select("column", problem.alias("problem")).filter("problem IS NOT NULL")
