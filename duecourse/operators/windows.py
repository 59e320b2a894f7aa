"""Time windows as data: assigning rows, checking coverage, deriving windows per as-of month."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duecourse.config import Retraining, Window
from duecourse.registry import EVENT_DATE, LABEL


def split_of(day: Column, windows: Mapping[str, Window]) -> Column:
    """Name of the first window that holds the day; a CASE over a few literals, no join."""
    return F.coalesce(*(F.when(w.contains(day), F.lit(name)) for name, w in windows.items()))


def assign_split(loans: DataFrame, windows: Mapping[str, Window]) -> DataFrame:
    return loans.withColumn("split", split_of(F.col(EVENT_DATE), windows))


def window_hits(loans: DataFrame, windows: Mapping[str, Window]) -> DataFrame:
    """``(windows, loans)``: how many rows lie in 0, 1, 2, ... windows. Only 1 is sound."""
    hits = sum(
        (F.coalesce(w.contains(F.col(EVENT_DATE)).cast("int"), F.lit(0)) for w in windows.values()),
        F.lit(0),
    )
    return loans.groupBy(hits.alias("windows")).agg(F.count("*").alias("loans"))


def assign_split_strict(loans: DataFrame, windows: Mapping[str, Window]) -> DataFrame:
    """Like :func:`assign_split`, but raises unless every row lies in exactly one window."""
    wrong = window_hits(loans, windows).filter(F.col("windows") != 1).collect()  # few rows
    if wrong:
        counts = {r["windows"]: r["loans"] for r in wrong}
        raise ValueError(f"rows assigned to other than one split (windows: rows): {counts}")
    return assign_split(loans, windows)


def split_stats(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("split").agg(
        F.count("*").alias("loans"),
        F.round(F.avg(LABEL), 5).alias("default_rate"),
        F.date_format(F.min(EVENT_DATE), "yyyy-MM").alias("first_month"),
        F.date_format(F.max(EVENT_DATE), "yyyy-MM").alias("last_month"),
    )


def windows_table(as_of: DataFrame, r: Retraining) -> DataFrame:
    """``(as_of, split, start, end)`` for every as-of month that leaves training months.

    Works on a table of months, so all candidate dates are derived at once.
    """
    end = F.add_months("as_of", -r.maturity_months)
    test = F.add_months(end, 1 - r.test_months)
    val = F.add_months(test, -r.val_months)
    train = F.to_date(F.lit(f"{r.train_start}-01"))

    def row(name: str, first: Column, last: Column) -> Column:
        return F.struct(F.lit(name).alias("split"), first.alias("start"), last.alias("end"))

    return (
        as_of.filter(train < val)
        .select(
            "as_of",
            F.explode(
                F.array(
                    row("train", train, F.add_months(val, -1)),
                    row("val", val, F.add_months(test, -1)),
                    row("test", test, end),
                )
            ).alias("w"),
        )
        .select("as_of", "w.split", "w.start", "w.end")
    )


def month_window(frame: DataFrame, start: str, end: str) -> DataFrame:
    """``YYYY-MM`` text columns -> ``start``/``end`` dates and whether they are in order."""
    first, last = (F.try_to_date(F.concat(F.col(c), F.lit("-01"))) for c in (start, end))
    return frame.withColumns({"start": first, "end": last}).withColumn(
        "in_order", F.coalesce(F.col("start") <= F.col("end"), F.lit(False))
    )


def coverage_problems(windows: DataFrame, population: DataFrame) -> DataFrame:
    """``(as_of, split, problem)`` where windows leave gaps, overlap or miss the population ends.

    ``windows`` has ``as_of, split, start, end``; ``population`` has ``as_of, first, last``.
    """
    order = W.partitionBy("as_of").orderBy("start")
    checked = (
        windows.join(population, "as_of")
        .withColumn("expected", F.add_months(F.lag("end").over(order), 1))
        .withColumn("position", F.row_number().over(order))
        .withColumn("following", F.lead("start").over(order))
    )
    names = F.array(F.lit("train"), F.lit("val"), F.lit("test"))
    problem = (
        F.when(F.col("split") != F.get(names, F.col("position") - 1), "out of order")
        .when(F.col("expected").isNull() & (F.col("start") != F.col("first")), "starts late")
        .when(F.col("expected") < F.col("start"), "gap")
        .when(F.col("expected") > F.col("start"), "overlap")
        .when(F.col("following").isNull() & (F.col("end") != F.col("last")), "ends early")
    )
    return checked.select("as_of", "split", problem.alias("problem")).filter("problem IS NOT NULL")


def plan_table(derived: DataFrame, current: DataFrame) -> DataFrame:
    """Windows that differ between the derived and the current set, with both spans."""

    def span(side: str) -> Column:
        return F.concat(
            F.date_format(f"{side}.start", "yyyy-MM"),
            F.lit(".."),
            F.date_format(f"{side}.end", "yyyy-MM"),
        )

    joined = derived.alias("d").join(current.alias("c"), "split", "full")
    same = F.col("d.start").eqNullSafe(F.col("c.start")) & F.col("d.end").eqNullSafe(F.col("c.end"))
    return joined.filter(~same).select(
        "split", span("c").alias("current_span"), span("d").alias("new_span")
    )


def matured(loans: DataFrame, as_of: Column, maturity_months: int) -> Column:
    """Whether the outcome of a loan is known at the as-of month."""
    return F.col(EVENT_DATE) <= F.add_months(as_of, -maturity_months)
