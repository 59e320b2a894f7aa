"""Repeatable samples for replay and for the drift reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duecourse.operators.ordering import first_by_hash
from duecourse.registry import EVENT_DATE, KEY, LABEL


def sample_by_month(loans: DataFrame, per_month: int, seed: int) -> DataFrame:
    """Up to ``per_month`` loans of each issue month; small months are kept whole."""
    return first_by_hash(loans, per_month, seed, KEY, EVENT_DATE)


def sample_rows(loans: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` loans (all of them if there are fewer)."""
    return first_by_hash(loans, n, seed, KEY)


def replay_order(sample: DataFrame) -> DataFrame:
    return sample.orderBy(EVENT_DATE, KEY)


def replay_summary(sample: DataFrame) -> DataFrame:
    return sample.agg(
        F.count("*").alias("loans"),
        F.count_distinct(EVENT_DATE).alias("months"),
        F.date_format(F.min(EVENT_DATE), "yyyy-MM").alias("first_month"),
        F.date_format(F.max(EVENT_DATE), "yyyy-MM").alias("last_month"),
        F.round(F.avg(F.col(LABEL).isNull().cast("int")), 6).alias("without_outcome"),
    )
