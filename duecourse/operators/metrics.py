"""Ranking, probability and calibration quality of scored rows ``(pd, y)``.

Each function takes an optional ``key`` (model version, split, ...) and then measures every key
in the same job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duecourse.operators import ordering
from duecourse.registry import KEY, LABEL, SCORE
from duecourse.session import stored

EVERYTHING = "all_rows"


def keyed(df: DataFrame, key: str | None) -> tuple[DataFrame, str]:
    return (df, key) if key else (df.withColumn(EVERYTHING, F.lit("all")), EVERYTHING)


def unkeyed(df: DataFrame, key: str | None) -> DataFrame:
    return df if key else df.drop(EVERYTHING)


def ranking(df: DataFrame, score: str = SCORE, label: str = LABEL, key: str | None = None):
    """ROC-AUC with ties counted half, and average precision (step sum, no interpolation)."""
    frame, group = keyed(df, key)
    bad = F.col(label).cast("bigint")
    values = ordering.running_totals(
        ordering.distinct_values(frame, score, group, pos=F.sum(bad), neg=F.sum(1 - bad)),
        score,
        group,
        ["pos", "neg"],
    )
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    all_pos, all_neg = F.col("total_pos").cast("double"), F.col("total_neg").cast("double")
    won = pos * (F.col("before_neg") + neg / 2)
    hits = all_pos - F.col("before_pos")
    misses = all_neg - F.col("before_neg")
    result = values.groupBy(group).agg(
        F.try_divide(F.sum(won), F.max(all_pos * all_neg)).alias("roc_auc"),
        F.try_divide(F.sum(pos * F.try_divide(hits, hits + misses)), F.max(all_pos)).alias("pr_auc"),
    )
    return unkeyed(result, key)


def probability_errors(
    df: DataFrame, score: str = SCORE, label: str = LABEL, key: str | None = None
) -> DataFrame:
    """Brier score and log loss (scores clipped to [1e-6, 1 - 1e-6])."""
    frame, group = keyed(df, key)
    y, p = F.col(label), F.col(score)
    clipped = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    result = frame.groupBy(group).agg(
        F.avg(F.pow(p - y, F.lit(2))).alias("brier"),
        F.avg(-(y * F.ln(clipped) + (1 - y) * F.ln(1 - clipped))).alias("log_loss"),
    )
    return unkeyed(result, key)


def calibration_table(
    df: DataFrame,
    bins: int = 10,
    score: str = SCORE,
    label: str = LABEL,
    tie: str = KEY,
    key: str | None = None,
) -> DataFrame:
    """Predicted and observed rate in each of ``bins`` equal-size score bins."""
    binned = ordering.assign_bins(df, score, tie, bins, key)
    return binned.groupBy(*([key] if key else []), "bin").agg(
        F.avg(score).alias("mean_predicted"),
        F.avg(label).alias("observed_rate"),
        F.count("*").alias("loans"),
    )


def calibration_error(df: DataFrame, bins: int = 10, key: str | None = None, **columns):
    """Expected calibration error: mean absolute gap over bins, weighted by loans."""
    table, group = keyed(calibration_table(df, bins, key=key, **columns), key)
    gap = F.abs(F.col("mean_predicted") - F.col("observed_rate"))
    result = table.groupBy(group).agg(
        (F.sum(gap * F.col("loans")) / F.sum("loans")).alias("ece")
    )
    return unkeyed(result, key)


def probability_metrics(df: DataFrame, key: str | None = None, digits: int = 5) -> DataFrame:
    """All quality metrics, one row per key."""
    frame, group = keyed(df, key)
    joined = (
        ranking(frame, key=group)
        .join(probability_errors(frame, key=group), group)
        .join(calibration_error(frame, key=group), group)
    )
    names = ["roc_auc", "pr_auc", "brier", "log_loss", "ece"]
    return unkeyed(joined.select(group, *(F.round(n, digits).alias(n) for n in names)), key)


def rank_correlation(df: DataFrame, left: str, right: str) -> DataFrame:
    """Spearman correlation: Pearson on average ranks, rows with a missing side left out."""
    counted = (
        df.filter(F.col(left).isNotNull() & F.col(right).isNotNull())
        .groupBy(left, right)
        .agg(F.count("*").alias("pairs"))
        .withColumn(EVERYTHING, F.lit("all"))
    )
    pairs = stored(counted, "pairs")

    def ranks(value: str, name: str) -> DataFrame:
        weighted = pairs.groupBy(EVERYTHING, value).agg(F.sum("pairs").alias("n"))
        totals = ordering.running_totals(weighted, value, EVERYTHING, ["n"])
        rank = F.col("before_n") + (F.col("n") + 1) / 2
        return totals.select(value, rank.alias(name), F.col("n"), F.col("total_n"))

    with_left = ordering.attach(pairs, ranks(left, "left_rank"), [left]).drop("n", "total_n")
    with_both = ordering.attach(with_left, ranks(right, "right_rank"), [right])
    # Centred at the known mean rank so that the sums stay small.
    a = F.col("left_rank") - (F.col("total_n") + 1) / 2
    b = F.col("right_rank") - (F.col("total_n") + 1) / 2
    w = F.col("pairs")
    return with_both.agg(
        F.try_divide(
            F.sum(w * a * b), F.sqrt(F.sum(w * a * a)) * F.sqrt(F.sum(w * b * b))
        ).alias("spearman")
    )
