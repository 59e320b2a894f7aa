"""What retraining would have been worth: models of several dates on later windows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecourse.config import Retraining, Window, windows_for
from duecourse.operators import economics as E
from duecourse.operators import metrics as M
from duecourse.operators.ordering import union_all
from duecourse.registry import EVENT_DATE, KEY, LABEL, SCORE

PAIR = "pair"


def pairs(as_of: tuple[str, ...], r: Retraining) -> list[tuple[str, str, Window]]:
    """(model date, evaluation date, window): a model never sees loans older than its own test."""
    tests = {date: windows_for(date, r)[1]["test"] for date in as_of}
    return [
        (model, judge, window)
        for judge, window in tests.items()
        for model, own in tests.items()
        if own.start <= window.start
    ]


def scored_pairs(found: list[tuple[str, str, Window]], score) -> DataFrame:
    """Long table of all pairs; ``score(model date, window)`` gives scored rows with ``reject``."""
    return union_all(
        [
            score(model, window).withColumns(
                {
                    PAIR: F.lit(f"{model}|{judge}"),
                    "model_as_of": F.lit(model),
                    "eval_as_of": F.lit(judge),
                    "evaluated_on": F.lit(str(window)),
                }
            )
            for model, judge, window in found
        ]
    )


def scored_by_all(
    rows: DataFrame, found: list[tuple[str, str, Window]], scores: dict[str, Column], cuts: dict[str, float],
    keep: tuple[str, ...] = (KEY, LABEL), day: str = EVENT_DATE,
) -> DataFrame:
    """The long table of all pairs from one scan: each row is scored by the models that some window it
    lies in asks for, once each, and then repeated for its pairs. ``scores`` are expressions over ``rows``."""
    names = {model: f"score_{i}" for i, model in enumerate(scores)}
    asked = {m: [w for model, _, w in found if model == m] for m in names}
    once = rows.select(*keep, day, *(
        F.when(reduce(or_, (w.contains(F.col(day)) for w in asked[m])), scores[m]).alias(n)
        for m, n in names.items() if asked[m]
    ))
    entries = (
        F.when(window.contains(F.col(day)), F.struct(
            F.lit(f"{model}|{judge}").alias(PAIR), F.lit(model).alias("model_as_of"), F.lit(judge).alias("eval_as_of"),
            F.lit(str(window)).alias("evaluated_on"), F.col(names[model]).alias(SCORE),
            (F.col(names[model]) >= cuts[model]).alias("reject"),
        ))
        for model, judge, window in found
    )
    return once.select(*keep, F.inline(F.array_compact(F.array(*entries))))


def matrix(scored: DataFrame, prices: dict[str, E.Economics]) -> DataFrame:
    """One row per pair: ranking, calibration, savings and reject rate.

    Each window is priced with the economics known at its own date, so models in a column face
    the same prices. All pairs are measured in the same jobs.
    """

    def rate(field: str):
        cases = (F.when(F.col("eval_as_of") == d, getattr(p, field)) for d, p in prices.items())
        return F.coalesce(*cases)

    bad, good = F.col(LABEL) == 1, F.col(LABEL) == 0

    def total(condition, amount):
        return F.sum(F.when(condition, F.col(amount)).otherwise(0))

    names = [PAIR, "model_as_of", "eval_as_of", "evaluated_on"]
    sums = scored.groupBy(*names).agg(
        total(bad & ~F.col("reject"), E.FUNDED).alias("lost"),
        total(good & F.col("reject"), E.INTEREST).alias("forgone"),
        total(bad, E.FUNDED).alias("lost_all"),
        F.avg(F.col("reject").cast("int")).alias("reject_rate"),
    )
    cost = rate("lgd") * F.col("lost") + rate("haircut") * F.col("forgone")
    base = rate("lgd") * F.col("lost_all")
    return (
        sums.join(M.ranking(scored, key=PAIR), PAIR)
        .join(M.calibration_error(scored, key=PAIR), PAIR)
        .select(
            "model_as_of",
            "eval_as_of",
            "evaluated_on",
            F.round("roc_auc", 4).alias("roc_auc"),
            F.round("ece", 4).alias("ece"),
            F.round(100 * (1 - F.try_divide(cost, base)), 2).alias("savings_pct"),
            F.round("reject_rate", 4).alias("reject_rate"),
        )
    )
