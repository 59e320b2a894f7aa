"""From a score to a decision: policy flags, expected loss, reasons and the log record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecourse.functions.reasons import reason_label
from duecourse.operators.economics import Economics
from duecourse.operators.features import derived
from duecourse.operators.requests import DATE_FIELD
from duecourse.registry import EVENT_DATE, SCORE, Registry

N_REASONS = 3


def policy_box() -> dict[str, Column]:
    """Applicants outside what the model has seen; a missing value is not flagged."""
    made = derived()
    return {
        "fico_below_660": F.col("fico_range_low") < 660,
        "credit_history_under_36_months": made["credit_history_months"] < 36,
        "loan_to_income_above_0.5": made["loan_to_income"] > 0.5,
    }


def policy_flags() -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in policy_box().items())))


def decision(flags: Column, score: Column, threshold: float) -> Column:
    return (
        F.when(F.size(flags) > 0, "refer").when(score >= threshold, "reject").otherwise("approve")
    )


def expected_loss(score: Column, lgd: float) -> Column:
    """The requested amount stands in for the funded one."""
    return F.round(score * lgd * F.col("loan_amnt"), 2)


def risk_factors(contributions: dict[str, Column], values: dict[str, Column]) -> Column:
    """The up to three inputs that raise the risk most, largest first."""
    factors = F.array(
        *(
            F.when(
                push > 0,
                F.struct(
                    (-push).alias("order"),
                    F.lit(name).alias("feature"),
                    F.when(values[name].isNull(), F.concat(reason_label(F.lit(name)), F.lit(" (not provided)")))
                    .otherwise(reason_label(F.lit(name)))
                    .alias("description"),
                    push.alias("contribution"),
                ),
            )
            for name, push in contributions.items()
        )
    )
    top = F.slice(F.array_sort(F.array_compact(factors)), 1, N_REASONS)
    return F.transform(
        top, lambda f: F.struct(f["feature"], f["description"], four_digits(f["contribution"]).alias("contribution"))
    )


def four_digits(value: Column) -> Column:
    """The four-digit decimal nearest to the stored number, as Python and SQL print it. ``round`` goes by
    the shortest text of the number instead, and takes 0.50125, which is stored a little lower, upwards."""
    shown = F.call_function("format_number", value, F.lit("0.0000")).try_cast("double")
    return F.coalesce(shown, F.round(value, 4))


def decide_applications(
    scored: DataFrame,
    threshold: float,
    economics: Economics,
    model_version: str,
    contributions: dict[str, Column] | None = None,
    registry: Registry | None = None,
) -> DataFrame:
    """Add the result columns to scored applications; only projections, so batch and stream
    share it."""
    flagged = scored.withColumn("policy_flags", policy_flags())
    score = F.col(SCORE)
    result = {
        "decision": decision(F.col("policy_flags"), score, threshold),
        "threshold": F.lit(threshold),
        "expected_loss": expected_loss(score, economics.lgd),
        "model_version": F.lit(model_version),
    }
    if contributions is not None:
        made = derived()
        values = {name: made.get(name, F.col(name)) for name in contributions}
        result["risk_factors"] = risk_factors(contributions, values)
    return flagged.withColumns(result)


def version_scores(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.withColumn("reject", F.col(SCORE) >= threshold)


def log_record(registry: Registry, request_id: Column, when: Column) -> list[Column]:
    """Columns of one log line per application, with its inputs nested."""
    inputs = F.struct(F.col(EVENT_DATE).alias(DATE_FIELD), *(F.col(c) for c in registry.features))
    return [
        when.alias("ts"),
        request_id.alias("request_id"),
        F.col("model_version"),
        F.col(SCORE),
        F.col("decision"),
        F.col("policy_flags"),
        inputs.alias("features"),
    ]
