"""Champion/challenger comparison on the same loans with the same prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecourse.config import PromotionRules
from duecourse.operators import metrics
from duecourse.operators.economics import Economics, decision_cost

VERSION = "version"


def evaluate_versions(scored: DataFrame, economics: Economics) -> DataFrame:
    """``(version, cost, roc_auc, ece)`` from long rows ``(version, id, y, pd, reject, money)``."""
    cost = scored.groupBy(VERSION).agg(decision_cost(F.col("reject"), economics).alias("cost"))
    ranking = metrics.ranking(scored, key=VERSION).select(VERSION, "roc_auc")
    return cost.join(ranking, VERSION).join(
        metrics.calibration_error(scored, key=VERSION), VERSION
    )


def _fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value)


def _percent(value: Column | float) -> Column:
    value = F.lit(value) if isinstance(value, float) else value
    return F.concat(_fixed(value * 100, 3), F.lit("%"))


def _by_role(versions: DataFrame, *fields: str) -> DataFrame:
    """One row ``(new, old)``: the challenger and the champion; fails if a role has two versions."""

    def of(role: str) -> Column:
        mine = F.col("role") == role
        row = F.max(F.when(mine, F.struct(VERSION, *fields)))
        many = F.count_if(mine) > 1
        return F.when(many, F.raise_error(F.lit(f"more than one {role}")).cast("string")).alias(f"{role}_error"), row

    checks, rows = zip(of("challenger"), of("champion"), strict=True)
    found = versions.agg(*checks, rows[0].alias("new"), rows[1].alias("old"))
    return found.filter("challenger_error IS NULL AND champion_error IS NULL").select("new", "old")


def decide(evaluations: DataFrame, rules: PromotionRules) -> DataFrame:
    """``(challenger, champion, promoted, reason)`` from evaluations that carry a ``role``.

    The rules apply in order; the first that fits gives the verdict. Figures that are missing, or a
    champion that costs nothing, cannot be compared and promote nobody. Several versions in one role
    are an error.
    """
    pair = _by_role(evaluations, "cost", "roc_auc", "ece").filter("new IS NOT NULL")
    missing = F.col("new.cost").isNull() | F.col("new.roc_auc").isNull() | F.col("new.ece").isNull()
    unknown = F.col("old.cost").isNull() | F.col("old.roc_auc").isNull() | (F.col("old.cost") == 0)
    drop = F.col("old.roc_auc") - F.col("new.roc_auc")
    gain = 1 - F.try_divide(F.col("new.cost"), F.col("old.cost"))
    verdicts = [
        (missing, False, [F.lit("challenger lacks cost, ROC-AUC or ECE")]),
        (
            F.col("new.ece") > rules.max_ece,
            False,
            [F.lit("challenger ECE "), _fixed(F.col("new.ece"), 4), F.lit(f" exceeds {rules.max_ece}")],
        ),
        (F.col("old").isNull(), True, [F.lit("no champion yet (bootstrap)")]),
        (unknown, False, [F.lit("champion has no cost or ROC-AUC to compare with")]),
        (
            F.col("new.roc_auc") < F.col("old.roc_auc") - rules.max_auc_drop,
            False,
            [F.lit("ROC-AUC dropped "), _fixed(drop, 4), F.lit(f" (max {rules.max_auc_drop})")],
        ),
        (
            gain < rules.min_cost_improvement,
            False,
            [F.lit("cost improvement "), _percent(gain), F.lit(" below "),
             _percent(rules.min_cost_improvement)],
        ),
        (
            F.lit(True),
            True,
            [F.lit("cost "), _percent(gain), F.lit(" lower than champion v"), F.col("old.version")],
        ),
    ]
    promoted = F.coalesce(*(F.when(c, F.lit(p)) for c, p, _ in verdicts))
    reason = F.coalesce(*(F.when(c, F.concat(*text)) for c, _, text in verdicts))
    return pair.select(
        F.col("new.version").alias("challenger"),
        F.col("old.version").alias("champion"),
        promoted.alias("promoted"),
        reason.alias("reason"),
    )


def precheck(versions: DataFrame, expected: Column) -> DataFrame:
    """``(challenger, blocked_by)`` from a table of versions ``(role, version, dirty,
    fingerprint)``: reasons not to evaluate at all, in order; NULL when there is none."""
    pair = _by_role(versions, "dirty", "fingerprint")
    name = F.concat(F.lit("v"), F.col("new.version"))
    blocked = (
        F.when(F.col("new.dirty"), F.concat(name, F.lit(" was logged from uncommitted code")))
        .when(
            expected.isNotNull() & ~F.col("new.fingerprint").eqNullSafe(expected),
            F.concat(name, F.lit(" is not the expected model")),
        )
        .when(
            F.col("new.version") == F.col("old.version"),
            F.concat(name, F.lit(" is already the champion")),
        )
    )
    return pair.select(F.col("new.version").alias("challenger"), blocked.alias("blocked_by"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and order-insensitive content sums of a table.

    A row is hashed as JSON with its nulls, so values cannot run into each other; both halves of the
    digest are summed.
    """
    row = F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in columns)), {"ignoreNullFields": "false"})
    digest = F.md5(row)
    half = [F.conv(F.substring(digest, a, 16), 16, 10).cast("decimal(20,0)") for a in (1, 17)]
    return df.agg(
        F.count("*").alias("rows"),
        F.concat_ws("-", *(F.coalesce(F.sum(h), F.lit(0)).cast("string") for h in half)).alias("content"),
    )
