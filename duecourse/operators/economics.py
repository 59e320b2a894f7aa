"""What a decision costs, in dollars against a lender who knows the outcome.

Approving a loan that goes bad loses ``lgd x funded``; rejecting one that would be repaid forgoes
``haircut x contract interest``; the other two outcomes cost nothing. Amounts are added up as
whole cents, so the sums are exact and do not depend on how the rows were partitioned; the two
rates are applied once, to the sums.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duecourse.operators import ordering
from duecourse.registry import LABEL, SCORE

FUNDED, INTEREST = "funded_cents", "interest_cents"


@dataclass(frozen=True)
class Economics:
    lgd: float  # share of the funded amount lost when a loan goes bad
    haircut: float  # share of the contract interest that good loans really pay
    term_months: int = 36

    def loss_if_default(self) -> Column:
        return F.lit(self.lgd) * F.col(FUNDED) / 100

    def profit_if_good(self) -> Column:
        return F.lit(self.haircut) * F.col(INTEREST) / 100

    def to_dict(self) -> dict:
        return asdict(self)


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def contract_interest(term_months: int) -> Column:
    """Interest if every installment is paid on schedule."""
    return F.col("installment") * term_months - F.col("funded_amnt")


def with_exposure(df: DataFrame, term_months: int = 36) -> DataFrame:
    """Add the two amounts at stake, in cents."""
    funded, installment = cents(F.col("funded_amnt")), cents(F.col("installment"))
    return df.withColumns({FUNDED: funded, INTEREST: installment * term_months - funded})


def cost_model_rates(df: DataFrame, term_months: int = 36, keys: tuple[str, ...] = ()) -> DataFrame:
    """Dollar-weighted loss and interest rates from rows with known outcomes, in one pass."""
    bad, good = F.col(LABEL) == 1, F.col(LABEL) == 0
    kept = (
        cents(F.col("total_rec_prncp"))
        + cents(F.col("recoveries"))
        - cents(F.col("collection_recovery_fee"))
    )
    funded = cents(F.col("funded_amnt"))
    interest = cents(F.col("installment")) * term_months - funded

    def total(condition: Column, amount: Column) -> Column:
        return F.sum(F.when(condition, amount))

    return df.groupBy(*keys).agg(
        F.round(1 - F.try_divide(total(bad, kept), total(bad, funded)), 6).alias("lgd"),
        F.round(
            F.try_divide(total(good, cents(F.col("total_rec_int"))), total(good, interest)), 6
        ).alias("haircut"),
    )


def _loan_ratios(term_months: int) -> tuple[Column, Column]:
    """Loss share of a bad loan and interest share of a good one, per loan."""
    kept = F.col("total_rec_prncp") + F.col("recoveries") - F.col("collection_recovery_fee")
    lgd = F.when(F.col(LABEL) == 1, 1 - F.try_divide(kept, F.col("funded_amnt")))
    interest = contract_interest(term_months)
    return lgd, F.when(F.col(LABEL) == 0, F.try_divide(F.col("total_rec_int"), interest))


def break_even(df: DataFrame, term_months: int = 36) -> DataFrame:
    """Score at which an average loan is neither worth approving nor rejecting."""
    lgd, haircut = _loan_ratios(term_months)
    means = df.agg(
        (F.avg(lgd) * F.avg("funded_amnt")).alias("loss"),
        (F.avg(haircut) * F.avg(contract_interest(term_months))).alias("profit"),
    )
    loss, profit = F.col("loss"), F.col("profit")
    return means.select(
        F.round(loss, 2).alias("mean_loss"),
        F.round(profit, 2).alias("mean_profit"),
        F.round(F.try_divide(profit, loss + profit), 6).alias("break_even"),
    )


def loan_ratio_centres(df: DataFrame, term_months: int = 36) -> DataFrame:
    """Mean and exact median of the two per-loan ratios."""
    lgd, haircut = _loan_ratios(term_months)
    long = df.select(lgd.alias("lgd"), haircut.alias("haircut")).unpivot(
        [], ["lgd", "haircut"], "ratio", "value"
    )
    means = long.groupBy("ratio").agg(F.round(F.avg("value"), 6).alias("mean"))
    medians = ordering.percentiles(long, "value", "ratio", [0.5])
    return means.join(medians, "ratio").select("ratio", "mean", F.round("p0", 6).alias("median"))


def estimate(df: DataFrame, term_months: int = 36) -> Economics:
    rates = cost_model_rates(df, term_months).first()
    return Economics(rates["lgd"], rates["haircut"], term_months)


def decision_cost(reject: Column, economics: Economics) -> Column:
    """Aggregate expression: the dollar cost of rejecting where ``reject`` holds."""
    lost = F.sum(F.when(~reject & (F.col(LABEL) == 1), F.col(FUNDED)).otherwise(0))
    forgone = F.sum(F.when(reject & (F.col(LABEL) == 0), F.col(INTEREST)).otherwise(0))
    return (F.lit(economics.lgd) * lost + F.lit(economics.haircut) * forgone) / 100


def expected_value_reject(economics: Economics) -> Column:
    """Reject when the expected loss of this loan exceeds its expected profit."""
    score = F.col(SCORE)
    return score * economics.loss_if_default() > (1 - score) * economics.profit_if_good()


def cost_curve(
    df: DataFrame, economics: Economics, grid: tuple[float, ...], keys: tuple[str, ...] = ()
) -> DataFrame:
    """Cost and reject rate of "reject if pd >= t" for every t of the grid, in one pass.

    A row is counted under the number of grid points at or below its score; the curve is then a
    pair of running sums over at most ``len(grid) + 1`` rows.
    """
    points = ordering.literal_array(grid)
    bucket = ordering.count_up_to(points, F.col(SCORE), len(grid))
    counted = df.groupBy(*keys, bucket.alias("bucket")).agg(
        F.count("*").alias("loans"),
        F.sum(F.when(F.col(LABEL) == 1, F.col(FUNDED)).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col(LABEL) == 0, F.col(INTEREST)).otherwise(0)).alias("good"),
    )
    order = W.partitionBy(*keys).orderBy("bucket")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    everything = W.partitionBy(*keys)
    # Threshold number i (from 0) rejects the buckets above i. A bucket answers for the numbers
    # from its own up to the next bucket present, the lowest one also for those before it.
    following = F.coalesce(F.lead("bucket").over(order), F.lit(len(grid)))
    first = F.when(F.row_number().over(order) == 1, 0).otherwise(F.col("bucket"))
    sums = counted.select(
        *keys,
        "bucket",
        first.alias("first"),
        following.alias("following"),
        F.sum("bad").over(upto).alias("bad_upto"),
        F.sum("good").over(upto).alias("good_upto"),
        F.sum("loans").over(upto).alias("loans_upto"),
        F.sum("good").over(everything).alias("good_all"),
        F.sum("loans").over(everything).alias("loans_all"),
    ).filter(F.col("first") < F.col("following"))
    at = sums.withColumn("i", F.explode(F.sequence("first", F.col("following") - 1)))

    def approved(total: str) -> Column:
        return F.when(F.col("i") < F.col("bucket"), 0).otherwise(F.col(total))

    lost = F.lit(economics.lgd) * approved("bad_upto")
    forgone = F.lit(economics.haircut) * (F.col("good_all") - approved("good_upto"))
    return at.select(
        *keys,
        F.get(points, F.col("i")).alias("threshold"),
        ((lost + forgone) / 100).alias("cost"),
        ((F.col("loans_all") - approved("loans_upto")) / F.col("loans_all")).alias("reject_rate"),
    )


def best_threshold(curve: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The cheapest threshold; the smallest one when several cost the same."""
    order = F.struct("cost", "threshold")
    return curve.groupBy(*keys).agg(
        F.min_by("threshold", order).alias("threshold"),
        F.min("cost").alias("cost"),
        F.min_by("reject_rate", order).alias("reject_rate"),
    )


def policy_summary(
    df: DataFrame, economics: Economics, policies: dict[str, Column], keys: tuple[str, ...] = ()
) -> DataFrame:
    """Cost, savings and rejection shares of each named decision rule.

    Every rule is one set of aggregates over the same pass; the rows per rule are made from the
    single aggregated row.
    """
    y = F.col(LABEL)
    measures = [decision_cost(F.lit(False), economics).alias("base_cost")]
    for name, reject in policies.items():
        rejected = reject.cast("int")
        measures += [
            F.struct(
                F.lit(name).alias("policy"),
                decision_cost(reject, economics).alias("cost"),
                F.avg(rejected).alias("reject_rate"),
                F.avg(F.when(y == 1, rejected)).alias("defaults_caught"),
                F.avg(F.when(y == 0, rejected)).alias("good_loans_rejected"),
            ).alias(name)
        ]
    cost, base = F.col("rule.cost"), F.col("base_cost")
    return (
        df.groupBy(*keys)
        .agg(*measures)
        .select(*keys, "base_cost", F.explode(F.array(*policies)).alias("rule"))
        .select(
            *keys,
            "rule.policy",
            F.round(cost).alias("cost"),
            F.round(base - cost).alias("savings"),
            F.round(100 * (1 - F.try_divide(cost, base)), 2).alias("savings_pct"),
            *(
                F.round(f"rule.{share}", 4).alias(share)
                for share in ("reject_rate", "defaults_caught", "good_loans_rejected")
            ),
        )
    )
