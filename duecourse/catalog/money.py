"""Cost and threshold queries."""

from pyspark.sql import functions as F

from duecourse.catalog.core import PRICES, SETTINGS, add_view, query
from duecourse.operators import economics as E
from duecourse.operators import joins, vocabulary
from duecourse.operators import windows as Wn

GRID = SETTINGS.grid
L, H = PRICES.lgd, PRICES.haircut

add_view(
    "grid",
    "SELECT round(0.01 + 0.005 * i, 6) AS threshold FROM range(197) r(i)",
    [],
)
add_view(
    "curve",
    f"""SELECT threshold, ({L} * sum(CASE WHEN pd < threshold AND y = 1 THEN funded_cents ELSE 0 END)
          + {H} * sum(CASE WHEN pd >= threshold AND y = 0 THEN interest_cents ELSE 0 END)) / 100 AS cost,
        avg(CASE WHEN pd >= threshold THEN 1.0 ELSE 0.0 END) AS reject_rate
        FROM scored CROSS JOIN grid GROUP BY threshold""",
    ["scored", "grid"],
)


@query(
    "a2_contract_interest",
    "SELECT id, round(installment * 36 - funded_amnt, 2) AS contract_interest FROM {aux}",
)
def a2(t):
    return t.aux.select("id", F.round(E.contract_interest(36), 2).alias("contract_interest"))


RATES = """round(1 - sum(CASE WHEN y = 1 THEN total_rec_prncp + recoveries - collection_recovery_fee END)
                 / sum(CASE WHEN y = 1 THEN funded_amnt END), 6) AS lgd,
           round(sum(CASE WHEN y = 0 THEN total_rec_int END)
                 / sum(CASE WHEN y = 0 THEN installment * 36 - funded_amnt END), 6) AS haircut"""


@query("a3_loss_given_default", f"SELECT lgd FROM (SELECT {RATES} FROM {{scored}}) q")
def a3(t):
    joined = joins.join_one_to_one(t.loans.select("id", "y"), t.aux, "id")
    return E.cost_model_rates(joined).select("lgd")


@query("a4_interest_haircut", f"SELECT split, haircut FROM (SELECT split, {RATES} FROM {{scored}} GROUP BY split) q")
def a4(t):
    rows = Wn.assign_split(t.scored, SETTINGS.splits)
    return E.cost_model_rates(rows, keys=("split",)).select("split", "haircut")


@query(
    "a5_loss_and_profit",
    f"SELECT id, round({L} * funded_cents / 100, 4) AS loss, round({H} * interest_cents / 100, 4) AS profit FROM {{scored}}",
)
def a5(t):
    return t.scored.select(
        "id",
        F.round(PRICES.loss_if_default(), 4).alias("loss"),
        F.round(PRICES.profit_if_good(), 4).alias("profit"),
    )


@query(
    "a6_decision_cost",
    f"""SELECT split, round(({L} * sum(CASE WHEN pd < 0.3 AND y = 1 THEN funded_cents ELSE 0 END)
          + {H} * sum(CASE WHEN pd >= 0.3 AND y = 0 THEN interest_cents ELSE 0 END)) / 100, 2) AS cost
        FROM {{scored}} GROUP BY split""",
)
def a6(t):
    rows = Wn.assign_split(t.scored, SETTINGS.splits)
    cost = E.decision_cost(F.col("pd") >= 0.3, PRICES)
    return rows.groupBy("split").agg(F.round(cost, 2).alias("cost"))


@query(
    "a7_cost_curve",
    "SELECT threshold, round(cost, 2) AS cost, round(reject_rate, 6) AS reject_rate FROM {curve}",
)
def a7(t):
    return E.cost_curve(t.scored, PRICES, GRID).select(
        "threshold", F.round("cost", 2).alias("cost"), F.round("reject_rate", 6).alias("reject_rate")
    )


@query(
    "a8_threshold_grid",
    """SELECT g.threshold, count(s.id) AS loans FROM {grid} g
       LEFT JOIN {scored} s ON s.pd >= g.threshold GROUP BY g.threshold""",
)
def a8(t):
    """The grid, with the number of loans at or above each of its points."""
    total = E.cost_curve(t.scored.withColumn("all", F.lit(1)), PRICES, GRID)
    loans = t.scored.agg(F.count("*")).scalar()
    return total.select("threshold", F.round(F.col("reject_rate") * loans).cast("bigint").alias("loans"))


BEST = "(SELECT threshold, cost, reject_rate FROM {curve} ORDER BY cost, threshold LIMIT 1)"


@query(
    "a9_best_threshold",
    f"SELECT threshold, round(cost, 2) AS cost, round(reject_rate, 6) AS reject_rate FROM {BEST} q",
)
def a9(t):
    best = E.best_threshold(E.cost_curve(t.scored, PRICES, GRID))
    return best.select(
        "threshold", F.round("cost", 2).alias("cost"), F.round("reject_rate", 6).alias("reject_rate")
    )


EV = f"pd * ({L} * funded_cents / 100) > (1 - pd) * ({H} * interest_cents / 100)"


@query("a10_expected_value_rule", f"SELECT id, {EV} AS reject FROM {{scored}}")
def a10(t):
    return t.scored.select("id", E.expected_value_reject(PRICES).alias("reject"))


@query(
    "a11_approve_all",
    f"SELECT round({L} * sum(CASE WHEN y = 1 THEN funded_cents ELSE 0 END) / 100, 2) AS cost FROM {{scored}}",
)
def a11(t):
    return t.scored.agg(F.round(E.decision_cost(F.lit(False), PRICES), 2).alias("cost"))


def sql_policy(name: str, reject: str) -> str:
    cost = (
        f"(({L} * sum(CASE WHEN NOT ({reject}) AND y = 1 THEN funded_cents ELSE 0 END) "
        f"+ {H} * sum(CASE WHEN {reject} AND y = 0 THEN interest_cents ELSE 0 END)) / 100)"
    )
    base = f"(({L} * sum(CASE WHEN y = 1 THEN funded_cents ELSE 0 END)) / 100)"
    rate = f"CASE WHEN {reject} THEN 1.0 ELSE 0.0 END"
    return f"""SELECT '{name}' AS policy, round({cost}) AS cost, round({base} - {cost}) AS savings,
        round(100 * (1 - {cost} / {base}), 2) AS savings_pct, round(avg({rate}), 4) AS reject_rate,
        round(avg(CASE WHEN y = 1 THEN {rate} END), 4) AS defaults_caught,
        round(avg(CASE WHEN y = 0 THEN {rate} END), 4) AS good_loans_rejected"""


SUMMARY = " UNION ALL ".join(
    f"{sql_policy(n, r)} FROM {{scored}}"
    for n, r in (
        ("fixed_threshold", "pd >= 0.24"),
        ("expected_value", EV),
        ("best_threshold", "pd >= (SELECT threshold FROM best)"),
    )
)


@query("a12_policy_summary", f"WITH best AS {BEST} {SUMMARY}")
def a12(t):
    best = E.best_threshold(E.cost_curve(t.scored, PRICES, GRID)).select("threshold").scalar()
    return E.policy_summary(
        t.scored,
        PRICES,
        {
            "fixed_threshold": F.col("pd") >= 0.24,
            "expected_value": E.expected_value_reject(PRICES),
            "best_threshold": F.col("pd") >= best,
        },
    )


VAL = " UNION ALL ".join(
    f"{sql_policy(n, r)} FROM val" for n, r in (("approve_all", "pd > 1"), ("model", "pd >= 0.42"), ("expected_value", EV))
)


@query("a13_validation_summary", f"WITH val AS (SELECT * FROM {{scored}} WHERE split = 'val') {VAL}")
def a13(t):
    val = Wn.assign_split(t.scored, SETTINGS.splits).filter(F.col("split") == "val")
    rules = {
        "approve_all": F.lit(False),
        "model": F.col("pd") >= 0.42,
        "expected_value": E.expected_value_reject(PRICES),
    }
    return E.policy_summary(val, PRICES, rules)


RATIOS = """CASE WHEN y = 1 THEN 1 - (total_rec_prncp + recoveries - collection_recovery_fee) / funded_amnt END AS lgd,
            CASE WHEN y = 0 THEN total_rec_int / (installment * 36 - funded_amnt) END AS haircut"""


@query(
    "a14_break_even",
    f"""SELECT round(l, 2) AS mean_loss, round(g, 2) AS mean_profit, round(g / (l + g), 6) AS break_even FROM (
          SELECT avg(lgd) * avg(funded_amnt) AS l, avg(haircut) * avg(installment * 36 - funded_amnt) AS g
          FROM (SELECT *, {RATIOS} FROM {{scored}}) r) q""",
)
def a14(t):
    return E.break_even(t.scored)


@query(
    "a15_ratio_mean_median",
    f"""SELECT 'lgd' AS ratio, round(avg(lgd), 6) AS mean, round(median(lgd), 6) AS median FROM (SELECT {RATIOS} FROM {{scored}}) q
        UNION ALL SELECT 'haircut', round(avg(haircut), 6), round(median(haircut), 6) FROM (SELECT {RATIOS} FROM {{scored}}) q""",
)
def a15(t):
    return E.loan_ratio_centres(t.scored)


@query(
    "a16_category_vocabulary",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {c} AS value, row_number() OVER (ORDER BY {c}) - 1 AS code
            FROM {{loans}} WHERE {c} IS NOT NULL GROUP BY {c}""" for c in ("home_ownership", "purpose")
    ),
)
def a16(t):
    return vocabulary.learned(t.loans, ["home_ownership", "purpose"]).select("column", "value", "code")


@query(
    "a18_event_percentiles",
    """SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50,
         round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99,
         round(max(value), 6) AS largest,
         round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 6) AS per_second FROM events GROUP BY event_type""",
)
def a18(t):
    from duecourse.operators.profile import latency_profile

    return latency_profile(t.table("events"), "event_type", "value", "ts")
