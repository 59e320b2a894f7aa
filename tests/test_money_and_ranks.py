"""Hand-computed cases, and brute force on skewed frames for everything that needs an order."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duecourse.config import PromotionRules
from duecourse.operators import economics as E
from duecourse.operators import metrics as M
from duecourse.operators import ordering as O
from duecourse.operators import promotion as Pr
from duecourse.operators import sampling


@pytest.fixture(scope="module")
def priced(spark):
    rows = [
        (1, 1, 10_000.0, 4_000.0, 1_000.0, 0.0, 300.0, 0.0),
        (2, 1, 30_000.0, 12_000.0, 0.0, 0.0, 900.0, 0.0),
        (3, 0, 10_000.0, 10_000.0, 0.0, 0.0, 300.0, 800.0),
        (4, 0, 10_000.0, 10_000.0, 0.0, 0.0, 300.0, 400.0),
    ]
    names = "id long, y int, funded_amnt double, total_rec_prncp double, recoveries double, " \
            "collection_recovery_fee double, installment double, total_rec_int double"
    return spark.createDataFrame(rows, names)


def test_cost_model_is_dollar_weighted(priced):
    model = E.estimate(priced)
    assert (model.lgd, model.haircut) == (23 / 40, 0.75)
    interest = priced.orderBy("id").select(E.contract_interest(36)).collect()
    assert [r[0] for r in interest] == [800.0, 2400.0, 800.0, 800.0]
    assert E.Economics(**model.to_dict()) == model


def scored(spark, rows):
    names = "y int, pd double, funded_cents long, interest_cents long"
    return spark.createDataFrame(rows, names)


def test_decision_cost_counts_two_mistakes(spark):
    frame = scored(spark, [(1, 0.9, 1000, 9900), (1, 0.8, 2000, 9900), (0, 0.1, 9900, 300), (0, 0.2, 9900, 400)])
    one = E.Economics(1.0, 1.0)
    rules = {"none": F.lit(False), "all": F.lit(True), "perfect": F.col("y") == 1}
    costs = frame.agg(*(E.decision_cost(r, one).alias(n) for n, r in rules.items())).first()
    assert costs.asDict() == {"none": 30.0, "all": 7.0, "perfect": 0.0}


def test_cost_curve_and_best_threshold(spark):
    frame = scored(spark, [(y, p, 10_000, 1_000) for y, p in ((1, 0.9), (0, 0.1), (0, 0.2), (1, 0.6))])
    curve = E.cost_curve(frame, E.Economics(1.0, 1.0), (0.05, 0.5, 0.95))
    found = curve.orderBy("threshold").collect()
    assert [r["cost"] for r in found] == [20.0, 0.0, 200.0]
    assert [r["reject_rate"] for r in found] == [1.0, 0.5, 0.0]
    assert E.best_threshold(curve).first()["threshold"] == 0.5


def test_cost_curve_against_brute_force(spark):
    rng = np.random.default_rng(3)
    n, grid = 500, tuple(np.round(np.arange(0.1, 0.95, 0.05), 6).tolist())
    p = np.round(rng.choice([0.1, 0.35, 0.35, 0.35, 0.5, 0.9, 0.05, 0.99], n), 3)
    y, fund, gain = rng.integers(0, 2, n), rng.integers(1, 9_000, n), rng.integers(1, 900, n)
    frame = scored(spark, list(zip(y.tolist(), p.tolist(), fund.tolist(), gain.tolist())))
    curve = E.cost_curve(frame, E.Economics(0.5, 0.8), grid).orderBy("threshold").collect()
    for row, t in zip(curve, grid, strict=True):
        cost = 0.5 * fund[(p < t) & (y == 1)].sum() + 0.8 * gain[(p >= t) & (y == 0)].sum()
        assert row["threshold"] == t and row["cost"] == pytest.approx(cost / 100)
        assert row["reject_rate"] == pytest.approx((p >= t).mean())


def test_expected_value_rule(spark):
    frame = scored(spark, [(0, 0.2, 500_000, 100_000), (0, 0.2, 50_000, 100_000)])
    found = frame.select(E.expected_value_reject(E.Economics(1.0, 1.0))).collect()
    assert [r[0] for r in found] == [True, False]


@pytest.fixture(scope="module")
def skewed(spark):
    """Two keys; one score holds about a third of all rows."""
    rng = np.random.default_rng(0)
    n = 3_000
    p = np.round(rng.beta(2, 8, n), 3)
    p[rng.random(n) < 0.35] = 0.2
    frame = pd.DataFrame(
        {"id": rng.permutation(n).astype("int64"), "pd": p, "y": (rng.random(n) < p).astype("int64"),
         "k": np.where(rng.random(n) < 0.2, "a", "b")}
    )
    return frame, spark.createDataFrame(frame)


def auc(frame):
    ranks = frame["pd"].rank()
    pos = frame["y"] == 1
    p, n = pos.sum(), (~pos).sum()
    return (ranks[pos].sum() - p * (p + 1) / 2) / (p * n)


def average_precision(frame):
    total, last = 0.0, 0.0
    for t in sorted(frame["pd"].unique(), reverse=True):
        taken = frame[frame["pd"] >= t]["y"]
        recall = taken.sum() / frame["y"].sum()
        total += (recall - last) * taken.mean()
        last = recall
    return total


def bins_of(frame, bins=10):
    order = frame.sort_values(["pd", "id"]).reset_index(drop=True)
    order["bin"] = pd.qcut(np.arange(1, len(order) + 1), bins, labels=False)
    return order


def test_ranking_per_key(skewed):
    frame, df = skewed
    found = {r["k"]: r for r in M.ranking(df, key="k").collect()}
    for k, part in frame.groupby("k"):
        assert found[k]["roc_auc"] == pytest.approx(auc(part))
        assert found[k]["pr_auc"] == pytest.approx(average_precision(part))


def test_bins_match_quantile_cut_of_ranks(skewed):
    frame, df = skewed
    found = O.assign_bins(df, "pd", "id", 10, "k").select("k", "id", "bin").toPandas()
    for k, part in frame.groupby("k"):
        expected = bins_of(part).set_index("id")["bin"].sort_index()
        got = found[found["k"] == k].set_index("id")["bin"].sort_index()
        assert got.astype(int).tolist() == expected.astype(int).tolist()


def test_metric_bundle(skewed):
    frame, df = skewed
    found = M.probability_metrics(df).first()
    table = bins_of(frame).groupby("bin").agg(p=("pd", "mean"), y=("y", "mean"), n=("y", "size"))
    ece = ((table["p"] - table["y"]).abs() * table["n"]).sum() / table["n"].sum()
    assert found["ece"] == pytest.approx(ece, abs=1e-5)
    assert found["brier"] == pytest.approx(((frame["pd"] - frame["y"]) ** 2).mean(), abs=1e-5)


def test_percentiles_and_spearman(skewed):
    frame, df = skewed
    found = O.percentiles(df, "pd", "k", [0.01, 0.5, 0.99]).collect()
    for row in found:
        part = frame[frame["k"] == row["k"]]["pd"]
        assert [row["p0"], row["p1"], row["p2"]] == pytest.approx(part.quantile([0.01, 0.5, 0.99]).tolist())
    mixed = df.withColumn("other", F.round(F.col("pd") * 7 + F.col("id") % 5, 2))
    data = mixed.toPandas()
    expected = data["pd"].rank().corr(data["other"].rank())
    assert M.rank_correlation(mixed, "pd", "other").first()[0] == pytest.approx(expected)


def test_order_statistics(skewed):
    frame, df = skewed
    ordered = frame.sort_values(["pd", "id"])["id"].tolist()
    keyed = df.withColumn("all", F.lit("x"))
    places = [F.lit(1), F.lit(700), F.lit(1500), F.col("total_n")]
    found = {r["slot"]: r["id"] for r in O.order_statistics(keyed, "pd", "id", "all", places).collect()}
    assert found == {0: ordered[0], 1: ordered[699], 2: ordered[1499], 3: ordered[-1]}


def test_sample_by_month(spark):
    loans = spark.range(30).withColumn(
        "issue_d", F.when(F.col("id") < 20, F.lit("2018-01-01")).otherwise(F.lit("2018-02-01")).cast("date")
    )
    first = sampling.replay_order(sampling.sample_by_month(loans, 5, 1)).collect()
    assert first == sampling.replay_order(sampling.sample_by_month(loans.repartition(3), 5, 1)).collect()
    assert [r["issue_d"].month for r in first] == [1] * 5 + [2] * 5
    assert sampling.sample_by_month(loans, 50, 1).count() == 30
    assert sampling.sample_rows(loans, 17, 9).count() == 17
    assert sampling.sample_rows(loans, 100, 9).count() == 30


def test_calibration_extremes(spark):
    even = spark.range(1000).select("id", (F.col("id") / 999).alias("pd"), F.lit(0).alias("y"))
    assert [r["loans"] for r in M.calibration_table(even).collect()] == [100] * 10
    draws = spark.range(0, 60_000).select("id", F.rand(1).alias("pd"), F.rand(2).alias("u"))
    draws = draws.withColumn("y", (F.col("u") < F.col("pd")).cast("int"))
    assert M.calibration_error(draws).first()["ece"] < 0.02
    off = draws.withColumn("pd", F.least(F.lit(1.0), F.col("pd") + 0.2))
    assert M.calibration_error(off).first()["ece"] > 0.15


@pytest.mark.parametrize(
    "change, champion, promoted, text",
    [
        ({}, True, True, "1.000% lower"), ({"cost": 1_000_000.0}, True, False, "improvement"),
        ({"cost": 999_500.0}, True, False, "improvement"),
        ({"cost": 900_000.0, "roc_auc": 0.68}, True, False, "ROC-AUC"),
        ({"ece": 0.05}, True, False, "ECE"), ({}, False, True, "bootstrap"), ({"ece": 0.05}, False, False, "ECE"),
    ],
)
def test_promotion_rules(spark, change, champion, promoted, text):
    new = {"role": "challenger", "version": "2", "cost": 990_000.0, "roc_auc": 0.69, "ece": 0.005, **change}
    old = {"role": "champion", "version": "1", "cost": 1_000_000.0, "roc_auc": 0.69, "ece": 0.005}
    table = spark.createDataFrame(
        [tuple(r.values()) for r in ([new, old] if champion else [new])],
        "role string, version string, cost double, roc_auc double, ece double",
    )
    verdict = Pr.decide(table, PromotionRules()).first()
    assert verdict["promoted"] is promoted and text in verdict["reason"]


def test_incomparable_versions_are_not_promoted(spark):
    schema = "role string, version string, cost double, roc_auc double, ece double"

    def verdict(*rows):
        return Pr.decide(spark.createDataFrame(rows, schema), PromotionRules()).first()

    new = ("challenger", "10", 90.0, 0.7, 0.01)
    for old in (("champion", "9", 0.0, 0.7, 0.01), ("champion", "9", None, 0.7, 0.01), ("champion", "9", 99.0, None, 0.01)):
        assert verdict(new, old)["promoted"] is False
    assert verdict(("challenger", "10", 90.0, None, 0.01))["promoted"] is False
    assert verdict(new)["promoted"] is True
    with pytest.raises(Exception, match="more than one challenger"):
        verdict(new, ("challenger", "9", 80.0, 0.7, 0.01))


def test_fingerprints_tell_tables_apart(spark):
    def mark(*rows):
        return Pr.fingerprint(spark.createDataFrame(rows, "a string, b string"), ["a", "b"]).first()["content"]

    tables = [[("a|b", "c")], [("a", "b|c")], [(None, "c")], [("~", "c")], [("null", "c")], [("a", None)], [("a", "")]]
    assert len({mark(*t) for t in tables}) == len(tables)
    assert mark(("x", "1"), ("y", "2")) == mark(("y", "2"), ("x", "1"))
