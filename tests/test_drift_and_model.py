"""Drift must stay quiet on the same data and speak up on shifts; scores must explain themselves."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from duecourse.config import Monitoring, TreeSettings, Window
from duecourse.operators import drift as D
from duecourse.operators import ordering
from duecourse.operators import scoring as S
from duecourse.operators.economics import Economics
from duecourse.operators.isotonic import isotonic_blocks
from duecourse.plans import backtest
from duecourse.plans import training as T
from duecourse.plans import trees as Trees
from duecourse.registry import LOANS
from duecourse.session import stored
from duecourse.sources import logs, reports

RULES = Monitoring(Window.of("2017-05", "2020-09"), reference_sample=2000)


def scored(frame, seed, shift=0.0):
    pd_hat = F.least(F.lit(1.0), F.pow(F.rand(seed), F.lit(3)) * 0.5 + shift)
    one_month = frame.withColumn("pd", pd_hat).withColumn(
        "decision", F.when(F.col("pd") >= 0.24, "reject").otherwise("approve")
    )
    return stored(one_month, f"scored-{seed}")


def summary(current, reference):
    base = D.monitored(reference, LOANS)
    edges = D.reference_edges(base, LOANS)
    rows = D.monitored(current, LOANS).withColumn("month", F.lit("2018-01-01").cast("date"))
    drift = D.feature_drift(
        D.bin_counts(rows, edges, LOANS, ["month"]), D.bin_counts(base, edges, LOANS, [])
    )
    return D.monthly_summary(drift, D.decision_rates(rows), RULES).first()


@pytest.fixture(scope="module")
def reference(random_loans):
    return scored(random_loans(2000, 1), 1)


def test_quiet_when_nothing_changed(random_loans, reference):
    found = summary(scored(random_loans(2000, 2), 2), reference)
    assert found["alerts"] == [] and found["loans"] == 2000 and found["drifted_share"] < 0.3


def test_alerts_on_a_broad_shift(random_loans, reference):
    names = ["loan_amnt", "annual_inc", "dti", "revol_bal", "revol_util", "total_acc"]
    moved = [c for c in LOANS.numeric if c.startswith(("num_", "mo_sin", "mths_since"))]
    frame = random_loans(2000, 3).withColumns(
        {n: F.col(n) * 3 for n in names} | {n: F.col(n) + 50 for n in moved}
    )
    found = summary(scored(frame, 3, 0.25), reference)
    assert found["drifted_share"] >= 0.3 and found["prediction_psi"] >= 0.2
    assert len(found["alerts"]) >= 2 and len(found["top_drifted"]) == 5


def test_alerts_when_a_feed_goes_blank(random_loans, reference):
    frame = random_loans(2000, 4).withColumn("dti", F.when(F.col("id") >= 600, F.col("dti")))
    found = summary(scored(frame, 4), reference)
    assert any("missing rate of dti" in a for a in found["alerts"])


def test_log_round_trip(spark, random_loans, tmp_path):
    loans = random_loans(30, 5).withColumn("pd", F.lit(0.1))
    decided = S.decide_applications(loans, 0.24, Economics(0.5, 0.8), "1")
    logs.append_log(decided, str(tmp_path / "log"), LOANS, request_id=F.lit("req"))
    served = logs.served_applications(logs.raw_log(spark, str(tmp_path / "log")), LOANS)
    inputs = ["issue_d", *LOANS.features]
    assert served.count() == 30
    assert served.select(*inputs).exceptAll(loans.select(*inputs)).count() == 0


@pytest.mark.parametrize(
    "change, flag",
    [
        ({"fico_range_low": "620.0D"}, "fico_below_660"),
        ({"earliest_cr_line": "add_months(issue_d, -12)"}, "credit_history_under_36_months"),
        ({"loan_amnt": "35000D", "annual_inc": "40000D"}, "loan_to_income_above_0.5"),
    ],
)
def test_policy_flags_refer(random_loans, change, flag):
    base = {"loan_amnt": "1000D", "annual_inc": "90000D", **change}
    loans = random_loans(3, 6).withColumns({n: F.expr(e) for n, e in base.items()})
    row = S.decide_applications(loans.withColumn("pd", F.lit(0.9)), 0.24, Economics(0.5, 0.8), "1").first()
    assert row["policy_flags"] == [flag] and row["decision"] == "refer"


def test_flatten(spark):
    frame = spark.sql("SELECT named_struct('b', 1, 'c', named_struct('d', 2.5D, 'ok', true)) AS a, 'x' AS t")
    found = {r["metric"]: r["value"] for r in reports.flatten(frame, "val.").collect()}
    assert found == {"val.a.b": 1.0, "val.a.c.d": 2.5}


def test_one_fit_gives_all_shorter_ones_scores_and_contributions(spark, random_loans):
    loans = random_loans(600, 7).withColumn("y", (F.coalesce("dti", F.lit(90)) > 60).cast("tinyint"))
    loans = stored(loans, "model-loans")
    stages = T.input_stages(loans, LOANS, "loans")
    rows = T.training_rows(T.run_stages(stages, loans), "model-rows")
    settings = TreeSettings(max_trees=4, step_size=0.3, max_depth=3, min_per_leaf=5, patience=2)
    trees, losses = T.fit_trees(rows, rows, settings)
    assert len(losses) <= 4 and len(trees.nodes) == 1 + losses.index(min(losses))
    shape = dict(labelCol="y", stepSize=0.3, maxDepth=3, minInstancesPerNode=5, subsamplingRate=0.8,
                 featureSubsetStrategy="0.8", seed=42, checkpointInterval=20)
    x = vector_to_array("features")
    for size in (1, 2, 4):
        model = GBTClassifier(maxIter=size, **shape).fit(rows)
        own = Trees.TreeEnsemble.of(Trees.nodes_of(model, spark))
        if size < len(trees.nodes):
            assert own.nodes == trees.cut(size).nodes
        groups = [i % 5 for i in range(model.numFeatures)]
        got = model.transform(rows).select(
            vector_to_array("probability")[1].alias("spark"), own.probability(x).alias("own"),
            own.contributions(x, groups, 5).alias("push"), own.running(x).alias("running"),
        ).toPandas()
        assert np.abs(got["spark"] - got["own"]).max() < 1e-12
        rest = np.log(got["own"] / (1 - got["own"])) - got["push"].map(sum)
        assert rest.std() < 1e-9 and set(got["running"].map(len)) == {size}
        assert np.abs(model.evaluateEachIteration(rows)[-1] / 2 - Trees.prefix_losses(own, rows)[-1]) < 1e-9
    plan = rows.select(own.probability(x).alias("p"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "from_json" not in plan


def test_patience_and_least_gain():
    assert T.best_iteration([3.0, 2.0, 2.5, 2.6, 1.0], patience=2) == 2
    assert T.best_iteration([3.0, 2.0, 1.99, 1.98, 1.0], patience=2, min_gain=0.1) == 2
    assert T.best_iteration([3.0, 2.0, 1.99, 1.0], patience=2, min_gain=0.1) == 4


@pytest.mark.parametrize("kind", ["noise", "falling", "rising", "one score", "nothing"])
def test_isotonic_fit_is_the_max_min_of_means(spark, kind):
    rng = np.random.default_rng(5)
    score = {"one score": np.full(50, 0.5), "nothing": np.zeros(0)}.get(kind, np.round(rng.random(900), 3))
    chance = {"falling": 1 - score, "noise": np.full(len(score), 0.3)}.get(kind, score)
    y = (rng.random(len(score)) < chance).astype(int)
    rows = spark.createDataFrame([(float(s), int(v)) for s, v in zip(score, y)] + [(None, 1), (0.5, None)], "s double, y int")
    blocks = isotonic_blocks(rows, "s", "y")
    calibration = Trees.Calibration(blocks=T.blocks_json(blocks))
    points = sorted(set(score.tolist()))
    sums = np.array([[y[score == p].sum(), (score == p).sum()] for p in points]).reshape(-1, 2).cumsum(0)
    sums = np.vstack([[0, 0], sums])
    means = {(a, b): (sums[b + 1] - sums[a])[0] / (sums[b + 1] - sums[a])[1]
             for a in range(len(points)) for b in range(a, len(points))}
    worst = np.full((len(points), len(points) + 1), np.inf)  # least mean from a to the end or beyond
    for a in range(len(points)):
        for b in reversed(range(a, len(points))):
            worst[a, b] = min(means[a, b], worst[a, b + 1])
    got = {r["s"]: r["c"] for r in rows.filter("s IS NOT NULL").select("s", calibration.calibrated(F.col("s")).alias("c")).distinct().collect()}
    for b, p in enumerate(points):
        assert abs(got[p] - max(worst[a, b] for a in range(b + 1))) < 1e-12
    if kind == "falling":
        assert blocks.count() < 10
    if points and kind != "one score":
        ends = spark.createDataFrame([(-1.0,), (2.0,), ((points[3] + points[4]) / 2,)], "s double")
        low, high, middle = (r[0] for r in ends.select(calibration.calibrated(F.col("s"))).collect())
        assert (low, high) == (got[points[0]], got[points[-1]])
        assert abs(middle - (got[points[3]] + got[points[4]]) / 2) < 1e-9


def test_one_scan_scores_all_pairs(spark):
    a, b = (Window.of(*w) for w in (("2015-01", "2015-03"), ("2015-03", "2015-04")))
    rows = spark.sql("SELECT id, 0 AS y, add_months(DATE '2015-01-01', CAST(id AS INT)) AS issue_d, id / 10D AS x FROM range(6)")
    found = [("m1", "m1", a), ("m1", "m2", b), ("m2", "m2", b)]
    out = backtest.scored_by_all(rows, found, {"m1": F.col("x"), "m2": F.col("x") + 1}, {"m1": 0.2, "m2": 1.25})
    got = sorted((r["pair"], r["id"], r["pd"], r["reject"]) for r in out.collect())
    assert got == [("m1|m1", 0, 0.0, False), ("m1|m1", 1, 0.1, False), ("m1|m1", 2, 0.2, True),
                   ("m1|m2", 2, 0.2, True), ("m1|m2", 3, 0.3, True), ("m2|m2", 2, 1.2, False), ("m2|m2", 3, 1.3, True)]
    assert out._jdf.queryExecution().executedPlan().toString().count("Range (") == 1


def test_row_level_plans_have_no_single_task_step(spark, random_loans):
    """Bins and samples may use one task for their small tables only, never for the rows."""
    rows = random_loans(200, 8).withColumn("pd", F.rand(1))
    plan = ordering.first_by_hash(rows, 50, 1, "id", "issue_d")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan


def test_a_bin_per_row_is_no_single_task(spark):
    """A reference feature of few values whose current side has a value per row."""
    from duecourse.operators import drift

    now = spark.range(5000).select(F.lit("2015-01").alias("month"), F.lit("x").alias("feature"),
                                   F.col("id").cast("string").alias("bin"), F.lit(1).alias("n"))
    plan = drift._shares(now, ["month"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    row = drift._shares(now, ["month"]).agg(F.max("rows"), F.min("present"), F.count("*")).first()
    assert tuple(row) == (5000, 5000, 5000)


def test_contributions_are_rounded_by_their_stored_number(spark):
    values = [0.50125, 0.12345, 1.00005, 2.67495, 3.00015, 0.1, 12345.67895, 0.03125, float("inf")]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in rows.select(S.four_digits(F.col("v"))).collect()] == [round(v, 4) for v in values]


def test_features_that_drift_alike_are_ranked_by_name(spark):
    """The same index up to the last bits of a sum."""
    day = F.lit("2018-01-01").cast("date").alias("month")
    found = [("b", 0.3), ("a", 0.1 + 0.1 + 0.1 - 1e-16), ("c", 0.3000001), ("pd", 0.0)]
    drift = spark.createDataFrame(found, "feature string, psi double").select(
        day, "feature", "psi", F.lit(0.0).alias("missing_rate"), F.lit(0.0).alias("missing_change"))
    rates = spark.range(1).select(
        day, F.lit(5).alias("loans"), *(F.lit(0.0).alias(c) for c in ("mean_pd", "reject_rate", "refer_rate")))
    for at, value in ((1, 0.3 - 1e-16), (0, 0.30000000000000004)):
        psi = F.when(F.col("feature") == "ab"[1 - at], value).otherwise(F.col("psi"))
        top = D.monthly_summary(drift.withColumn("psi", psi), rates, RULES).first()["top_drifted"]
        assert [t["feature"] for t in top] == ["c", "a", "b"]
