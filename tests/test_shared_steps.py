"""Steps that several queries share go over their input once, with the results of separate passes."""

import pytest
from pyspark.sql import functions as F

from duecourse.catalog import models, monitor
from duecourse.catalog.core import Inputs
from duecourse.config import Population, TreeSettings, Window
from duecourse.operators import clean as C
from duecourse.plans import training as T
from duecourse.plans import trees as Trees
from duecourse.registry import LOANS

TABLES = "/root/testdata/sf0.001"


def same(left, right):
    return left.columns == right.columns and left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.mark.parametrize("populations", [1, 2])
def test_one_pass_types_what_separate_passes_do(make_raw, population, populations):
    raw = make_raw(
        {}, {"term": " 60 months"}, {"loan_status": "Current"}, {"issue_d": "Sep-2018"}, {"issue_d": "2015"},
        {"issue_d": None}, {"loan_status": None}, {"id": "Loans of 2015"}, {"dti": "-1"}, {"int_rate": "n/a"},
    )
    wanted = [(population, True), (Population(Window.of("2015-01", "2020-09")), False)][:populations]
    made = C.clean_once(raw, wanted, LOANS)
    for one, (own, needs_outcome) in zip(made, wanted, strict=True):
        apart = C.clean(raw, own, LOANS, needs_outcome)
        assert same(one.loans, apart.loans) and same(one.aux, apart.aux) and one.loans.count() >= 3
    assert len({tuple(sorted(frame.inputFiles())) for one in made for frame in one}) == 1


def test_models_and_drift_derive_their_loans_once(spark):
    inputs = Inputs(spark, TABLES)
    loans, aux = models.tables(inputs)
    assert sorted(loans.inputFiles()) == sorted(aux.inputFiles())
    assert same(loans, inputs.loans) and same(aux, inputs.aux)
    assert sorted(monitor.reference(inputs).inputFiles()) == sorted(monitor.reference(inputs).inputFiles())


def test_losses_come_from_the_fitted_model(monkeypatch, random_loans):
    loans = random_loans(300, 3).withColumn("y", (F.coalesce("dti", F.lit(90)) > 60).cast("tinyint"))
    rows = T.training_rows(T.run_stages(T.input_stages(loans, LOANS, "loans"), loans), "loss-rows")
    settings = TreeSettings(max_trees=3, step_size=0.3, max_depth=2, min_per_leaf=5, patience=3)
    with monkeypatch.context() as patch:
        patch.setattr(Trees.TreeEnsemble, "running", lambda *_: pytest.fail("losses unfolded in expressions"))
        trees, losses = T.fit_trees(rows, rows, settings)
    assert losses[: len(trees.nodes)] == pytest.approx(Trees.prefix_losses(trees, rows), abs=1e-12)


def test_models_of_several_dates_share_one_priced_table(monkeypatch, spark, random_loans):
    """Loans and amounts are joined once, and a model's trees go over its validation loans once."""
    loans = random_loans(900, 5).withColumn("y", (F.coalesce("dti", F.lit(90)) > 60).cast("tinyint"))
    loans = T.stored(loans, "priced-loans")
    paid = F.when(F.col("y") == 1, F.col("loan_amnt") / 4).otherwise(F.col("loan_amnt"))
    aux = loans.select(
        "id", F.col("loan_amnt").alias("funded_amnt"), F.round(F.col("loan_amnt") / 30, 2).alias("installment"),
        paid.alias("total_rec_prncp"), (F.col("loan_amnt") / 9).alias("total_rec_int"),
        F.lit(0.0).alias("recoveries"), F.lit(0.0).alias("collection_recovery_fee"),
    )
    settings = TreeSettings(max_trees=2, step_size=0.3, max_depth=2, min_per_leaf=5, patience=1)
    done = {"joins": 0, "scored": 0}

    def counted(name, work):
        def run(*args):
            done[name] += 1
            return work(*args)

        return run

    monkeypatch.setattr(T, "join_one_to_one", counted("joins", T.join_one_to_one))
    monkeypatch.setattr(Trees.TreeEnsemble, "_transform", counted("scored", Trees.TreeEnsemble._transform))
    money = T.priced(loans, aux)
    for last in ("2015-06", "2016-06"):
        splits = {"train": Window.of("2013-02", "2014-12"), "val": Window.of("2015-01", last)}
        whole = Population(Window.of("2013-02", last))
        model, val = T.fit_policy_model(loans, money, splits, whole, settings, LOANS, "loans")
        assert done["scored"] == 1
        again = model.score(loans.filter(splits["val"].contains(F.col("issue_d"))), ("id", "y"))
        assert same(val.select(again.columns), again) and not val.isEmpty()
        done["scored"] = 0
    assert done["joins"] == 1
