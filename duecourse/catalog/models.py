"""Fitted-model queries. A boosted model has no SQL twin, so what it says is checked by its rows; what
must hold of it whatever the trees are (``*_invariants``) and the isotonic fit have one."""

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from duecourse.catalog.core import SETTINGS, Inputs, add_view, query, sql_between
from duecourse.config import TreeSettings, windows_for
from duecourse.operators import clean as C
from duecourse.operators import economics as E
from duecourse.operators import metrics as M
from duecourse.operators import scoring as S
from duecourse.operators.isotonic import isotonic_blocks
from duecourse.plans import backtest as B
from duecourse.plans import training as T
from duecourse.registry import STANDIN
from duecourse.session import shared_folder, stored

# The published depth and shares. Larger steps and fewer loans a leaf suit tables of some thousand
# loans, and a tree counts as progress only where the loss falls by more than min_gain: the outcome of
# these loans follows from their inputs, so that the loss would fall, ever less, for hundreds of trees.
CHECKED = TreeSettings(step_size=0.3, min_per_leaf=20, patience=5, min_gain=0.002)
R = SETTINGS.retraining
# What has been fitted, by table, for the session it was fitted in.
_FITTED: dict[str, tuple] = {}


def tables(t):
    """Loans and their auxiliary rows, derived and typed in one pass over the given tables."""
    return C.clean_once(t.raw, [(SETTINGS.population, True)], STANDIN)[0]


def fitted(t):
    """The model of this table size, fitted once per session."""
    session = t.spark.sparkContext.applicationId
    for key in [k for k, (owner, _) in _FITTED.items() if owner != session]:
        del _FITTED[key]
    if t.sf_dir not in _FITTED:
        _FITTED[t.sf_dir] = session, _fit(t)
    return _FITTED[t.sf_dir][1]


def _fit(t: Inputs):
    loans, aux = tables(t)
    model, val = T.fit_policy_model(
        loans, T.priced(loans, aux), SETTINGS.splits, SETTINGS.population, CHECKED, STANDIN, "standin"
    )
    test = loans.filter(SETTINGS.splits["test"].contains(F.col("issue_d")))
    money = E.with_exposure(aux).select("id", E.FUNDED, E.INTEREST, "int_rate", "grade")
    scored = stored(model.score(test, ("id", "y")).join(money, "id"), "test-scored")
    return model, val, loans, aux, test, scored


@query("m1_boosted_trees")
def m1(t):
    model, _, _, _, _, scored = fitted(t)
    return M.ranking(scored, score=T.RAW).withColumn("trees", F.lit(len(model.trees.nodes)))


@query("m1_score_invariants", "SELECT count(*) AS loans, 0 AS outside, 0 AS differing FROM {scored} WHERE split = 'test'")
def m1_scores(t):
    """Raw scores lie between 0 and 1, and are those that the running sums over the trees end in."""
    model, *_, test, _ = fitted(t)
    margin = F.element_at(model.trees.running(vector_to_array("features")), -1)
    rows = model.pipeline.transform(test).select(T.RAW, (1 / (1 + F.exp(-2 * margin))).alias("again"))
    return rows.agg(
        F.count("*").alias("loans"),
        F.count_if(~F.col(T.RAW).between(1e-12, 1 - 1e-12)).alias("outside"),
        F.count_if(~(F.abs(F.col(T.RAW) - F.col("again")) < 1e-12)).alias("differing"),
    )


@query("m2_early_stopping")
def m2(t):
    """Validation loss after each tree, up to where patience ended the fit, and the number kept."""
    model = fitted(t)[0]
    kept = len(model.trees.nodes)
    rows = [(k, loss, k == kept) for k, loss in enumerate(model.losses, 1)]
    return t.spark.createDataFrame(rows, "trees int, loss double, kept boolean")


@query(
    "m2_stopping_invariants",
    """SELECT count(*) AS loans, true AS falls_to_kept, true AS ended_by_patience, 0 AS late_gains
       FROM {scored} WHERE split = 'val'""",
)
def m2_stopping(t):
    model, val, *_ = fitted(t)
    kept, losses = len(model.trees.nodes), model.losses
    late = sum(loss < losses[kept - 1] - CHECKED.min_gain for loss in losses[kept:])
    return val.agg(
        F.count("*").alias("loans"),
        F.lit(losses[kept - 1] == min(losses[:kept])).alias("falls_to_kept"),
        F.lit(len(losses) - kept == CHECKED.patience).alias("ended_by_patience"),
        F.lit(late).alias("late_gains"),
    )


@query("m3_calibration")
def m3(t):
    return T.quality(fitted(t)[1])


@query(
    "m3_isotonic_fit",
    """WITH v AS MATERIALIZED (SELECT pd, sum(y) AS t, count(*) AS n FROM {scored} GROUP BY pd),
       r AS MATERIALIZED (SELECT pd, sum(t) OVER (ORDER BY pd) AS ct, sum(n) OVER (ORDER BY pd) AS cn, t, n FROM v),
       g AS MATERIALIZED (SELECT a.pd AS low, b.pd AS high, (b.ct - a.ct + a.t) * 1.0::DOUBLE / (b.cn - a.cn + a.n) AS mean
             FROM r a JOIN r b ON a.pd <= b.pd),
       least AS (SELECT low, high, min(mean) OVER (PARTITION BY low ORDER BY high DESC) AS worst FROM g),
       f AS (SELECT high AS pd, max(worst) AS fitted FROM least GROUP BY high)
       SELECT v.pd, v.n AS loans, round(fitted, 9) AS fitted FROM v JOIN f USING (pd)""",
)
def m3_isotonic(t):
    """The isotonic fit of outcomes to the stand-in score at each score: for every score the largest,
    over starts up to it, of the least mean of a stretch from there to its end or beyond."""
    rows = t.kept_scores
    blocks = isotonic_blocks(rows, "pd", "y")
    model = T.Calibration(blocks=T.blocks_json(blocks))
    fit = F.round(model.calibrated(F.col("pd")), 9)
    return rows.groupBy("pd").agg(F.count("*").alias("loans")).select("pd", "loans", fit.alias("fitted"))


@query("m4_raw_and_calibrated")
def m4(t):
    return fitted(t)[5].select("id", T.RAW, "pd")


@query(
    "m4_calibration_invariants",
    """SELECT count(*) AS loans, sum(y) AS defaults, CAST(sum(y) AS DOUBLE) AS expected, 0 AS inversions
       FROM {scored} WHERE split = 'val'""",
)
def m4_calibration(t):
    """Calibration never falls and, where it was fitted, keeps the number of defaults."""
    model, val, *_ = fitted(t)
    means = model.calibration.means
    return val.agg(
        F.count("*").alias("loans"),
        F.sum(F.col("y").cast("long")).alias("defaults"),
        F.round(F.sum("pd"), 6).alias("expected"),
        F.lit(sum(b < a for a, b in zip(means, means[1:]))).alias("inversions"),
    )


@query("m5_policy_model")
def m5(t):
    model, val, *_ = fitted(t)
    summary = T.policies(model, val)
    return summary.withColumns({"threshold": F.lit(model.threshold), "lgd": F.lit(model.economics.lgd)})


@query(
    "m5_policy_invariants",
    "SELECT count(*) AS loans, 0 AS cheaper_thresholds FROM {scored} WHERE split = 'val'",
)
def m5_policy(t):
    """No threshold of the grid costs less on the validation loans than the one the policy froze."""
    model, val, *_ = fitted(t)
    curve = E.cost_curve(val, model.economics, tuple(SETTINGS.grid))
    frozen = curve.filter(F.col("threshold") == model.threshold).select(F.col("cost").alias("frozen"))
    cheaper = curve.join(F.broadcast(frozen), F.col("cost") < F.col("frozen")).agg(F.count("*").cast("int").alias("cheaper_thresholds"))
    return val.agg(F.count("*").alias("loans")).join(cheaper)


@query("m6_model_evaluation")
def m6_model(t):
    model, *_, scored = fitted(t)
    return T.policies(model, scored)


LENDER = ("int_rate", "grade", "sub_grade")


def sub_grade():
    """The lender's grade in fifths, which follow from the rate as the grades of the stand-in do."""
    points = F.round(F.col("int_rate") * 100).cast("int") - 600
    return F.concat("grade", (F.floor(F.pmod(points, F.lit(250)) / 50) + 1).cast("string"))


@query("m7_ablation")
def m7(t):
    """Lender rate alone, the model, and the model with the lender's rate, grade and sub-grade added."""
    from duecourse.operators.ordering import union_all

    _, _, loans, aux, _, scored = fitted(t)
    lender = aux.select("id", "int_rate", "grade", sub_grade().alias("sub_grade"))
    wide = stored(loans.join(lender, "id"), "wide")
    issue = F.col("issue_d")
    parts = {s: wide.filter(w.contains(issue)) for s, w in SETTINGS.splits.items()}
    stages = T.input_stages(parts["train"], STANDIN, "standin", LENDER)
    rows = {s: T.training_rows(T.run_stages(stages, p), s) for s, p in parts.items()}
    trees, _ = T.fit_trees(rows["train"], rows["val"], CHECKED)
    results = {
        "lender_rate_only": M.ranking(scored, score="int_rate"),
        "model": M.ranking(scored, score=T.RAW),
        "model_plus_lender": M.ranking(trees.transform(rows["test"]), score=T.RAW),
    }
    return union_all([r.withColumn("inputs", F.lit(n)) for n, r in results.items()])


@query("m8_saved_and_loaded", "SELECT count(*) AS loans, CAST(0 AS DOUBLE) AS difference FROM {scored} WHERE split = 'test'")
def m8(t):
    """Largest difference between the scores of the model and of its reloaded copy."""
    model, *_, test, scored = fitted(t)
    path = f"{shared_folder(t.spark)}/model-{uuid.uuid4().hex}"
    model.save(t.spark, path)
    again = T.PolicyModel.load(t.spark, path).score(test, ("id",)).withColumnRenamed("pd", "again")
    both = scored.select("id", "pd").join(again.select("id", "again"), "id")
    return both.agg(F.count("*").alias("loans"), F.max(F.abs(F.col("pd") - F.col("again"))).alias("difference"))


@query("x5_model_risk_factors")
def x5_model(t):
    model, *_, test, _ = fitted(t)
    rows, push = T.explained(model, test, tuple(test.columns))
    decided = S.decide_applications(rows, model.threshold, model.economics, "fitted", push)
    return decided.select("id", "pd", "decision", "expected_loss", "risk_factors")


@query("x5_contribution_invariants", "SELECT count(*) AS loans, 0.0::DOUBLE AS spread FROM {scored} WHERE split = 'test'")
def x5_sums(t):
    """Contributions and a constant add up to the log-odds of every row."""
    model, *_, test, _ = fitted(t)
    rows, _ = T.explained(model, test, ("id",))
    rest = F.ln(F.col(T.RAW) / (1 - F.col(T.RAW))) - F.aggregate("push", F.lit(0.0), lambda s, x: s + x)
    return rows.agg(F.count("*").alias("loans"), F.round(F.max(rest) - F.min(rest), 6).alias("spread"))


# Pairs of models and windows for scores that SQL can compute: each model date shifts the score a little.
SHIFT = {"2000-08": 0.03, "2001-02": 0.015, "2001-08": 0.0}
PRICE = {"2000-08": (0.6, 0.7), "2001-02": (0.64, 0.75), "2001-08": (0.67, 0.8)}
PAIR_LIST = B.pairs(R.backtest_as_of, R)
add_view(
    "pair_rows",
    " UNION ALL ".join(
        f"""SELECT '{m}' AS model_as_of, '{j}' AS eval_as_of, '{w}' AS evaluated_on, {PRICE[j][0]} AS lgd, {PRICE[j][1]} AS haircut,
              id, y, funded_cents, interest_cents, pd + {SHIFT[m]} AS pd, pd + {SHIFT[m]} >= 0.4 AS reject
            FROM scored WHERE {sql_between('issue_d', w)}"""
        for m, j, w in PAIR_LIST
    ),
    ["scored"],
)


def backtest_rows(t, loans, aux):
    """Rows of all (model, window) pairs with every model's score, from one scan of the loans."""
    money = T.priced(loans, aux)

    def fit(date):
        splits = windows_for(date, R)[1]
        return T.fit_policy_model(loans, money, splits, SETTINGS.population, CHECKED, STANDIN, "standin")[0]

    # Fits of different dates do not need each other; most of their time is spent starting small jobs.
    with ThreadPoolExecutor(len(R.backtest_as_of)) as pool:
        models = dict(zip(R.backtest_as_of, pool.map(fit, R.backtest_as_of)))
    rows = T.FeatureStage(registry="standin").transform(loans)
    pairs = B.pairs(R.backtest_as_of, R)
    scores = {d: m.calibrated_score() for d, m in models.items()}
    cuts = {d: m.threshold for d, m in models.items()}
    scored = B.scored_by_all(rows, pairs, scores, cuts).join(money.select("id", E.FUNDED, E.INTEREST), "id")
    return stored(scored, "pairs"), {d: m.economics for d, m in models.items()}


_BACKTEST: dict[tuple[str, str], tuple] = {}


def backtest(t):
    key = t.spark.sparkContext.applicationId, t.sf_dir
    if key not in _BACKTEST:
        _BACKTEST.clear()
        _BACKTEST[key] = backtest_rows(t, *tables(t))
    return _BACKTEST[key]


@query("b1_models_by_date")
def b1(t):
    return B.matrix(*backtest(t))


@query(
    "b1_pair_rows",
    """SELECT model_as_of, eval_as_of, evaluated_on, count(*) AS loans, sum(y) AS defaults, sum(funded_cents) AS funded_cents, 0 AS outside
       FROM {pair_rows} GROUP BY ALL""",
)
def b1_pairs(t):
    """What the one scan gave each pair: its loans and amounts, each with a score."""
    rows, _ = backtest(t)
    return rows.groupBy("model_as_of", "eval_as_of", "evaluated_on").agg(
        F.count("*").alias("loans"), F.sum(F.col("y").cast("long")).alias("defaults"),
        F.sum(E.FUNDED).alias("funded_cents"), F.count_if(~F.col("pd").between(0, 1)).alias("outside"),
    )


@query(
    "b2_model_by_window",
    """SELECT a.model_as_of, a.eval_as_of, a.evaluated_on, round(roc_auc, 4) AS roc_auc, round(ece, 4) AS ece, savings_pct, reject_rate FROM
      (SELECT model_as_of, eval_as_of, evaluated_on,
         round(100 * (1 - (max(lgd) * sum(CASE WHEN NOT reject AND y = 1 THEN funded_cents ELSE 0 END)
             + max(haircut) * sum(CASE WHEN reject AND y = 0 THEN interest_cents ELSE 0 END))
             / (max(lgd) * sum(CASE WHEN y = 1 THEN funded_cents ELSE 0 END))), 2) AS savings_pct,
         round(avg(CASE WHEN reject THEN 1.0 ELSE 0.0 END), 4) AS reject_rate FROM {pair_rows} GROUP BY 1, 2, 3) a
      JOIN (SELECT model_as_of, eval_as_of, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS roc_auc FROM (
              SELECT *, sum(neg) OVER (PARTITION BY model_as_of, eval_as_of ORDER BY pd) - neg AS below FROM (
                SELECT model_as_of, eval_as_of, pd, sum(y) AS pos, sum(1 - y) AS neg FROM {pair_rows} GROUP BY 1, 2, 3) v) w GROUP BY 1, 2) b
        ON a.model_as_of = b.model_as_of AND a.eval_as_of = b.eval_as_of
      JOIN (SELECT model_as_of, eval_as_of, sum(abs(mp - mo) * n) / sum(n) AS ece FROM (
              SELECT model_as_of, eval_as_of, bin, avg(pd) AS mp, avg(y) AS mo, count(*) AS n FROM (
                SELECT *, greatest(0, ((r - 1) * 10 + cnt - 2) // (cnt - 1) - 1) AS bin FROM (
                  SELECT *, row_number() OVER (PARTITION BY model_as_of, eval_as_of ORDER BY pd, id) AS r,
                         count(*) OVER (PARTITION BY model_as_of, eval_as_of) AS cnt FROM {pair_rows}) x) y GROUP BY 1, 2, 3) z GROUP BY 1, 2) c
        ON a.model_as_of = c.model_as_of AND a.eval_as_of = c.eval_as_of""",
)
def b2(t):
    def score(date, window):
        rows = t.kept_scores.filter(window.contains(F.col("issue_d")))
        moved = rows.withColumn("pd", F.col("pd") + SHIFT[date])
        return moved.withColumn("reject", F.col("pd") >= 0.4)

    prices = {d: E.Economics(*PRICE[d]) for d in R.backtest_as_of}
    return B.matrix(B.scored_pairs(PAIR_LIST, score), prices)
