"""Fitting, calibrating and explaining the boosted-tree model with Spark ML."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duecourse.config import Population, TreeSettings, threshold_grid
from duecourse.operators import economics as E
from duecourse.operators import metrics as M
from duecourse.operators.features import FeatureStage, Vocabulary, VocabularyModel, category_code
from duecourse.operators.isotonic import isotonic_blocks
from duecourse.operators.joins import join_one_to_one
from duecourse.plans.trees import RAW, Calibration, TreeEnsemble, nodes_of
from duecourse.registry import EVENT_DATE, KEY, LABEL, SCORE, Registry
from duecourse.session import stored

#: Trees of the first fit; if patience has not ended by then, the next one has twice as many.
FIRST_FIT = 48


class MissingFill(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Numbers for the trees, which take no NULL: each column as ``<c>_filled``, missing values
    put below its smallest training value, and ``<c>_missing`` telling them apart."""

    fills = Param(Params._dummy(), "fills", "JSON of fill values", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, fills: str = "{}") -> None:
        super().__init__()
        self._setDefault(fills="{}")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        made: dict[str, Column] = {}
        for name, fill in json.loads(self.getOrDefault(self.fills)).items():
            made[f"{name}_filled"] = F.coalesce(F.col(name), F.lit(fill))
            made[f"{name}_missing"] = F.col(name).isNull().cast("double")
        return dataset.withColumns(made)


def learn_fills(df: DataFrame, columns: list[str]) -> dict[str, float]:
    least = df.agg(*(F.min(c).alias(c) for c in columns)).first().asDict()
    return {c: (0.0 if least[c] is None else float(least[c])) - 1.0 for c in columns}


def input_stages(train: DataFrame, registry: Registry, name: str, extra: tuple[str, ...] = ()):
    """Fitted stages from typed loans to the ``features`` vector; ``extra`` columns are appended
    (numbers as they are, text through a vocabulary)."""
    text = {f.name for f in train.schema if f.dataType.simpleString() == "string"}
    categorical = [*registry.categorical, *(c for c in extra if c in text)]
    stage = FeatureStage(registry=name)
    vocabulary = Vocabulary(columns=categorical).fit(train)
    codes = [f"{c}_code" for c in categorical]
    numeric = [*registry.model_numeric, *(c for c in extra if c not in text), *codes]
    coded = vocabulary.transform(stage.transform(train))
    fill = MissingFill(fills=json.dumps(learn_fills(coded, numeric)))
    inputs = [f"{c}_{kind}" for c in numeric for kind in ("filled", "missing")]
    return [stage, vocabulary, fill, VectorAssembler(inputCols=inputs, outputCol="features")]


def run_stages(stages: list, df: DataFrame) -> DataFrame:
    for stage in stages:
        df = stage.transform(df)
    return df


def training_rows(df: DataFrame, name: str) -> DataFrame:
    """Vectors in a fixed layout: the fitted trees depend on how rows are partitioned."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = df.select(KEY, F.col(LABEL).cast("double").alias(LABEL), "features")
    return stored(rows.repartition(width, KEY).sortWithinPartitions(KEY), name)


def best_iteration(losses: list[float], patience: int, min_gain: float = 0.0) -> int:
    """Number of trees with the lowest loss before ``patience`` rounds pass without a loss that is
    lower by more than ``min_gain``."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best] - min_gain:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def fit_trees(train: DataFrame, val: DataFrame, s: TreeSettings) -> tuple[TreeEnsemble, list[float]]:
    """The ensemble of least validation loss, and the loss after each tree up to where it was given up.

    One fit gives the ensembles of all shorter lengths; their losses come from one pass of Spark's own
    model over the validation rows (it counts log loss twice), and the best one is the fit's first trees. Only if the loss has not stopped
    falling at the end of a fit is a longer one made.
    """
    size = min(s.max_trees, max(FIRST_FIT, 2 * s.patience))
    while True:
        trees = GBTClassifier(
            labelCol=LABEL, maxIter=size, stepSize=s.step_size, maxDepth=s.max_depth,
            minInstancesPerNode=s.min_per_leaf, subsamplingRate=s.row_share,
            featureSubsetStrategy=s.column_share, seed=s.seed, checkpointInterval=20,
        )
        boosted = trees.fit(train)
        whole = TreeEnsemble.of(nodes_of(boosted, train.sparkSession))
        losses = [loss / 2 for loss in boosted.evaluateEachIteration(val)]
        best = best_iteration(losses, s.patience, s.min_gain)
        if best + s.patience <= size or size == s.max_trees:
            return whole.cut(best), losses[: best + s.patience]
        size = min(s.max_trees, 2 * size)


def fit_calibration(scored: DataFrame) -> Calibration:
    """Monotone map from raw to calibrated score. Only the pooled blocks, which are the model's
    parameters, come to the driver."""
    return Calibration(blocks=blocks_json(isotonic_blocks(scored, RAW, LABEL)))


def blocks_json(blocks: DataFrame) -> str:
    rows = blocks.orderBy("low").collect()
    return json.dumps([(b["low"], b["high"], b["total"] / b["n"]) for b in rows])


@dataclass
class PolicyModel:
    """A fitted pipeline with the decision policy that goes with it."""

    pipeline: PipelineModel
    economics: E.Economics
    threshold: float
    features: list[str]
    losses: list[float] = field(default_factory=list)

    @property
    def trees(self) -> TreeEnsemble:
        return self._stage(TreeEnsemble)

    def _stage(self, kind: type):
        return next(s for s in self.pipeline.stages if isinstance(s, kind))

    @property
    def calibration(self) -> Calibration:
        return self._stage(Calibration)

    def inputs(self) -> list[str]:
        """Names of the trees' inputs, in their order."""
        return self._stage(VectorAssembler).getInputCols()

    def calibrated_score(self) -> Column:
        """The score as an expression over engineered inputs, so that one scan can score many models."""
        codes = {f"{c}_code": category_code(c, v) for c, v in self._stage(VocabularyModel).categories.items()}
        made = {}
        for name, fill in json.loads(self._stage(MissingFill).getOrDefault("fills")).items():
            value = codes.get(name, F.col(name)).cast("double")
            made |= {f"{name}_filled": F.coalesce(value, F.lit(fill)), f"{name}_missing": value.isNull().cast("double")}
        raw = self.trees.probability(F.array(*(made[name] for name in self.inputs())))
        return clipped(self.calibration.calibrated(raw))

    def policy(self) -> dict:
        return {
            "threshold": self.threshold,
            "cost_model": self.economics.to_dict(),
            "features": self.features,
            "best_iteration": len(self.trees.nodes),
        }

    def score(self, df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        """``keep..., raw_pd, pd``."""
        scored = self.pipeline.transform(df)
        return scored.select(*keep, RAW, clipped(F.col(SCORE)).alias(SCORE))

    def save(self, spark: SparkSession, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/model")
        policy = spark.range(1).select(F.lit(json.dumps(self.policy())).alias("value"))
        policy.coalesce(1).write.mode("overwrite").text(f"{path}/policy")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PolicyModel:
        policy = json.loads(spark.read.text(f"{path}/policy").first()["value"])
        return cls(
            PipelineModel.load(f"{path}/model"),
            E.Economics(**policy["cost_model"]),
            policy["threshold"],
            policy["features"],
        )


def priced(loans: DataFrame, aux: DataFrame) -> DataFrame:
    """Outcome, issue date, auxiliary columns and amounts at stake of each loan, as a written table."""
    both = join_one_to_one(loans.select(KEY, EVENT_DATE, LABEL), aux, KEY, "funded_amnt")
    return stored(E.with_exposure(both), "money")


def clipped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def fit_policy_model(
    loans: DataFrame, money: DataFrame, splits: dict, population: Population, trees: TreeSettings,
    registry: Registry, name: str,
) -> tuple[PolicyModel, DataFrame]:
    """Cost model and inputs from train, calibration and threshold from val. ``money`` is what
    :func:`priced` gives, which models of several dates share. Returns the model and the scored
    validation loans."""
    issue = F.col(EVENT_DATE)
    train, val = (loans.filter(splits[s].contains(issue)) for s in ("train", "val"))
    economics = E.estimate(money.filter(splits["train"].contains(issue)), population.term_months)

    stages = input_stages(train, registry, name)
    train_rows = training_rows(run_stages(stages, train), "train")
    val_rows = training_rows(run_stages(stages, val), "val")
    fitted, losses = fit_trees(train_rows, val_rows, trees)
    # Stored, as the calibration and the scored rows both read it: the trees go over the rows once.
    outcomes = money.filter(splits["val"].contains(issue)).select(KEY, LABEL, E.FUNDED, E.INTEREST)
    raw_scored = stored(fitted.transform(val_rows).select(KEY, RAW).join(outcomes, KEY), "val-raw")
    calibration = fit_calibration(raw_scored)
    pipeline = PipelineModel([*stages, fitted, calibration])
    model = PolicyModel(pipeline, economics, 0.0, list(registry.model_features), losses)

    scored = calibration.transform(raw_scored).withColumn(SCORE, clipped(F.col(SCORE)))
    val_scored = stored(scored.select(KEY, LABEL, RAW, SCORE, E.FUNDED, E.INTEREST), "val-scored")
    curve = E.cost_curve(val_scored, economics, tuple(threshold_grid()))
    model.threshold = E.best_threshold(curve).first()["threshold"]
    return model, val_scored


def quality(scored: DataFrame) -> DataFrame:
    """Metric bundle of the raw and of the calibrated score: one row each."""
    both = scored.select(
        KEY, LABEL,
        F.inline(
            F.array(
                F.struct(F.lit("raw").alias("score"), F.col(RAW).alias(SCORE)),
                F.struct(F.lit("calibrated").alias("score"), F.col(SCORE).alias(SCORE)),
            )
        ),
    )
    return M.probability_metrics(both, key="score")


def policies(model: PolicyModel, scored: DataFrame) -> DataFrame:
    """The frozen threshold, the per-loan rule, and the best threshold in hindsight."""
    curve = E.cost_curve(scored, model.economics, tuple(threshold_grid()))
    hindsight = E.best_threshold(curve).first()["threshold"]
    rules = {
        "policy_threshold": F.col(SCORE) >= model.threshold,
        "expected_value": E.expected_value_reject(model.economics),
        "hindsight_threshold": F.col(SCORE) >= hindsight,
    }
    return E.policy_summary(scored, model.economics, rules)


# --- why a score is what it is ---------------------------------------------------------------
def explained(model: PolicyModel, df: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, dict]:
    """Scored rows with the contribution of each model input, and those columns by input.

    The contributions and a constant add up to the log-odds of the raw score.
    """
    bases = [name.rsplit("_", 1)[0].removesuffix("_code") for name in model.inputs()]
    groups = list(dict.fromkeys(bases))
    push = model.trees.contributions(vector_to_array("features"), [groups.index(b) for b in bases], len(groups))
    scored = model.pipeline.transform(df).withColumn("push", push)
    columns = {b: F.get("push", F.lit(i)) for i, b in enumerate(groups)}
    return scored.select(*keep, RAW, SCORE, "push"), columns
