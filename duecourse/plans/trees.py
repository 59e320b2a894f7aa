"""Boosted trees as data: one fit, cut at any tree, scored and explained by column expressions.

A fitted ensemble is a list of trees, each as three arrays over the places of a full binary tree (the
children of place i are 2i + 1 and 2i + 2): input tested, cut, value. Below a leaf its value goes on, so
every row takes the same number of steps. From these arrays come the score, the running score after
each tree (whence the loss of every shorter ensemble in one pass) and the contribution of each input.
Nothing leaves the JVM; the arrays are a model's parameters, whatever the number of rows.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duecourse.registry import LABEL, SCORE
from duecourse.session import shared_folder

RAW = "raw_pd"
_TREES = "array<struct<w: double, f: array<int>, c: array<double>, v: array<double>>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@lru_cache(maxsize=8)
def _parsed(trees: str) -> list[dict]:
    return json.loads(trees)


def nodes_of(model: GBTClassificationModel, spark: SparkSession) -> list[dict]:
    """Trees of a fitted model as arrays; a few dozen nodes a tree."""
    path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
        F.col("nodeData.split.featureIndex").alias("input"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("cut"),
    ).collect()
    by_tree: dict[int, dict[int, tuple]] = {}
    for tree, node, *rest in rows:
        by_tree.setdefault(tree, {})[node] = tuple(rest)

    def depth(nodes: dict, node: int) -> int:
        _, left, right, _, _ = nodes[node]
        return 0 if left < 0 else 1 + max(depth(nodes, left), depth(nodes, right))

    levels = max(depth(nodes, 0) for nodes in by_tree.values())
    size = (1 << (levels + 1)) - 1
    trees = []
    for tree in sorted(by_tree):
        tests, cuts, values = [0] * size, [sys.float_info.max] * size, [0.0] * size
        places = [(0, 0)]
        while places:
            place, node = places.pop()
            value, left, right, tested, cut = by_tree[tree][node]
            values[place] = value
            below = 2 * place + 1
            if left >= 0:
                tests[place], cuts[place] = tested, cut
                places += [(below, left), (below + 1, right)]
            elif below < size:
                places += [(below, node), (below + 1, node)]
        trees.append({"w": model.treeWeights[tree], "f": tests, "c": cuts, "v": values})
    return trees


class TreeEnsemble(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``raw_pd`` for the vectors in ``features``."""

    trees = Param(Params._dummy(), "trees", "JSON of the trees", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, trees: str = "[]") -> None:
        super().__init__()
        self._setDefault(trees="[]")
        self._set(**self._input_kwargs)

    @classmethod
    def of(cls, trees: list[dict]) -> TreeEnsemble:
        return cls(trees=json.dumps(trees))

    @property
    def nodes(self) -> list[dict]:
        return _parsed(self.getOrDefault(self.trees))

    def cut(self, size: int) -> TreeEnsemble:
        """The ensemble of the first trees alone, which is what a fit of that length gives."""
        return TreeEnsemble.of(self.nodes[:size])

    @property
    def levels(self) -> int:
        return (len(self.nodes[0]["f"]) + 1).bit_length() - 2

    def _literal(self) -> Column:
        return F.from_json(F.lit(self.getOrDefault(self.trees)), _TREES)

    def _step(self, x: Column, tree: Column, place: Column) -> Column:
        right = F.get(x, F.get(tree["f"], place)) > F.get(tree["c"], place)
        return 2 * place + F.when(right, 2).otherwise(1)

    def _leaf(self, x: Column, tree: Column) -> Column:
        steps = F.array(*map(F.lit, range(self.levels)))
        return F.aggregate(steps, F.lit(0), lambda place, _: self._step(x, tree, place))

    def margin(self, x: Column) -> Column:
        """Half the log-odds for an array of inputs."""
        return bound(x, lambda row: F.aggregate(
            self._literal(), F.lit(0.0), lambda s, t: s + t["w"] * F.get(t["v"], self._leaf(row, t))
        ))

    def probability(self, x: Column) -> Column:
        return 1 / (1 + F.exp(-2 * self.margin(x)))

    def running(self, x: Column) -> Column:
        """Margins after each tree."""
        def sums(values: Column) -> Column:
            return F.aggregate(values, F.array(F.lit(0.0)), lambda s, v: F.concat(s, F.array(F.element_at(s, -1) + v)))

        def of(row: Column) -> Column:
            own = F.transform(self._literal(), lambda t: t["w"] * F.get(t["v"], self._leaf(row, t)))
            return F.slice(sums(own), 2, len(self.nodes))

        return bound(x, of)

    def contributions(self, x: Column, group_of: list[int], groups: int) -> Column:
        """Change of the log-odds along the paths of all trees, per group of inputs.

        A path is known by its leaf, so each tree is a table of (last level, group), made once here.
        """
        first, tables = (1 << self.levels) - 1, []
        for tree in self.nodes:
            table = [0.0] * (groups << self.levels)
            for leaf in range(1 << self.levels):
                place = first + leaf
                while place:
                    above = (place - 1) // 2
                    change = 2 * tree["w"] * (tree["v"][place] - tree["v"][above])
                    table[leaf * groups + group_of[tree["f"][above]]] += change
                    place = above
            tables.append(table)
        shares = F.from_json(F.lit(json.dumps(tables)), "array<array<double>>")

        def of(row: Column) -> Column:
            leaves = F.transform(self._literal(), lambda t: (self._leaf(row, t) - first) * groups)
            return bound(F.arrays_zip(shares.alias("d"), leaves.alias("at")), lambda paths: F.transform(
                F.array(*map(F.lit, range(groups))),
                lambda g: F.aggregate(paths, F.lit(0.0), lambda s, p: s + F.get(p["d"], p["at"] + g)),
            ))

        return bound(x, of)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(RAW, self.probability(vector_to_array("features")))


def prefix_losses(ensemble: TreeEnsemble, rows: DataFrame) -> list[float]:
    """Mean log loss of the first 1, 2, 3 ... trees on labelled vectors: one pass, summed per task."""
    sign = 2 * F.col(LABEL) - 1
    margins = rows.select(sign.alias("sign"), F.posexplode(ensemble.running(vector_to_array("features"))))
    # Rows of one tree are summed where they are made; what is shuffled is a sum per task and tree.
    losses = margins.groupBy("pos").agg(F.avg(F.log1p(F.exp(-2 * F.col("sign") * F.col("col")))).alias("loss"))
    return [r["loss"] for r in losses.orderBy("pos").collect()]


class Calibration(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the calibrated score: the mean of the pooled block a raw score lies in, on the straight
    line between two blocks, the nearest block's outside."""

    blocks = Param(Params._dummy(), "blocks", "JSON of (low, high, mean)", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, blocks: str = "[]") -> None:
        super().__init__()
        self._setDefault(blocks="[]")
        self._set(**self._input_kwargs)

    @property
    def means(self) -> list[float]:
        return [mean for _, _, mean in json.loads(self.getOrDefault(self.blocks))]

    def calibrated(self, raw: Column) -> Column:
        points: list[tuple[float, float]] = []
        for low, high, mean in json.loads(self.getOrDefault(self.blocks)):
            points += [(low, mean)] if low == high else [(low, mean), (high, mean)]
        if not points:
            return F.lit(None).cast("double")
        at, means = (F.from_json(F.lit(json.dumps(v)), "array<double>") for v in zip(*points))
        halves = [1 << i for i in reversed(range(len(points).bit_length()))]

        def passed(p: Column) -> Column:
            def advance(found: Column, half: Column) -> Column:
                return F.when(F.get(at, found + half - 1) <= p, found + half).otherwise(found)

            return F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), advance)

        def between(p: Column, i: Column) -> Column:
            left, right = F.get(at, i - 1), F.get(at, i)
            low, high = F.get(means, i - 1), F.get(means, i)
            line = low + (high - low) * ((p - left) / (right - left))
            return F.when(i == 0, F.get(means, F.lit(0))).when(i == len(points), low).otherwise(line)

        return bound(raw, lambda p: bound(passed(p), lambda i: between(p, i)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(SCORE, self.calibrated(F.col(RAW)))
