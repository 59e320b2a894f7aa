"""Model inputs: derived features, category codes, and both as pipeline stages."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecourse.operators import vocabulary
from duecourse.registry import EVENT_DATE, LOANS, STANDIN, Registry
from duecourse.session import path_of, stored

REGISTRIES = {"loans": LOANS, "standin": STANDIN}


def months_between_starts(later: str, earlier: str) -> Column:
    years = F.year(later) - F.year(earlier)
    return (years * 12 + F.month(later) - F.month(earlier)).cast("double")


def derived() -> dict[str, Column]:
    return {
        "fico_mid": (F.col("fico_range_low") + F.col("fico_range_high")) / 2,
        "credit_history_months": months_between_starts(EVENT_DATE, "earliest_cr_line"),
        "loan_to_income": F.try_divide(F.col("loan_amnt"), F.col("annual_inc")),
        "revol_bal_to_income": F.try_divide(F.col("revol_bal"), F.col("annual_inc")),
    }


def engineer(df: DataFrame, registry: Registry, keep: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the model inputs, in model order, after the columns named in ``keep``."""
    missing = [c for c in (EVENT_DATE, *registry.features) if c not in df.columns]
    if missing:
        raise KeyError(f"columns needed for the model inputs are missing: {missing}")
    made = derived()
    return df.select(*keep, *(made.get(c, F.col(c)).alias(c) for c in registry.model_features))


#: Columns of at most this many categories are coded by a list in the plan, others by a table.
LISTED = 1_000


def category_code(column: str, categories: list[str]) -> Column:
    """Position in the sorted category list, from 0; unseen and missing values are NULL."""
    place = F.array_position(F.array(*map(F.lit, categories)), F.col(column))
    return F.when(place > 0, place - 1).cast("double")


class FeatureStage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``engineer`` as a pipeline stage; other columns pass through."""

    registry = Param(Params._dummy(), "registry", "name of the registry", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, registry: str = "loans") -> None:
        super().__init__()
        self._setDefault(registry="loans")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        registry = REGISTRIES[self.getOrDefault(self.registry)]
        others = [c for c in dataset.columns if c not in registry.model_features]
        return engineer(dataset, registry, tuple(others))


class VocabularyModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Replaces each categorical column by ``<column>_code``."""

    vocabulary = Param(Params._dummy(), "vocabulary", "JSON of categories", TypeConverters.toString)
    folder = Param(Params._dummy(), "folder", "table of the codes of columns with many values", TypeConverters.toString)
    tabled = Param(Params._dummy(), "tabled", "columns coded by that table", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, vocabulary: str = "{}", folder: str = "", tabled: list[str] | None = None) -> None:
        super().__init__()
        self._setDefault(vocabulary="{}", folder="", tabled=[])
        self._set(**self._input_kwargs)

    @property
    def categories(self) -> dict[str, list[str]]:
        """Of the columns that have a list."""
        return json.loads(self.getOrDefault(self.vocabulary))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        listed = dataset.withColumns({f"{c}_code": category_code(c, v) for c, v in self.categories.items()})
        tabled = self.getOrDefault(self.tabled)
        if not tabled:
            return listed
        codes = dataset.sparkSession.read.parquet(self.getOrDefault(self.folder))
        return vocabulary.coded(listed, codes, tabled)


class Vocabulary(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the codes. Columns of up to ``LISTED`` categories, which are counted first, become
    lists in the model; the codes of others stay a table, in ``folder`` or the shared folder."""

    columns = Param(Params._dummy(), "columns", "categorical columns", TypeConverters.toListString)
    folder = Param(Params._dummy(), "folder", "where the table of codes is kept", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, folder: str = "") -> None:
        super().__init__()
        self._setDefault(columns=[], folder="")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> VocabularyModel:
        columns = self.getOrDefault(self.columns)
        found = stored(vocabulary.learned(dataset, columns), "codes")
        sizes = {r["column"]: r["n"] for r in found.groupBy("column").agg(F.count("*").alias("n")).collect()}
        tabled = [c for c in columns if sizes.get(c, 0) > LISTED]
        lists: dict[str, list[str]] = {c: [] for c in columns if c not in tabled}
        for r in found.filter(F.col("column").isin(*lists)).orderBy("column", "code").collect():
            lists[r["column"]].append(r["value"])
        folder = self.getOrDefault(self.folder)
        if tabled and folder:
            found.write.mode("overwrite").parquet(folder)
        return VocabularyModel(vocabulary=json.dumps(lists), folder=folder or path_of(found), tabled=tabled)
