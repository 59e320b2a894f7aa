"""Data contracts: what a typed table must look like, and how often it does not."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duecourse.registry import EVENT_DATE, KEY, LABEL, Registry

DEFAULT_RATE = (0.05, 0.35)


@dataclass(frozen=True)
class Contract:
    """Exact columns, conditions that make a row bad, a unique key, limits on the mean label."""

    schema: T.StructType
    bad_if: dict[tuple[str, str], Column]
    key: str = KEY
    label_mean: tuple[float, float] | None = None


def numeric_problem(name: str, registry: Registry, value: Column | None = None) -> Column:
    value = F.col(name) if value is None else value
    if name in registry.positive:
        return value <= 0
    if name in registry.bounds:
        low, high = registry.bounds[name]
        return ~value.between(low, high)
    return value < 0


def loan_contract(registry: Registry, outcome_known: bool = True) -> Contract:
    """Typed loans; with ``outcome_known=False`` the label may be missing and has no mean."""
    fields = [
        T.StructField(KEY, T.LongType()),
        T.StructField(EVENT_DATE, T.DateType()),
        T.StructField(LABEL, T.ByteType()),
        *(T.StructField(c, T.DoubleType()) for c in registry.numeric),
        *(T.StructField(c, T.StringType()) for c in registry.categorical),
        *(T.StructField(c, T.DateType()) for c in registry.dates),
    ]
    needed = [KEY, EVENT_DATE, *registry.required, *registry.categorical, *registry.dates]
    if outcome_known:
        needed.append(LABEL)
    checks = {("not_null", c): F.col(c).isNull() for c in needed}
    checks |= {("in_range", c): numeric_problem(c, registry) for c in registry.numeric}
    checks |= {("allowed", c): ~F.col(c).isin(registry.allowed[c]) for c in registry.categorical}
    checks[("not_negative", KEY)] = F.col(KEY) < 0
    checks[("label_known", LABEL)] = ~F.col(LABEL).isin(0, 1)
    checks[("fico_range_ordered", "fico_range_high")] = (
        F.col("fico_range_high") < F.col("fico_range_low")
    )
    for name in registry.dates:
        checks[("credit_line_before_issue", name)] = F.col(name) > F.col(EVENT_DATE)
    return Contract(T.StructType(fields), checks, KEY, DEFAULT_RATE if outcome_known else None)


def aux_contract(registry: Registry) -> Contract:
    fields = [
        T.StructField(KEY, T.LongType()),
        *(T.StructField(c, T.DoubleType()) for c in registry.aux_numeric),
        *(T.StructField(c, T.StringType()) for c in registry.aux_categorical),
    ]
    checks = {("not_null", KEY): F.col(KEY).isNull(), ("not_negative", KEY): F.col(KEY) < 0}
    checks |= {("in_range", c): F.col(c) < 0 for c in registry.aux_numeric}
    return Contract(T.StructType(fields), checks)


def schema_problems(df: DataFrame, contract: Contract) -> list[str]:
    """Compares names, order and types; runs no job."""
    found = [(f.name, f.dataType.simpleString()) for f in df.schema]
    wanted = [(f.name, f.dataType.simpleString()) for f in contract.schema]
    if found == wanted:
        return []
    problems = [f"unexpected column {n} ({t})" for n, t in found if (n, t) not in wanted]
    problems += [f"missing column {n} ({t})" for n, t in wanted if (n, t) not in found]
    return problems or ["columns are in another order"]


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """``(check, column, n_bad)``, only where something is wrong.

    All row checks are one aggregation without shuffle keys; the unique key takes one shuffle,
    before which repeats are already counted per task.
    """
    measures = [F.count_if(bad).alias(_name(pair)) for pair, bad in contract.bad_if.items()]
    if contract.label_mean:
        low, high = contract.label_mean
        off = ~F.avg(LABEL).between(low, high)
        measures.append(off.cast("bigint").alias(_name(("default_rate_plausible", LABEL))))
    counts = _long(df.agg(*measures))
    repeated = df.groupBy(contract.key).agg(F.count("*").alias("n")).filter("n > 1")
    unique = _long(repeated.agg(F.count("*").alias(_name(("unique", contract.key)))))
    return counts.unionByName(unique).filter("n_bad > 0")


def _name(pair: tuple[str, str]) -> str:
    return "|".join(pair)


def _long(one_row: DataFrame) -> DataFrame:
    parts = F.split("name", "[|]")
    return one_row.unpivot([], one_row.columns, "name", "n_bad").select(
        parts[0].alias("check"), parts[1].alias("column"), "n_bad"
    )


def enforce(df: DataFrame, contract: Contract) -> DataFrame:
    """The frame itself, or ValueError naming every broken rule."""
    problems = schema_problems(df, contract)
    if not problems:
        rows = violations(df, contract).collect()  # at most one row per rule
        problems = [f"{r['check']}({r['column']}): {r['n_bad']}" for r in rows]
    if problems:
        raise ValueError("contract broken: " + "; ".join(sorted(problems)))
    return df
