"""Raw text rows -> typed, labelled loans plus a separate auxiliary table."""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duecourse.config import Population
from duecourse.functions import parsing as P
from duecourse.registry import (
    APPLICATION_TYPE,
    BAD_STATUSES,
    EVENT_DATE,
    GOOD_STATUSES,
    KEY,
    LABEL,
    STATUS,
    TERM,
    Registry,
)
from duecourse.session import stored

MAX_EXAMPLES = 5
# Columns between the steps of the check.
ISSUE, INSIDE = "_issue_month", "_in_population"


class Cleaned(NamedTuple):
    loans: DataFrame
    aux: DataFrame


def loan_rows(raw: DataFrame) -> DataFrame:
    """Drop rows that are not loans (section headers, blank ids)."""
    return raw.filter(P.all_digits(F.col(KEY)))


def in_population(issue: Column, population: Population, require_outcome: bool = True) -> Column:
    wanted = (
        (P.strip(F.col(TERM)) == f"{population.term_months} months")
        & (F.col(APPLICATION_TYPE) == population.application_type)
        & population.window.contains(issue)
    )
    if require_outcome:
        wanted = wanted & F.col(STATUS).isin(*GOOD_STATUSES, *BAD_STATUSES)
    return wanted


def population_rows(
    raw: DataFrame, population: Population, require_outcome: bool = True
) -> DataFrame:
    issue = P.month_start(F.col(EVENT_DATE))
    return loan_rows(raw).filter(in_population(issue, population, require_outcome))


def label() -> Column:
    """1 = went bad, 0 = repaid, NULL = still in flight."""
    return (
        F.when(F.col(STATUS).isin(*BAD_STATUSES), 1)
        .when(F.col(STATUS).isin(*GOOD_STATUSES), 0)
        .cast("tinyint")
    )


def parser(name: str, registry: Registry) -> Column | None:
    """The parse of one raw column, or None where any text is allowed."""
    text = F.col(name)
    if name in registry.years_text:
        return P.employment_years(text)
    if name in registry.numeric + registry.aux_numeric:
        return P.number(text, percent=name in registry.percent)
    if name in registry.dates:
        return P.month_start(text)
    return None


def typed(name: str, registry: Registry) -> Column:
    column = parser(name, registry)
    if column is None:
        column = P.strip(F.col(name))
    if name == "dti":  # a negative ratio is impossible, so it counts as missing
        column = F.when(column >= 0, column)
    return column.alias(name)


def clean(
    raw: DataFrame, population: Population, registry: Registry, require_outcome: bool = True
) -> Cleaned:
    """Both outputs are narrow projections of the same filtered rows and need no shuffle."""
    rows = population_rows(raw, population, require_outcome)
    key = F.col(KEY).cast("bigint").alias(KEY)
    loans = rows.select(
        key,
        P.month_start(F.col(EVENT_DATE)).alias(EVENT_DATE),
        label().alias(LABEL),
        *(typed(name, registry) for name in registry.features),
    )
    aux = rows.select(key, *(typed(name, registry) for name in registry.aux))
    return Cleaned(loans, aux)


def clean_once(
    raw: DataFrame, populations: list[tuple[Population, bool]], registry: Registry, with_aux: bool = True
) -> list[Cleaned]:
    """:func:`clean` for each ``(population, require_outcome)``, from one pass over the raw rows.

    The typed rows that any of them wants are stored, with marks where they are several; what is returned
    are narrow scans of that table. Without ``with_aux`` the auxiliary columns are left out, and ``aux`` holds keys.
    """
    aux = registry.aux if with_aux else ()
    issue = P.month_start(F.col(EVENT_DATE))
    inside = [in_population(issue, *wanted) for wanted in populations]
    marks = {f"_in_{i}": F.coalesce(own, F.lit(False)) for i, own in enumerate(inside)} if len(inside) > 1 else {}
    kept = stored(
        loan_rows(raw).filter(reduce(or_, inside)).select(
            F.col(KEY).cast("bigint").alias(KEY), issue.alias(EVENT_DATE), label().alias(LABEL),
            *(typed(name, registry) for name in registry.features + aux), *(c.alias(m) for m, c in marks.items()),
        ),
        "clean",
    )
    parts = [kept.filter(mark) for mark in marks] or [kept]
    return [Cleaned(p.select(KEY, EVENT_DATE, LABEL, *registry.features), p.select(KEY, *aux)) for p in parts]


def unparsed(
    raw: DataFrame, population: Population, registry: Registry, require_outcome: bool = True
) -> DataFrame:
    """``(column, n_bad, examples)`` for text that did not parse; no rows when all is well.

    The issue month is checked on every loan row, other columns only inside the population. Bad
    values are counted per distinct text before they are ranked, so a text that fills a third of
    the table reaches the ranking as one row per task.
    """
    # Two projections: the month and the population, which every check refers to, are made once a row.
    rows = loan_rows(raw).withColumn(ISSUE, P.month_start(F.col(EVENT_DATE)))
    issue, inside = F.col(ISSUE), F.col(INSIDE)
    rows = rows.withColumn(INSIDE, F.coalesce(in_population(issue, population, require_outcome), F.lit(False)))
    checks = [_bad_value(EVENT_DATE, issue, F.lit(True))]
    for name in registry.features + registry.aux:
        parsed = parser(name, registry)
        if parsed is not None:
            checks.append(_bad_value(name, parsed, inside))
    # The checks stand in a projection, as a generator's own expressions are not compiled, and the first
    # explode keeps the filter that Spark infers for the second one from repeating them.
    cells = rows.select(F.struct(F.array_compact(F.array(*checks)).alias("bad")).alias("checked"))
    bad = cells.select(F.explode(F.array("checked")).alias("checked")).select(F.inline("checked.bad"))
    return summarize_bad(bad)


def _bad_value(name: str, parsed: Column, applies: Column) -> Column:
    return F.when(
        applies & F.col(name).isNotNull() & parsed.isNull(),
        F.struct(F.lit(name).alias("column"), F.col(name).alias("value")),
    )


def summarize_bad(bad: DataFrame) -> DataFrame:
    # Stored, as both totals and examples read it: the rows are gone through once.
    counted = stored(bad.groupBy("column", "value").agg(F.count("*").alias("n")), "bad-values")
    first = W.partitionBy("column").orderBy("value")
    examples = (
        counted.withColumn("place", F.row_number().over(first))
        .filter(F.col("place") <= MAX_EXAMPLES)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list("value")).alias("examples"))
    )
    totals = counted.groupBy("column").agg(F.sum("n").alias("n_bad"))
    return totals.join(examples, "column").select("column", "n_bad", "examples")


def clean_strict(
    raw: DataFrame, population: Population, registry: Registry, require_outcome: bool = True
) -> Cleaned:
    """Like :func:`clean`, but raises ValueError first if any text did not parse."""
    failures = unparsed(raw, population, registry, require_outcome).collect()  # a row a column
    if failures:
        raise ValueError(
            "; ".join(
                f"{f['column']}: {f['n_bad']} values cannot be read, e.g. {f['examples']}"
                for f in sorted(failures)
            )
        )
    return clean(raw, population, registry, require_outcome)


def lenient(raw: DataFrame, numeric: list[str], months: list[str]) -> DataFrame:
    """Exploration view: unreadable values are NULL, nothing is checked."""
    return raw.withColumns(
        {name: P.lenient_number(F.col(name)) for name in numeric}
        | {name: P.month_start(F.col(name)) for name in months}
    )
