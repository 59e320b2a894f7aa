"""Registered queries, each with an equivalent SQL text where there is one."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duecourse.config import STANDIN_SETTINGS, Population
from duecourse.functions import parsing as P
from duecourse.operators import clean as C
from duecourse.operators import economics, sampling
from duecourse.operators import windows as Wn
from duecourse.plans import standin
from duecourse.registry import EVENT_DATE, KEY, SCORE, STANDIN
from duecourse.session import stored, tuned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SETTINGS = STANDIN_SETTINGS
REPLAY = Population(SETTINGS.monitoring.replay)
PRICES = economics.Economics(lgd=0.67, haircut=0.8)


class Inputs:
    """The frames most queries start from; all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self.kept = tuned(spark), sf_dir, False

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def raw(self) -> DataFrame:
        return standin.raw_loans(self.spark, self.sf_dir)

    def keep_clean(self, with_aux: bool = False) -> None:
        """Write the typed loans of the population and of the replay, for queries that read them more than once."""
        if not self.kept:
            wanted = [(SETTINGS.population, True), (REPLAY, False)]
            self.clean, replay = C.clean_once(self.raw, wanted, STANDIN, with_aux)
            self.replay, self.kept = replay.loans, True

    @cached_property
    def raw_mixed(self) -> DataFrame:
        return standin.raw_with_headers(self.spark, self.sf_dir)

    @cached_property
    def clean(self) -> C.Cleaned:
        return C.clean(self.raw, SETTINGS.population, STANDIN)

    @cached_property
    def loans(self) -> DataFrame:
        return self.clean.loans

    @cached_property
    def aux(self) -> DataFrame:
        return self.clean.aux

    @cached_property
    def replay(self) -> DataFrame:
        return C.clean(self.raw, REPLAY, STANDIN, require_outcome=False).loans

    @cached_property
    def reference_sample(self) -> DataFrame:
        """The sample of test loans that drift is measured against, as a written table."""
        test = Wn.assign_split(self.loans, SETTINGS.splits).filter(F.col("split") == "test")
        return stored(sampling.sample_rows(test, SETTINGS.monitoring.reference_sample, 42), "reference")

    @cached_property
    def scored(self) -> DataFrame:
        """Population rows with label, inputs, money columns and the stand-in score.

        Loans and money come from the same raw rows, so they are carried along instead of joined.
        """
        rows = C.population_rows(self.raw, SETTINGS.population)
        typed = rows.select(
            F.col(KEY).cast("bigint").alias(KEY),
            P.month_start(F.col(EVENT_DATE)).alias(EVENT_DATE),
            C.label().alias("y"),
            *(C.typed(c, STANDIN) for c in STANDIN.features + STANDIN.aux),
        )
        return economics.with_exposure(typed).withColumn(SCORE, standin.standin_score())


    @cached_property
    def kept_scores(self) -> DataFrame:
        """The scored rows as a written table, for queries that read them more than once."""
        columns = (KEY, EVENT_DATE, "y", SCORE, economics.FUNDED, economics.INTEREST)
        return stored(self.scored.select(*columns, "int_rate", "installment", "funded_amnt"), "scores")


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return register


# --- the same inputs in SQL ----------------------------------------------------------------
def _num(name: str) -> str:
    text = f"trim({name}, ' ' || chr(9) || chr(10) || chr(13))"
    if name in STANDIN.percent:
        text = f"trim(rtrim({text}, '%'))"
    pattern = "[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
    value = f"CASE WHEN regexp_full_match({text}, '{pattern}') THEN TRY_CAST({text} AS DOUBLE) END"
    return f"CASE WHEN {value} >= 0 THEN {value} END" if name == "dti" else value


def sql_month(name: str) -> str:
    return f"CAST(try_strptime({name}, '%b-%Y') AS DATE)"


def sql_typed(name: str) -> str:
    if name == "emp_length":
        return (
            "CASE WHEN emp_length = '< 1 year' THEN 0.0::DOUBLE WHEN emp_length = '1 year' THEN 1.0 "
            "WHEN emp_length = '10+ years' THEN 10.0 "
            "WHEN regexp_full_match(emp_length, '[2-9] years') THEN CAST(left(emp_length, 1) AS DOUBLE) "
            "END AS emp_length"
        )
    if name in STANDIN.numeric + STANDIN.aux_numeric:
        return f"{_num(name)} AS {name}"
    if name in STANDIN.dates:
        return f"{sql_month(name)} AS {name}"
    return f"trim({name}, ' ' || chr(9) || chr(10) || chr(13)) AS {name}"


def sql_date(day) -> str:
    return f"DATE '{day:%Y-%m-%d}'"


def sql_between(column: str, window) -> str:
    return f"{column} BETWEEN {sql_date(window.start)} AND {sql_date(window.end)}"


FINAL = "('Fully Paid', 'Charged Off', 'Default')"
_ALL = STANDIN.features + STANDIN.aux
VIEWS = {
    "loans_raw": standin.LOANS_SQL,
    "raw_mixed": f"SELECT * FROM loans_raw UNION ALL BY NAME {standin.HEADERS_SQL}",
    "typed": (
        f"SELECT CAST(id AS BIGINT) AS id, {sql_month('issue_d')} AS issue_d, "
        "trim(term) AS term, application_type, loan_status, "
        "CASE WHEN loan_status IN ('Charged Off', 'Default') THEN 1 "
        f"WHEN loan_status = 'Fully Paid' THEN 0 END AS y, {', '.join(map(sql_typed, _ALL))} "
        "FROM loans_raw"
    ),
    "population": (
        "SELECT * FROM typed WHERE term = '36 months' AND application_type = 'Individual' "
        f"AND {sql_between('issue_d', SETTINGS.population.window)} AND loan_status IN {FINAL}"
    ),
    "loans": f"SELECT id, issue_d, y, {', '.join(STANDIN.features)} FROM population",
    "aux": f"SELECT id, {', '.join(STANDIN.aux)} FROM population",
    "replay": (
        f"SELECT id, issue_d, y, {', '.join(STANDIN.features)} FROM typed "
        "WHERE term = '36 months' AND application_type = 'Individual' "
        f"AND {sql_between('issue_d', REPLAY.window)}"
    ),
    "scored": (
        "SELECT *, CAST(round(funded_amnt * 100) AS BIGINT) AS funded_cents, "
        "CAST(round(installment * 100) AS BIGINT) * 36 - CAST(round(funded_amnt * 100) AS BIGINT) "
        "AS interest_cents, "
        "(20 + CAST(floor(400 * coalesce(delinq_2yrs, 0) / coalesce(open_acc, 1)) AS BIGINT) "
        "+ (id * 7919) % 300) / 1000.0::DOUBLE AS pd, "
        f"CASE WHEN {sql_between('issue_d', SETTINGS.splits['train'])} THEN 'train' "
        f"WHEN {sql_between('issue_d', SETTINGS.splits['val'])} THEN 'val' ELSE 'test' END AS split "
        "FROM population"
    ),
}
_NEEDS = {
    "loans_raw": [],
    "raw_mixed": ["loans_raw"],
    "typed": ["loans_raw"],
    "population": ["typed"],
    "loans": ["population"],
    "aux": ["population"],
    "replay": ["typed"],
    "scored": ["population"],
}


def add_view(name: str, sql: str, needs: list[str]) -> None:
    """A further named step for SQL texts."""
    VIEWS[name], _NEEDS[name] = sql, needs


def _chain(names: list[str]) -> list[str]:
    """The names and all they need, each after what it needs."""
    chain: list[str] = []
    for name in names:
        chain += [n for n in (*_chain(_NEEDS[name]), name) if n not in chain]
    return chain


def with_views(sql: str) -> str:
    """Prefix the SQL with the steps it mentions as ``{name}``."""
    used = [name for name in VIEWS if "{" + name + "}" in sql]
    chain = _chain(used)
    for name in used:
        sql = sql.replace("{" + name + "}", name)
    if not chain:
        return sql
    steps = ", ".join(f"{name} AS ({VIEWS[name].strip()})" for name in chain)
    if sql.lstrip().upper().startswith("WITH "):
        return f"WITH {steps}, {sql.lstrip()[5:]}"
    return f"WITH {steps} {sql}"
