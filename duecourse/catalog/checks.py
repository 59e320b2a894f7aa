"""Contract, join and request queries."""

from pyspark.sql import functions as F

from duecourse.catalog.base import text_dates
from duecourse.catalog.core import REPLAY, SETTINGS, add_view, query
from duecourse.operators import clean as C
from duecourse.operators import contracts as K
from duecourse.operators import joins
from duecourse.operators import requests as R
from duecourse.registry import STANDIN


def broken(loans):
    """Clean loans, each rule broken in every n-th row, plus repeated rows."""
    k = F.col("id")

    def now_and_then(name, every, value):
        return F.when(k % every == 0, value).otherwise(F.col(name))

    changed = loans.withColumns(
        {
            "loan_amnt": now_and_then("loan_amnt", 53, F.lit(None)),
            "dti": now_and_then("dti", 59, F.lit(150.0)),
            "annual_inc": now_and_then("annual_inc", 61, F.lit(0.0)),
            "home_ownership": now_and_then("home_ownership", 67, F.lit("CASTLE")),
            "y": now_and_then("y", 73, F.lit(2)).cast("tinyint"),
            "fico_range_high": now_and_then("fico_range_high", 79, F.col("fico_range_low") - 1),
            "earliest_cr_line": now_and_then("earliest_cr_line", 83, F.add_months("issue_d", 1)),
        }
    )
    return changed.unionByName(changed.filter(k % 71 == 0))


def _broken_sql(source: str) -> str:
    changed = f"""SELECT id, issue_d,
        CASE WHEN id % 53 = 0 THEN NULL ELSE loan_amnt END AS loan_amnt,
        CASE WHEN id % 59 = 0 THEN 150.0 ELSE dti END AS dti,
        CASE WHEN id % 61 = 0 THEN 0.0 ELSE annual_inc END AS annual_inc,
        CASE WHEN id % 67 = 0 THEN 'CASTLE' ELSE home_ownership END AS home_ownership,
        CASE WHEN id % 73 = 0 THEN 2 ELSE y END AS y, fico_range_low,
        CASE WHEN id % 79 = 0 THEN fico_range_low - 1 ELSE fico_range_high END AS fico_range_high,
        CASE WHEN id % 83 = 0 THEN issue_d + INTERVAL 1 MONTH ELSE earliest_cr_line END AS earliest_cr_line,
        purpose, emp_length, delinq_2yrs, mths_since_last_delinq, mths_since_last_record, open_acc,
        pub_rec, revol_bal, revol_util, total_acc, tax_liens FROM {source}"""
    return f"SELECT * FROM ({changed}) a UNION ALL SELECT * FROM ({changed}) b WHERE id % 71 = 0"


RULES = [
    ("not_null", "loan_amnt", "loan_amnt IS NULL"),
    ("in_range", "loan_amnt", "loan_amnt NOT BETWEEN 500 AND 40000"),
    ("in_range", "emp_length", "emp_length NOT BETWEEN 0 AND 10"),
    ("in_range", "dti", "dti NOT BETWEEN 0 AND 100"),
    ("in_range", "annual_inc", "annual_inc <= 0"),
    ("in_range", "fico_range_low", "fico_range_low NOT BETWEEN 300 AND 850"),
    ("in_range", "fico_range_high", "fico_range_high NOT BETWEEN 300 AND 850"),
    ("in_range", "revol_util", "revol_util NOT BETWEEN 0 AND 1000"),
    ("in_range", "revol_bal", "revol_bal < 0"),
    ("allowed", "home_ownership", "home_ownership NOT IN ('MORTGAGE', 'RENT', 'OWN', 'ANY', 'OTHER', 'NONE')"),
    ("allowed", "purpose", "purpose NOT IN ('debt_consolidation', 'credit_card', 'car', 'other')"),
    ("label_known", "y", "y NOT IN (0, 1)"),
    ("fico_range_ordered", "fico_range_high", "fico_range_high < fico_range_low"),
    ("credit_line_before_issue", "earliest_cr_line", "earliest_cr_line > issue_d"),
]


def _report_sql(source: str, label_rules: bool) -> str:
    parts = [
        f"""SELECT '{c}' AS "check", '{n}' AS "column", count(*) AS n_bad FROM {source} WHERE {w}"""
        for c, n, w in RULES
    ]
    parts.append(
        f"""SELECT 'unique', 'id', count(*) FROM (SELECT id FROM {source} GROUP BY id HAVING count(*) > 1) d"""
    )
    if label_rules:
        parts.append(
            f"""SELECT 'default_rate_plausible', 'y', CAST(avg(y) NOT BETWEEN 0.05 AND 0.35 AS BIGINT) FROM {source}"""
        )
        parts.append(f"SELECT 'not_null', 'y', count(*) FROM {source} WHERE y IS NULL")
    return f"""SELECT * FROM ({' UNION ALL '.join(parts)}) r WHERE n_bad > 0"""


add_view("broken", _broken_sql("loans"), ["loans"])
add_view("report", _report_sql("broken", True), ["broken"])
add_view("broken_replay", _broken_sql("replay"), ["replay"])
add_view("replay_report", _report_sql("broken_replay", False), ["broken_replay"])

FIELDS = '"check", "column", n_bad'


def loan_contract():
    """Made when a query runs: columns need a session, and listing the queries has none."""
    return K.loan_contract(STANDIN)


def _register(name: str, checks: tuple[str, ...]) -> None:
    listed = ", ".join(f"'{c}'" for c in checks)

    @query(name, f'SELECT {FIELDS} FROM {{report}} WHERE "check" IN ({listed})')
    def build(t):
        return K.violations(broken(t.loans), loan_contract()).filter(F.col("check").isin(*checks))


_register("k2_not_null", ("not_null",))
_register("k3_in_range", ("in_range",))
_register("k4_allowed", ("allowed",))
_register("k5_unique_key", ("unique",))
_register("k6_label_known", ("label_known",))
_register("k7_range_ordered", ("fico_range_ordered",))
_register("k8_line_before_issue", ("credit_line_before_issue",))


@query("k_full_report", f"SELECT {FIELDS} FROM {{report}}")
def k_all(t):
    return K.violations(broken(t.loans), loan_contract())


@query(
    "k1_schema_problems",
    "SELECT 'unexpected column grade (string)' AS problem, count(*) AS loans FROM {loans}",
)
def k1(t):
    """Reported with the number of rows that a write would have spoiled."""
    from duecourse.operators.ordering import union_all

    frame = t.loans.withColumn("grade", F.lit("A"))
    problems = K.schema_problems(frame, loan_contract())
    return union_all(
        [frame.agg(F.lit(p).alias("problem"), F.count("*").alias("loans")) for p in problems]
    )


@query(
    "k9_default_rate",
    """SELECT split, round(avg(y), 6) AS default_rate, avg(y) BETWEEN 0.05 AND 0.35 AS plausible
       FROM {scored} GROUP BY split""",
)
def k9(t):
    from duecourse.operators import windows as Wn

    low, high = K.DEFAULT_RATE
    return Wn.assign_split(t.loans, SETTINGS.splits).groupBy("split").agg(
        F.round(F.avg("y"), 6).alias("default_rate"), F.avg("y").between(low, high).alias("plausible")
    )


@query("k10_replay_contract", f"SELECT {FIELDS} FROM {{replay_report}}")
def k10(t):
    return K.violations(broken(t.replay), K.loan_contract(STANDIN, outcome_known=False))


@query(
    "k11_aux_contract",
    """SELECT 'in_range' AS "check", 'recoveries' AS "column", sum(CASE WHEN id % 71 = 0 THEN 2 ELSE 1 END)::BIGINT AS n_bad FROM {aux} WHERE id % 53 = 0
       UNION ALL SELECT 'unique', 'id', count(*) FROM {aux} WHERE id % 71 = 0""",
)
def k11(t):
    bad = t.aux.withColumn("recoveries", F.when(F.col("id") % 53 == 0, -1.0).otherwise(F.col("recoveries")))
    return K.violations(bad.unionByName(bad.filter(F.col("id") % 71 == 0)), K.aux_contract(STANDIN))


@query(
    "j1_loans_with_aux",
    "SELECT id, y, funded_amnt, grade FROM {population}",
)
def j1(t):
    return joins.join_one_to_one(t.loans, t.aux, "id").select(
        "id", F.col("y").cast("int").alias("y"), "funded_amnt", "grade"
    )


@query(
    "j2_money_of_loans",
    "SELECT id, funded_amnt, total_rec_prncp FROM {population}",
)
def j2(t):
    return joins.join_one_to_one(
        t.loans.select("id"), t.aux.select("id", "funded_amnt", "total_rec_prncp"), "id"
    )


@query(
    "j3_one_to_one_problems",
    """SELECT 'repeated on the left' AS problem, count(*) AS keys FROM {loans} WHERE id % 71 = 0
       UNION ALL SELECT 'repeated on the right', count(*) FROM {loans} WHERE id % 73 = 0 AND id % 79 <> 0
       UNION ALL SELECT 'no partner', count(*) FROM {loans} WHERE id % 79 = 0
       UNION ALL SELECT 'funded_amnt missing', count(*) FROM {loans} WHERE id % 83 = 0 AND id % 79 <> 0""",
)
def j3(t):
    k = F.col("id")
    left = t.loans.select("id")
    right = t.aux.select("id", F.when(k % 83 != 0, F.col("funded_amnt")).alias("funded_amnt"))
    right = right.filter(k % 79 != 0)
    return joins.one_to_one_problems(
        left.unionByName(left.filter(k % 71 == 0)),
        right.unionByName(right.filter(k % 73 == 0)),
        "id",
        "funded_amnt",
    )


@query(
    "j4_align_by_key",
    "SELECT id, pd, grade FROM {scored}",
)
def j4(t):
    """Scores and lender columns glued by key, never by row order."""
    return joins.join_one_to_one(t.scored.select("id", "pd"), t.aux.select("id", "grade"), "id")


def bodies(t):
    """Replay loans as JSON bodies, some of them spoiled."""
    k = F.col("id")
    body = R.request_json(STANDIN)
    return t.replay.select(
        "id",
        F.when(k % 101 == 0, F.lit('{"loan_amnt": 1,'))
        .when(k % 43 == 0, F.replace(body, F.lit('"dti":'), F.lit('"grade":"B","dti":')))
        .when(k % 47 == 0, F.regexp_replace(body, '"purpose":"[a-z_]*",', ""))
        .when(k % 59 == 0, F.regexp_replace(body, '"fico_range_low":[0-9.]*', '"fico_range_low":900'))
        .when(k % 61 == 0, F.regexp_replace(body, '"annual_inc":[0-9.]*', '"annual_inc":"lots"'))
        .when(k % 67 == 0, F.regexp_replace(body, '"home_ownership":"[A-Z]*"', '"home_ownership":"CASTLE"'))
        .when(k % 73 == 0, F.regexp_replace(body, '"earliest_cr_line":"[0-9-]*"', '"earliest_cr_line":"2020-01-01"'))
        .otherwise(body)
        .alias("body"),
    )


REASONS = """CASE WHEN id % 101 = 0 THEN 'not a JSON object' WHEN id % 43 = 0 THEN 'grade: unknown field'
  WHEN id % 47 = 0 THEN 'purpose: missing'
  WHEN id % 59 = 0 THEN 'fico_range_low: out of range; fico_range_high: below fico_range_low'
  WHEN id % 61 = 0 THEN 'annual_inc: unreadable' WHEN id % 67 = 0 THEN 'home_ownership: not allowed'
  WHEN id % 73 = 0 THEN 'earliest_cr_line: after application_date' ELSE '' END"""


@query("k12_request_contract", f"SELECT id, {REASONS} AS reasons FROM {{replay}}")
def k12(t):
    read = R.read_requests(bodies(t), STANDIN, today=F.lit("2001-08-15").cast("date"))
    return read.select("id", F.array_join("reasons", "; ").alias("reasons"))


@query(
    "p17_request_json",
    """SELECT id, json_extract_string(body, '$.application_date') AS application_date,
              json_extract_string(body, '$.purpose') AS purpose,
              CAST(json_extract(body, '$.loan_amnt') AS DOUBLE) AS loan_amnt,
              CAST(json_extract(body, '$.dti') AS DOUBLE) AS dti,
              len(json_keys(body)) AS fields
       FROM (SELECT id, json_object('application_date', CAST(issue_d AS VARCHAR), """
    + ", ".join(
        f"'{c}', " + (f"CAST({c} AS VARCHAR)" if c in STANDIN.dates else c) for c in STANDIN.features
    )
    + ") AS body FROM {replay}) q",
)
def p17(t):
    body = t.replay.select("id", R.request_json(STANDIN).alias("body"))
    return body.select(
        "id",
        F.get_json_object("body", "$.application_date").alias("application_date"),
        F.get_json_object("body", "$.purpose").alias("purpose"),
        F.get_json_object("body", "$.loan_amnt").cast("double").alias("loan_amnt"),
        F.get_json_object("body", "$.dti").cast("double").alias("dti"),
        F.size(F.json_object_keys("body")).cast("bigint").alias("fields"),
    )


@query(
    "p18_month_alignment",
    """SELECT event_id, CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR) AS month FROM events""",
)
def p18(t):
    return t.table("events").select(
        "event_id", F.trunc(F.col("ts").cast("date"), "MM").cast("string").alias("month")
    )


TYPED = ", ".join(
    f"CAST({c} AS VARCHAR) AS {c}" if c in STANDIN.dates else c for c in STANDIN.features
)


@query(
    "p19_typed_requests",
    f"""SELECT id, CAST(issue_d AS VARCHAR) AS issue_d, {TYPED} FROM {{replay}} WHERE {REASONS} = ''""",
)
def p19(t):
    read = R.read_requests(bodies(t), STANDIN, today=F.lit("2001-08-15").cast("date"))
    return text_dates(R.applications(read, STANDIN).drop("body"))


@query(
    "p16_columns_by_role",
    """SELECT role, count(*) * max(n) AS cells FROM (
         SELECT unnest(['numeric', 'categorical', 'date', 'auxiliary']) AS role, unnest([15, 2, 1, 9]) AS n) r
         CROSS JOIN {population} GROUP BY role""",
)
def p16(t):
    """Cells per role in the cleaned tables, so a column in the wrong role shows."""
    roles = {
        "numeric": STANDIN.numeric,
        "categorical": STANDIN.categorical,
        "date": STANDIN.dates,
    }
    loans = t.loans.agg(
        *((F.count("*") * len(names)).alias(role) for role, names in roles.items())
    ).unpivot([], list(roles), "role", "cells")
    aux = t.aux.agg((F.count("*") * (len(t.aux.columns) - 1)).alias("auxiliary"))
    return loans.unionByName(aux.unpivot([], ["auxiliary"], "role", "cells"))
