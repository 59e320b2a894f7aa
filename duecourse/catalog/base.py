"""Parsing, population, label and split queries."""

from pyspark.sql import functions as F

from duecourse.catalog.core import FINAL, REPLAY, SETTINGS, query, sql_between, sql_month
from duecourse.functions import parsing as P
from duecourse.operators import clean as C
from duecourse.operators import windows as Wn
from duecourse.registry import STANDIN


def text_dates(df):
    """DATE columns as ISO text, so that results compare equal in any client."""
    dates = [f.name for f in df.schema if f.dataType.typeName() == "date"]
    return df.withColumns({d: F.col(d).cast("string") for d in dates})


LOAN_FIELDS = ", ".join(
    f"CAST({c} AS VARCHAR) AS {c}" if c in ("issue_d", "earliest_cr_line") else c
    for c in ("id", "issue_d", "y", *STANDIN.features)
)
AUX_FIELDS = ", ".join(("id", *STANDIN.aux))


@query(
    "p1_loan_rows_only",
    "SELECT id, issue_d, loan_status FROM {raw_mixed} WHERE regexp_full_match(id, '[0-9]+')",
)
def p1(t):
    return C.loan_rows(t.raw_mixed).select("id", "issue_d", "loan_status")


@query(
    "p2_population_mask",
    f"""SELECT id, coalesce(trim(term) = '36 months' AND application_type = 'Individual'
          AND {sql_between(sql_month('issue_d'), SETTINGS.population.window)}
          AND loan_status IN {FINAL}, false) AS in_population FROM {{loans_raw}}""",
)
def p2(t):
    inside = C.in_population(P.month_start(F.col("issue_d")), SETTINGS.population)
    return t.raw.select("id", F.coalesce(inside, F.lit(False)).alias("in_population"))


@query(
    "p3_inclusive_window",
    f"""SELECT CAST(issue_d AS VARCHAR) AS issue_d, count(*) AS loans FROM {{typed}}
        WHERE {sql_between('issue_d', SETTINGS.splits['test'])} GROUP BY 1""",
)
def p3(t):
    issue = P.month_start(F.col("issue_d"))
    rows = t.raw.select(issue.alias("issue_d")).filter(
        SETTINGS.splits["test"].contains(F.col("issue_d"))
    )
    return text_dates(rows.groupBy("issue_d").agg(F.count("*").alias("loans")))


@query("p4_label", "SELECT id, y FROM {population}")
def p4(t):
    return t.loans.select("id", F.col("y").cast("int").alias("y"))


@query("p5_nullable_label", "SELECT id, y FROM {replay}")
def p5(t):
    return t.replay.select("id", F.col("y").cast("int").alias("y"))


@query("p6_numeric_parse", "SELECT id, loan_amnt, annual_inc, revol_bal, installment FROM {typed}")
def p6(t):
    names = ("loan_amnt", "annual_inc", "revol_bal", "installment")
    return t.raw.select(
        F.col("id").cast("bigint").alias("id"), *(P.number(F.col(n)).alias(n) for n in names)
    )


@query("p7_percent_parse", "SELECT id, revol_util, int_rate FROM {typed}")
def p7(t):
    return t.raw.select(
        F.col("id").cast("bigint").alias("id"),
        *(P.number(F.col(n), percent=True).alias(n) for n in ("revol_util", "int_rate")),
    )


@query(
    "p8_month_parse",
    """SELECT id, CAST(issue_d AS VARCHAR) AS issue_d,
              CAST(earliest_cr_line AS VARCHAR) AS earliest_cr_line FROM {typed}""",
)
def p8(t):
    return text_dates(
        t.raw.select(
            F.col("id").cast("bigint").alias("id"),
            *(P.month_start(F.col(n)).alias(n) for n in ("issue_d", "earliest_cr_line")),
        )
    )


@query("p9_employment_years", "SELECT id, emp_length FROM {typed}")
def p9(t):
    return t.raw.select(
        F.col("id").cast("bigint").alias("id"),
        P.employment_years(F.col("emp_length")).alias("emp_length"),
    )


def spoiled(raw):
    """Every 29th loan gets an unreadable amount, every 31st an unknown employment length and
    every 37th a malformed month, so that the failure report has something to say."""
    k = F.col("id").cast("bigint")
    return raw.withColumns(
        {
            "annual_inc": F.when(k % 29 == 0, F.concat(F.lit("n/k "), (k % 9).cast("string")))
            .otherwise(F.col("annual_inc")),
            "emp_length": F.when(k % 31 == 0, F.lit("n/a")).otherwise(F.col("emp_length")),
            "issue_d": F.when(k % 37 == 0, F.lit("2000-01")).otherwise(F.col("issue_d")),
            "earliest_cr_line": F.when(k % 41 == 0, F.lit("Jan-99"))
            .otherwise(F.col("earliest_cr_line")),
        }
    )


SPOILED = """
  spoiled AS (SELECT CAST(id AS BIGINT) AS k, term, application_type, loan_status,
     CASE WHEN CAST(id AS BIGINT) % 29 = 0 THEN 'n/k ' || (CAST(id AS BIGINT) % 9) ELSE annual_inc END AS annual_inc,
     CASE WHEN CAST(id AS BIGINT) % 31 = 0 THEN 'n/a' ELSE emp_length END AS emp_length,
     CASE WHEN CAST(id AS BIGINT) % 37 = 0 THEN '2000-01' ELSE issue_d END AS issue_d,
     CASE WHEN CAST(id AS BIGINT) % 41 = 0 THEN 'Jan-99' ELSE earliest_cr_line END AS earliest_cr_line
   FROM {loans_raw}),
  inside AS (SELECT * FROM spoiled WHERE k % 37 <> 0 AND trim(term) = '36 months'
     AND application_type = 'Individual' AND loan_status IN """ + FINAL + f"""
     AND {sql_between(sql_month('issue_d'), SETTINGS.population.window)}),
  bad AS (SELECT 'issue_d' AS "column", issue_d AS value FROM spoiled WHERE k % 37 = 0
     UNION ALL SELECT 'annual_inc', annual_inc FROM inside WHERE k % 29 = 0
     UNION ALL SELECT 'emp_length', emp_length FROM inside WHERE k % 31 = 0
     UNION ALL SELECT 'earliest_cr_line', earliest_cr_line FROM inside WHERE k % 41 = 0)
"""


@query(
    "p10_unparsed_report",
    f"""WITH {SPOILED},
      firsts AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) AS place
                 FROM (SELECT DISTINCT "column", value FROM bad) d)
      SELECT b."column", b.n_bad, f.examples
      FROM (SELECT "column", count(*) AS n_bad FROM bad GROUP BY 1) b
      JOIN (SELECT "column", string_agg(value, '|' ORDER BY value) AS examples
            FROM firsts WHERE place <= 5 GROUP BY 1) f ON b."column" = f."column" """,
)
def p10(t):
    report = C.unparsed(spoiled(t.raw), SETTINGS.population, STANDIN)
    return report.withColumn("examples", F.array_join("examples", "|"))


@query(
    "p11_strip",
    "SELECT id, '[' || trim(term) || ']' AS term, '[' || trim(int_rate) || ']' AS int_rate FROM {loans_raw}",
)
def p11(t):
    def framed(name):
        return F.concat(F.lit("["), P.strip(F.col(name)), F.lit("]")).alias(name)

    return t.raw.select("id", framed("term"), framed("int_rate"))


@query("p12_impossible_to_null", "SELECT id, dti FROM {typed}")
def p12(t):
    return t.raw.select(F.col("id").cast("bigint").alias("id"), C.typed("dti", STANDIN))


@query("p13_clean_loans", f"SELECT {LOAN_FIELDS} FROM {{loans}}")
def p13(t):
    return text_dates(t.loans.withColumn("y", F.col("y").cast("int")))


@query("p13_clean_aux", f"SELECT {AUX_FIELDS} FROM {{aux}}")
def p13_aux(t):
    return t.aux


@query(
    "p14_check_order",
    f"""WITH {SPOILED}
        SELECT CASE WHEN "column" = 'issue_d' THEN 'all rows' ELSE 'population' END AS stage,
               count(*) AS n_bad FROM bad GROUP BY 1""",
)
def p14(t):
    report = C.unparsed(spoiled(t.raw), SETTINGS.population, STANDIN)
    stage = F.when(F.col("column") == "issue_d", "all rows").otherwise("population")
    return report.groupBy(stage.alias("stage")).agg(F.sum("n_bad").alias("n_bad"))


@query("p15_id_bigint", "SELECT id, id % 1000 AS id_mod FROM {typed}")
def p15(t):
    key = C.loan_rows(t.raw_mixed).select(F.col("id").cast("bigint").alias("id"))
    return key.withColumn("id_mod", F.col("id") % 1000)


@query(
    "p20_lenient_parse",
    """SELECT id, annual_inc, CASE WHEN id % 41 = 0 THEN NULL
              ELSE CAST(earliest_cr_line AS VARCHAR) END AS earliest_cr_line
       FROM (SELECT id, CASE WHEN id % 29 = 0 THEN NULL ELSE annual_inc END AS annual_inc,
                    earliest_cr_line FROM {typed}) q""",
)
def p20(t):
    view = C.lenient(spoiled(t.raw), ["annual_inc"], ["earliest_cr_line"])
    return text_dates(view.select(F.col("id").cast("bigint").alias("id"), "annual_inc", "earliest_cr_line"))


@query(
    "u1_union_of_batches",
    "SELECT id, y FROM {population}",
)
def u1(t):
    parts = [t.raw.filter(F.col("term") == term) for term in (" 36 months", " 60 months")]
    cleaned = [C.clean(part, SETTINGS.population, STANDIN).loans for part in parts]
    return cleaned[0].unionByName(cleaned[1]).select("id", F.col("y").cast("int").alias("y"))


SPLIT_STATS = """SELECT split, count(*) AS loans, round(avg(y), 5) AS default_rate,
       strftime(min(issue_d), '%Y-%m') AS first_month, strftime(max(issue_d), '%Y-%m') AS last_month
       FROM {scored} GROUP BY split"""


@query("a1_split_stats", SPLIT_STATS)
def a1(t):
    return Wn.split_stats(Wn.assign_split(t.loans, SETTINGS.splits))


@query("c4_split_assignment", "SELECT id, split FROM {scored}")
def c4(t):
    return Wn.assign_split(t.loans, SETTINGS.splits).select("id", "split")


@query(
    "j6_window_of_row",
    "SELECT split, strftime(issue_d, '%Y-%m') AS month, count(*) AS loans FROM {scored} GROUP BY 1, 2",
)
def j6(t):
    rows = Wn.assign_split(t.loans, SETTINGS.splits)
    return rows.groupBy("split", P.year_month(F.col("issue_d")).alias("month")).agg(
        F.count("*").alias("loans")
    )


@query(
    "u4_split_conservation",
    f"""SELECT CASE WHEN {sql_between('issue_d', SETTINGS.splits['test'])} THEN 1 ELSE 0 END
              + CASE WHEN issue_d < {"DATE '1996-02-01'"} THEN 1 ELSE 0 END
              + CASE WHEN issue_d BETWEEN DATE '1996-01-01' AND DATE '1997-05-01' THEN 1 ELSE 0 END AS windows,
              count(*) AS loans FROM {{loans}} GROUP BY 1""",
)
def u4(t):
    from duecourse.config import Window

    overlapping = {
        "train": Window.of("1990-01", "1996-01"),
        "val": Window.of("1996-01", "1997-05"),
        "test": SETTINGS.splits["test"],
    }
    return Wn.window_hits(t.loans, overlapping)


@query(
    "d13_replay_shares",
    f"""SELECT count(*) AS loans, count(DISTINCT issue_d) AS months,
          strftime(min(issue_d), '%Y-%m') AS first_month, strftime(max(issue_d), '%Y-%m') AS last_month,
          round(avg(CASE WHEN y IS NULL THEN 1.0 ELSE 0.0 END), 6) AS without_outcome FROM (
          SELECT *, row_number() OVER (PARTITION BY issue_d ORDER BY md5(CAST(id AS VARCHAR) || '-42'), id) AS place
          FROM {{replay}}) q WHERE place <= {SETTINGS.monitoring.sample_per_month}""",
)
def d13(t):
    from duecourse.operators.sampling import replay_summary, sample_by_month

    return replay_summary(sample_by_month(t.replay, SETTINGS.monitoring.sample_per_month, SETTINGS.monitoring.seed))
