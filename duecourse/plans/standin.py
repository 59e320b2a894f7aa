"""Loans derived from the order tables: one all-text row per order.

The text below runs unchanged in Spark and in DuckDB, so both start from the same raw cells.
``orders`` supplies keys, months and amounts, ``customer`` the applicant, ``lineitem`` the
bureau-like counts and the outcome.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOANS_SQL = """
WITH li AS (
  SELECT l_orderkey, count(*) AS n_lines,
         sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_r,
         sum(CASE WHEN l_quantity >= 45 THEN 1 ELSE 0 END) AS n_big,
         sum(CAST(round(l_discount * 100) AS BIGINT)) AS disc_pts,
         sum(CAST(round(l_tax * 100) AS BIGINT)) AS tax_pts,
         sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS ext
  FROM lineitem GROUP BY l_orderkey),
b AS (
  SELECT o_orderkey AS k, o_custkey AS ck, o_orderstatus AS st, o_orderpriority AS pri,
         c_mktsegment AS seg, c_nationkey AS nk, n_lines, n_r, n_big, disc_pts, tax_pts, ext,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents,
         CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 100 AS BIGINT) + 100000 AS bal,
         CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS mi
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN li ON l_orderkey = o_orderkey),
d AS (
  SELECT *, 500 + CAST(floor(cents * 79 / 100000) AS BIGINT) AS loan,
         600 + CAST(floor(coalesce(disc_pts * 150 / n_lines, 0)) AS BIGINT) AS r_bp,
         mi - CASE WHEN k % 101 = 0 THEN 20 ELSE 37 + ck % 300 END AS ecl,
         CASE WHEN st = 'O' AND mi >= 1998 * 12 + 3 THEN 'Current'
              WHEN 2 * coalesce(n_r, 0) > coalesce(n_lines, 1)
                THEN CASE WHEN k % 50 = 0 THEN 'Default' ELSE 'Charged Off' END
              ELSE 'Fully Paid' END AS status
  FROM b),
e AS (SELECT *, CAST(floor(loan * 100 * (10000 + r_bp * 2) / 360000) AS BIGINT) AS inst_c,
             CASE WHEN status IN ('Charged Off', 'Default') THEN 1 ELSE 0 END AS bad FROM d),
f AS (SELECT *, inst_c * 36 - loan * 100 AS contract_c,
             CASE WHEN bad = 1 AND k % 3 = 0 THEN loan * 8 ELSE 0 END AS rec_c FROM e)
SELECT CAST(k AS STRING) AS id,
  concat(substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(mi % 12 * 3 + 1 AS INT), 3), '-', CAST(CAST(floor(mi / 12) AS BIGINT) AS STRING)) AS issue_d,
  CASE WHEN k % 7 = 0 THEN ' 60 months' ELSE ' 36 months' END AS term,
  CASE WHEN k % 13 = 0 THEN 'Joint App' ELSE 'Individual' END AS application_type,
  status AS loan_status,
  CAST(loan AS STRING) AS loan_amnt,
  CASE pri WHEN '1-URGENT' THEN '10+ years' WHEN '2-HIGH' THEN '5 years' WHEN '3-MEDIUM' THEN '1 year' WHEN '5-LOW' THEN '< 1 year' END AS emp_length,
  CAST(20000 + CAST(floor(bal / 10) AS BIGINT) AS STRING) AS annual_inc,
  CASE WHEN bal < 5000 THEN '-1' ELSE CAST(floor(disc_pts * 30 / n_lines) / 10 AS STRING) END AS dti,
  CAST(n_r AS STRING) AS delinq_2yrs,
  CAST(CASE WHEN k % 97 = 0 THEN 640 ELSE 660 + 5 * CAST(floor(bal / 36700) AS BIGINT) END AS STRING) AS fico_range_low,
  CAST(CASE WHEN k % 97 = 0 THEN 644 ELSE 664 + 5 * CAST(floor(bal / 36700) AS BIGINT) END AS STRING) AS fico_range_high,
  CASE WHEN n_r > 0 THEN CAST(n_r * 7 + k % 24 AS STRING) END AS mths_since_last_delinq,
  CASE WHEN mi < 1999 * 12 + 6 AND n_big > 0 THEN CAST(n_big * 11 AS STRING) END AS mths_since_last_record,
  CAST(n_lines AS STRING) AS open_acc,
  CAST(n_big AS STRING) AS pub_rec,
  CAST(CAST(floor(ext / 10) AS BIGINT) AS STRING) AS revol_bal,
  CAST(floor(tax_pts * 100 / n_lines) / 10 AS STRING) || '%' AS revol_util,
  CAST(n_lines + ck % 20 AS STRING) AS total_acc,
  CAST(CASE WHEN mi < 1999 * 12 + 6 THEN n_big ELSE 0 END AS STRING) AS tax_liens,
  CASE seg WHEN 'BUILDING' THEN 'MORTGAGE' WHEN 'HOUSEHOLD' THEN 'OWN' WHEN 'MACHINERY' THEN 'OTHER' ELSE 'RENT' END AS home_ownership,
  CASE CAST(ck % 4 AS INT) WHEN 0 THEN 'debt_consolidation' WHEN 1 THEN 'credit_card' WHEN 2 THEN 'car' ELSE 'other' END AS purpose,
  concat(substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(ecl % 12 * 3 + 1 AS INT), 3), '-', CAST(CAST(floor(ecl / 12) AS BIGINT) AS STRING)) AS earliest_cr_line,
  concat(' ', CAST(CAST(r_bp AS DOUBLE) / 100 AS STRING), '%') AS int_rate,
  CAST(CAST(inst_c AS DOUBLE) / 100 AS STRING) AS installment,
  CAST(loan AS STRING) AS funded_amnt,
  CAST(CASE WHEN bad = 1 THEN CAST(floor(loan * (k % 60) / 100) AS BIGINT) ELSE loan END AS STRING) AS total_rec_prncp,
  CAST(CAST(floor(CASE WHEN bad = 1 THEN contract_c / 10 ELSE contract_c * (60 + k % 41) / 100 END) AS DOUBLE) / 100 AS STRING) AS total_rec_int,
  CAST(CAST(rec_c AS DOUBLE) / 100 AS STRING) AS recoveries,
  CAST(CAST(rec_c AS DOUBLE) / 500 AS STRING) AS collection_recovery_fee,
  substr('ABCDEFG', CAST(1 + floor((r_bp - 600) / 250) AS INT), 1) AS grade,
  CAST(nk AS STRING) AS addr_state
FROM f
"""

# Section headers as found in concatenated files: text where the id belongs, nothing else.
HEADERS_SQL = "SELECT 'Loans booked in ' || n_name AS id FROM nation"


def raw_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {
        name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        for name in ("orders", "customer", "lineitem")
    }
    text = LOANS_SQL
    for name in tables:
        for word in ("FROM", "JOIN"):
            text = text.replace(f"{word} {name}", f"{word} {{{name}}}")
    return spark.sql(text, **tables)


def raw_with_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw loans plus rows that are not loans at all."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    headers = nation.select(F.concat(F.lit("Loans booked in "), "n_name").alias("id"))
    return raw_loans(spark, sf_dir).unionByName(headers, allowMissingColumns=True)


def standin_score(delinquencies="delinq_2yrs", accounts="open_acc", key="id"):
    """Deterministic score in place of a fitted model: whole numbers until the last division."""
    share = F.floor(
        400 * F.coalesce(F.col(delinquencies), F.lit(0)).cast("bigint")
        / F.coalesce(F.col(accounts), F.lit(1)).cast("bigint")
    ).cast("bigint")
    return (20 + share + (F.col(key) * 7919) % 300) / F.lit(1000.0)
