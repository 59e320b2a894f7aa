"""Source, sink and streaming queries; files go to the shared folder of the session."""

import uuid

from pyspark.sql import functions as F

from duecourse.catalog.base import LOAN_FIELDS, text_dates
from duecourse.catalog.core import SETTINGS, query
from duecourse.catalog.monitor import CUT, PRICED, RATE, reference, served
from duecourse.catalog.profiles import RAW
from duecourse.functions import parsing as P
from duecourse.operators import drift as D
from duecourse.operators import metrics as M
from duecourse.operators import requests as R
from duecourse.operators import scoring as S
from duecourse.operators import windows as Wn
from duecourse.plans.standin import standin_score
from duecourse.registry import STANDIN
from duecourse.session import shared_folder, stored
from duecourse.sources import logs, raw, reports
from duecourse.streaming import live
from duecourse.streaming import scoring as stream


def fresh(t, name):
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("s1_csv_all_text", f"SELECT {', '.join(RAW)} FROM {{loans_raw}}")
def s1(t):
    """Written with a nameless first column and read back."""
    path = fresh(t, "csv")
    t.raw.select(F.monotonically_increasing_id().alias(" "), *RAW).write.option(
        "ignoreLeadingWhiteSpace", "false"
    ).option("ignoreTrailingWhiteSpace", "false").csv(path, header=True, escape='"')
    return raw.read_csv(t.spark, path).drop(" ").select(*RAW)


SPELLED = """CASE CAST(id AS BIGINT) % 19 WHEN 0 THEN 'NA' WHEN 1 THEN 'n/a' WHEN 2 THEN 'NULL' WHEN 3 THEN '' WHEN 4 THEN 'none' ELSE purpose END"""


@query(
    "s2_null_spellings",
    f"""SELECT id, CASE WHEN CAST(id AS BIGINT) % 19 < 4 THEN NULL ELSE {SPELLED} END AS purpose FROM {{loans_raw}}""",
)
def s2(t):
    return t.raw.select("id", P.blank_to_null(F.expr(SPELLED)).alias("purpose"))


@query("s3_split_scan", "SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY 1")
def s3(t):
    return t.table("lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.sum("l_linenumber").alias("lines")
    )


@query("s4_parquet_row_count", "SELECT count(*) AS written, count(*) AS found FROM {loans_raw}")
def s4(t):
    path = fresh(t, "raw")
    written = raw.write_table(t.raw, path)
    return t.spark.read.parquet(path).agg(F.lit(written).cast("bigint").alias("written"), F.count("*").alias("found"))


@query("s5_pruned_scan", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT'")
def s5(t):
    orders = raw.read_table(t.spark, f"{t.sf_dir}/orders.parquet", ["o_orderkey", "o_orderstatus", "o_orderpriority"])
    return orders.filter("o_orderpriority = '1-URGENT'").drop("o_orderpriority")


ORDER_COLUMNS = "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split()


@query(
    "s6_column_names",
    " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS cells FROM orders""" for c in ORDER_COLUMNS),
)
def s6(t):
    """Names come from the file, with the filled cells of each."""
    orders = t.table("orders")
    names = orders.columns
    return orders.agg(*(F.count(c).alias(c) for c in names)).unpivot([], names, "column", "cells")


@query("s7_split_table", f"SELECT {LOAN_FIELDS} FROM {{scored}} WHERE split = 'val'")
def s7(t):
    path = fresh(t, "splits")
    raw.write_splits(Wn.assign_split(t.loans, SETTINGS.splits), path)
    val = raw.read_split(t.spark, path, "val").drop("split")
    return text_dates(val.withColumn("y", F.col("y").cast("int")))


LOGGED = """strftime(issue_d, '%Y-%m') AS month, pd, decision, 'standin-1' AS model_version, loan_amnt, dti, purpose"""


def shown(frame):
    return frame.select(
        P.year_month(F.col("issue_d")).alias("month"), "pd", "decision", "model_version", "loan_amnt", "dti", "purpose"
    )


def write_log(t):
    path = fresh(t, "log")
    logs.append_log(served(t), path, STANDIN, request_id=F.col("id").cast("string"))
    return path


@query("s8_read_log", f"SELECT {LOGGED} FROM {{served}}")
def s8(t):
    return shown(logs.served_applications(logs.raw_log(t.spark, write_log(t)), STANDIN))


@query("s9_append_log", "SELECT decision, 2 * count(*) AS n FROM {served} GROUP BY decision")
def s9(t):
    path = write_log(t)
    logs.append_log(served(t), path, STANDIN)
    return logs.raw_log(t.spark, path).groupBy("decision").agg(F.count("*").alias("n"))


@query("x8_log_record")
def x8(t):
    return logs.raw_log(t.spark, write_log(t))


@query(
    "x8_log_invariants",
    """SELECT decision, count(*) AS records, count(DISTINCT id) AS requests, round(sum(loan_amnt), 2) AS loan_amnt,
              count(dti) AS filled_dti, round(sum(pd), 6) AS pd FROM {served} GROUP BY decision""",
)
def x8_invariants(t):
    """What the written records hold: a record a request, with its inputs nested."""
    log = logs.raw_log(t.spark, write_log(t))

    def inside(name: str):
        return F.get_json_object("features", f"$.{name}").cast("double")

    return log.groupBy("decision").agg(
        F.count("*").alias("records"), F.countDistinct("request_id").alias("requests"),
        F.round(F.sum(inside("loan_amnt")), 2).alias("loan_amnt"), F.count(inside("dti")).alias("filled_dti"),
        F.round(F.sum("pd"), 6).alias("pd"),
    )


STATS = "SELECT split, count(*) AS loans, round(avg(y), 5) AS default_rate FROM {scored} GROUP BY split"


def split_metrics(t):
    return Wn.split_stats(Wn.assign_split(t.loans, SETTINGS.splits)).select("split", "loans", "default_rate")


@query("s10_json_report", STATS)
def s10(t):
    path = fresh(t, "report")
    report = split_metrics(t)
    reports.write_json(report, path)
    return reports.read_json(t.spark, path, report.schema)


@query(
    "s11_flat_metrics",
    f"""SELECT split, 'val.size.loans' AS metric, CAST(loans AS DOUBLE) AS value FROM ({STATS}) q
        UNION ALL SELECT split, 'val.rates.default_rate', default_rate FROM ({STATS}) p""",
)
def s11(t):
    nested = split_metrics(t).select(
        "split",
        F.struct("loans", (F.col("loans") > 0).alias("any")).alias("size"),
        F.struct("default_rate").alias("rates"),
    )
    return reports.flatten(nested, "val.", keep=("split",))


@query(
    "s12_csv_report",
    """SELECT CAST(bin AS VARCHAR) AS bin, round(mean_predicted, 5) AS mean_predicted,
              round(observed_rate, 5) AS observed_rate, loans FROM {calibration}""",
)
def s12(t):
    path = fresh(t, "calibration")
    reports.write_csv(M.calibration_table(t.kept_scores), path)
    rows = t.spark.read.csv(path, header=True)
    return rows.select(
        "bin",
        F.col("mean_predicted").cast("double").alias("mean_predicted"),
        F.col("observed_rate").cast("double").alias("observed_rate"),
        F.col("loans").cast("bigint").alias("loans"),
    )


# --- streams: every input file is processed, then the query ends -----------------------------
def decide(frame):
    score = standin_score(key="loan_amnt").cast("double")
    return S.decide_applications(frame.withColumn("pd", score), CUT, PRICED, "standin-1")


STREAM_SCORE = """(20 + CAST(floor(400 * coalesce(delinq_2yrs, 0) / coalesce(open_acc, 1)) AS BIGINT)
    + CAST(loan_amnt AS BIGINT) * 7919 % 300) / 1000.0::DOUBLE"""


@query(
    "t1_scored_stream",
    f"""SELECT strftime(issue_d, '%Y-%m') AS month, loan_amnt, dti, {STREAM_SCORE} AS pd,
          CASE WHEN policy_flags <> '' THEN 'refer' WHEN {STREAM_SCORE} >= {CUT} THEN 'reject' ELSE 'approve' END AS decision
        FROM {{served}}""",
)
def t1(t):
    requests, log = fresh(t, "requests"), fresh(t, "log")
    t.replay.select(R.request_json(STANDIN)).write.text(requests)
    read = stream.request_stream(t.spark, requests, STANDIN)
    stream.score_to_log(read, decide, STANDIN, log, fresh(t, "progress")).awaitTermination()
    typed = logs.served_applications(logs.raw_log(t.spark, log), STANDIN)
    return typed.select(P.year_month(F.col("issue_d")).alias("month"), "loan_amnt", "dti", "pd", "decision")


@query("t2_streamed_drift", "SELECT strftime(month, '%Y-%m') AS month, feature, round(psi, 6) AS psi FROM {psi}")
def t2(t):
    base = D.monitored(reference(t), STANDIN)
    edges = D.reference_edges(base, STANDIN)
    log, counts = write_log(t), fresh(t, "counts")
    rows = logs.served_applications(logs.stream_log(t.spark, log, files_per_batch=4), STANDIN)
    stream.count_bins(rows, edges, STANDIN, counts, fresh(t, "progress")).awaitTermination()
    drift = D.feature_drift(
        stream.counted_bins(t.spark, counts), D.bin_counts(base, edges, STANDIN, [])
    )
    return drift.select(P.year_month(F.col("month")).alias("month"), "feature", F.round("psi", 6).alias("psi"))


@query(
    "t3_live_decision_rates",
    "SELECT strftime(month, '%Y-%m') AS month, loans, mean_pd, reject_rate, refer_rate FROM {monthly}",
)
def t3(t):
    """The live table after all batches, one of them written twice, and after a compaction."""
    table = live.decision_table(fresh(t, "rates")).create(t.spark)
    rows = logs.served_applications(logs.stream_log(t.spark, write_log(t), files_per_batch=4), STANDIN)
    stream.live_decision_rates(rows, table, fresh(t, "progress")).awaitTermination()
    again = table.by_batch(t.spark).filter("batch_id = 0").drop("batch_id")
    table.write(stored(again, "repeated"), 0)
    table.compact(t.spark)
    return stream.live_rates(t.spark, table).withColumn("month", P.year_month(F.col("month")))


@query(
    "x9_replayed_decisions",
    f"""SELECT CASE WHEN policy_flags <> '' THEN 'refer' WHEN {STREAM_SCORE} >= {CUT} THEN 'reject' ELSE 'approve' END AS decision, count(*) AS n
        FROM {{served}} GROUP BY 1""",
)
def x9(t):
    requests, log = fresh(t, "requests"), fresh(t, "log")
    stream.write_requests_by_month(t.replay, STANDIN, requests)
    read = stream.request_stream(t.spark, requests, STANDIN)
    stream.score_to_log(read, decide, STANDIN, log, fresh(t, "progress")).awaitTermination()
    return logs.raw_log(t.spark, log).groupBy("decision").agg(F.count("*").alias("n"))


@query(
    "x9_replay_ledger",
    """WITH m AS (SELECT strftime(issue_d, '%Y-%m') AS month, count(*) AS loans FROM {replay} GROUP BY 1),
       c AS (SELECT *, (loans + 499) // 500 AS batches FROM m)
       SELECT month, loans, batches, least(loans, 500) AS largest,
              CAST(sum(batches) OVER (ORDER BY month) - batches AS BIGINT) AS first_batch,
              CAST(sum(batches) OVER (ORDER BY month) - 1 AS BIGINT) AS last_batch FROM c""",
)
def x9_ledger(t):
    """The order in which a replay came and the size of its chunks, from the ledger of its files."""
    requests = fresh(t, "requests")
    stream.write_requests_by_month(t.replay, STANDIN, requests)
    table = live.ledger(fresh(t, "ledger")).create(t.spark)
    stream.record_arrivals(stream.body_stream(t.spark, requests), table, fresh(t, "progress")).awaitTermination()
    return live.arrivals(t.spark, table).groupBy("month").agg(
        F.sum("n_rows").alias("loans"), F.count("*").alias("batches"), F.max("n_rows").alias("largest"),
        F.min("arrival").alias("first_batch"), F.max("arrival").alias("last_batch"),
    )
