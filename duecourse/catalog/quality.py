"""Ranking, calibration, rank and sampling queries."""

from pyspark.sql import functions as F

from duecourse.catalog.core import SETTINGS, add_view, query
from duecourse.operators import metrics as M
from duecourse.operators import ordering
from duecourse.operators import sampling
from duecourse.operators import windows as Wn

add_view(
    "points",
    """SELECT *, sum(neg) OVER (ORDER BY pd) - neg AS neg_below, sum(pos) OVER (ORDER BY pd) - pos AS pos_below,
              sum(pos) OVER () AS p, sum(neg) OVER () AS n
       FROM (SELECT pd, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY pd) q""",
    ["scored"],
)
AUC = "sum(pos * (neg_below + neg / 2.0)) / max(p * n)"
AP = "sum(pos * ((p - pos_below) / (p - pos_below + n - neg_below))) / max(p)"
add_view(
    "binned",
    """SELECT *, greatest(0, ((r - 1) * 10 + cnt - 2) // (cnt - 1) - 1) AS bin FROM (
         SELECT *, row_number() OVER (ORDER BY pd, id) AS r, count(*) OVER () AS cnt FROM scored) q""",
    ["scored"],
)
add_view(
    "calibration",
    "SELECT bin, avg(pd) AS mean_predicted, avg(y) AS observed_rate, count(*) AS loans FROM binned GROUP BY bin",
    ["binned"],
)
ECE = "sum(abs(mean_predicted - observed_rate) * loans) / sum(loans)"


@query("q1_roc_auc", f"SELECT round({AUC}, 5) AS roc_auc FROM {{points}}")
def q1(t):
    return M.ranking(t.scored).select(F.round("roc_auc", 5).alias("roc_auc"))


@query("q2_average_precision", f"SELECT round({AP}, 5) AS pr_auc FROM {{points}}")
def q2(t):
    return M.ranking(t.scored).select(F.round("pr_auc", 5).alias("pr_auc"))


@query("q3_brier", "SELECT round(avg((pd - y) * (pd - y)), 5) AS brier FROM {scored}")
def q3(t):
    return M.probability_errors(t.scored).select(F.round("brier", 5).alias("brier"))


LOG_LOSS = """avg(-(y * ln(greatest(1e-6, least(1 - 1e-6, pd)))
              + (1 - y) * ln(1 - greatest(1e-6, least(1 - 1e-6, pd)))))"""


@query("q4_log_loss", f"SELECT round({LOG_LOSS}, 5) AS log_loss FROM {{scored}}")
def q4(t):
    return M.probability_errors(t.scored).select(F.round("log_loss", 5).alias("log_loss"))


@query("q5_equal_size_bins", "SELECT id, CAST(bin AS INT) AS bin FROM {binned}")
def q5(t):
    return ordering.assign_bins(t.kept_scores, "pd", "id", 10).select("id", "bin")


@query(
    "q6_calibration_table",
    """SELECT CAST(bin AS INT) AS bin, round(mean_predicted, 5) AS mean_predicted,
              round(observed_rate, 5) AS observed_rate, loans FROM {calibration}""",
)
def q6(t):
    table = M.calibration_table(t.kept_scores)
    return table.select(
        "bin",
        F.round("mean_predicted", 5).alias("mean_predicted"),
        F.round("observed_rate", 5).alias("observed_rate"),
        "loans",
    )


@query("q7_calibration_error", f"SELECT round({ECE}, 5) AS ece FROM {{calibration}}")
def q7(t):
    return M.calibration_error(t.kept_scores).select(F.round("ece", 5).alias("ece"))


@query(
    "q8_metric_bundle",
    f"""SELECT (SELECT round({AUC}, 5) FROM {{points}}) AS roc_auc, (SELECT round({AP}, 5) FROM {{points}}) AS pr_auc,
          round(avg((pd - y) * (pd - y)), 5) AS brier, round({LOG_LOSS}, 5) AS log_loss,
          (SELECT round({ECE}, 5) FROM {{calibration}}) AS ece FROM {{scored}}""",
)
def q8(t):
    return M.probability_metrics(t.kept_scores)


@query(
    "q9_column_as_score",
    """WITH pts AS (SELECT *, sum(neg) OVER (PARTITION BY split ORDER BY int_rate) - neg AS neg_below,
          sum(pos) OVER (PARTITION BY split ORDER BY int_rate) - pos AS pos_below,
          sum(pos) OVER (PARTITION BY split) AS p, sum(neg) OVER (PARTITION BY split) AS n
        FROM (SELECT split, int_rate, sum(y) AS pos, sum(1 - y) AS neg FROM {scored} GROUP BY 1, 2) q)
       SELECT split, round("""
    + AUC
    + ", 5) AS roc_auc, round("
    + AP
    + ", 5) AS pr_auc FROM pts GROUP BY split",
)
def q9(t):
    rows = Wn.assign_split(t.scored, SETTINGS.splits)
    result = M.ranking(rows, score="int_rate", key="split")
    return result.select(
        "split", F.round("roc_auc", 5).alias("roc_auc"), F.round("pr_auc", 5).alias("pr_auc")
    )


SPEARMAN = """WITH base AS (SELECT installment / funded_amnt AS a, int_rate AS b FROM {scored}),
  ranked AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra,
                    rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM base)
  SELECT round(corr(ra, rb), 5) AS spearman FROM ranked"""


def spearman(t):
    ratio = F.try_divide(F.col("installment"), F.col("funded_amnt"))
    pairs = t.scored.select(ratio.alias("ratio"), "int_rate")
    return M.rank_correlation(pairs, "ratio", "int_rate").select(
        F.round("spearman", 5).alias("spearman")
    )


@query("q10_spearman", SPEARMAN)
def q10(t):
    return spearman(t)


@query("n17_leak_by_rank", SPEARMAN.replace("installment / funded_amnt", "funded_amnt").replace("int_rate AS b", "installment AS b"))
def n17(t):
    pairs = t.scored.select("funded_amnt", "installment")
    return M.rank_correlation(pairs, "funded_amnt", "installment").select(
        F.round("spearman", 5).alias("spearman")
    )


@query(
    "w1_first_come_rank",
    "SELECT r AS place, id, pd FROM {binned} WHERE r IN (1, 2, 10, 100, cnt // 2, cnt - 1, cnt)",
)
def w1(t):
    n = F.col("total_n")
    places = [F.lit(1), F.lit(2), F.lit(10), F.lit(100), F.floor(n / 2), n - 1, n]
    rows = t.kept_scores.withColumn("all_rows", F.lit("all"))
    found = ordering.order_statistics(rows, "pd", "id", "all_rows", places)
    total = t.kept_scores.agg(F.count("*")).scalar()
    fixed = F.array(F.lit(1), F.lit(2), F.lit(10), F.lit(100))
    rank = (
        F.when(F.col("slot") < 4, F.get(fixed, F.col("slot")))
        .when(F.col("slot") == 4, F.floor(total / 2))
        .otherwise(total - 6 + F.col("slot"))
    )
    return found.select(rank.cast("bigint").alias("place"), "id", "pd")


@query(
    "w1_rank_of_every_row",
    "SELECT id, pd, row_number() OVER (ORDER BY pd, id) AS place FROM {scored}",
)
def w1_all(t):
    rows = t.kept_scores.select("id", "pd").withColumn("all_rows", F.lit("all"))
    return ordering.row_places(rows, "pd", "id", "all_rows").select("id", "pd", "place")


@query(
    "w2_average_rank",
    """SELECT pd, min(r) - 1 AS before_n, count(*) AS n, avg(r) AS average_rank FROM {binned} GROUP BY pd""",
)
def w2(t):
    rows = t.kept_scores.withColumn("all_rows", F.lit("all"))
    ranks = ordering.value_ranks(rows, "pd", "all_rows")
    return ranks.select("pd", "before_n", "n", "average_rank")


SAMPLE = "md5(CAST(id AS VARCHAR) || '-42'), id"


@query(
    "w4_sample_by_month",
    f"""SELECT id, CAST(issue_d AS VARCHAR) AS issue_d FROM (SELECT id, issue_d,
          row_number() OVER (PARTITION BY issue_d ORDER BY {SAMPLE}) AS place FROM {{replay}}) q WHERE place <= {SETTINGS.monitoring.sample_per_month}""",
)
def w4(t):
    sample = sampling.sample_by_month(t.replay.select("id", "issue_d"), SETTINGS.monitoring.sample_per_month, 42)
    return sample.select("id", F.col("issue_d").cast("string").alias("issue_d"))


@query(
    "w5_sample_rows",
    f"SELECT id FROM {{scored}} WHERE split = 'test' ORDER BY {SAMPLE} LIMIT {SETTINGS.monitoring.reference_sample}",
)
def w5(t):
    test = Wn.assign_split(t.loans, SETTINGS.splits).filter(F.col("split") == "test")
    return sampling.sample_rows(test.select("id"), SETTINGS.monitoring.reference_sample, 42)


@query(
    "w6_month_key_order",
    f"""SELECT CAST(row_number() OVER (ORDER BY issue_d, id) AS BIGINT) AS place, id FROM (
          SELECT id, issue_d, row_number() OVER (PARTITION BY issue_d ORDER BY {SAMPLE}) AS place FROM {{replay}}) q
        WHERE place <= {SETTINGS.monitoring.sample_per_month}""",
)
def w6(t):
    """The capped sample in (month, id) order; the place is counted month by month."""
    from pyspark.sql import Window as W

    sample = sampling.sample_by_month(t.replay.select("id", "issue_d"), SETTINGS.monitoring.sample_per_month, 42)
    months = sample.groupBy("issue_d").agg(F.count("*").alias("n"))
    earlier = W.orderBy("issue_d").rowsBetween(W.unboundedPreceding, -1)
    offset = months.select("issue_d", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = F.row_number().over(W.partitionBy("issue_d").orderBy("id"))
    placed = sample.withColumn("inside", inside).join(F.broadcast(offset), "issue_d")
    return placed.select((F.col("start") + F.col("inside")).alias("place"), "id").orderBy("place")


@query(
    "w7_arg_min",
    """SELECT split, arg_min(id, struct_pack(a := pd, b := id)) AS id, min(pd) AS pd FROM {scored} GROUP BY split""",
)
def w7(t):
    rows = Wn.assign_split(t.scored, SETTINGS.splits)
    return rows.groupBy("split").agg(
        F.min_by("id", F.struct("pd", "id")).alias("id"), F.min("pd").alias("pd")
    )
