"""Drift, scoring and promotion queries."""

from pyspark.sql import functions as F

from duecourse.catalog.core import PRICES, SETTINGS, add_view, query
from duecourse.config import Monitoring, PromotionRules
from duecourse.functions import parsing as P
from duecourse.functions.reasons import REASON_LABELS, reason_label
from duecourse.operators import drift as D
from duecourse.operators import economics as E
from duecourse.operators import metrics as M
from duecourse.operators import promotion as Pr
from duecourse.operators import scoring as S
from duecourse.operators import windows as Wn
from duecourse.operators.features import derived, engineer
from duecourse.plans.standin import standin_score
from duecourse.registry import STANDIN
from duecourse.session import stored

L = PRICES.lgd
# An estimated rate, with as many digits as one: products then never end in half a cent.
RATE = 0.673217
PRICED = E.Economics(RATE, PRICES.haircut)
CUT = 0.3
REFERENCE_ROWS = SETTINGS.monitoring.reference_sample
RULES = Monitoring(replay=SETTINGS.monitoring.replay, reference_sample=REFERENCE_ROWS)


def served(t):
    """Replay loans with a score, flags and a decision, as the scoring log would hold them."""
    scored = t.replay.withColumn("pd", standin_score())
    return S.decide_applications(scored, CUT, PRICED, "standin-1")


def reference(t):
    scored = t.reference_sample.withColumn("pd", standin_score())
    return scored.withColumn("decision", F.when(F.col("pd") >= CUT, "reject").otherwise("approve"))


MADE = {
    "fico_mid": "(fico_range_low + fico_range_high) / 2",
    "credit_history_months": "CAST((year(issue_d) - year(earliest_cr_line)) * 12 + month(issue_d) - month(earliest_cr_line) AS DOUBLE)",
    "loan_to_income": "loan_amnt / annual_inc",
    "revol_bal_to_income": "revol_bal / annual_inc",
}
SCORE_SQL = """(20 + CAST(floor(400 * coalesce(delinq_2yrs, 0) / coalesce(open_acc, 1)) AS BIGINT)
    + (id * 7919) % 300) / 1000.0::DOUBLE"""
FLAGS = [
    ("fico_below_660", "fico_range_low < 660"),
    ("credit_history_under_36_months", f"{MADE['credit_history_months']} < 36"),
    ("loan_to_income_above_0.5", "loan_amnt / annual_inc > 0.5"),
]
FLAG_TEXT = "concat_ws(',', " + ", ".join(f"CASE WHEN {w} THEN '{n}' END" for n, w in FLAGS) + ")"
add_view(
    "served",
    f"""SELECT *, CASE WHEN policy_flags <> '' THEN 'refer' WHEN pd >= {CUT} THEN 'reject' ELSE 'approve' END AS decision
        FROM (SELECT *, {SCORE_SQL} AS pd, {FLAG_TEXT} AS policy_flags FROM replay) q""",
    ["replay"],
)
add_view(
    "reference",
    f"""SELECT *, CASE WHEN pd >= {CUT} THEN 'reject' ELSE 'approve' END AS decision FROM (
          SELECT * FROM scored WHERE split = 'test' ORDER BY md5(CAST(id AS VARCHAR) || '-42'), id LIMIT {REFERENCE_ROWS}) q""",
    ["scored"],
)
NUMERIC = [*STANDIN.model_numeric, "pd"]


def long_sql(source: str, keep: str) -> str:
    parts = [
        f"SELECT {keep} '{c}' AS feature, CAST({MADE.get(c, c)} AS DOUBLE) AS value, NULL AS text FROM {source}"
        for c in NUMERIC
    ]
    parts += [f"SELECT {keep} '{c}', NULL, {c} FROM {source}" for c in STANDIN.categorical]
    return " UNION ALL ".join(parts)


EDGES = ", ".join(f"quantile_disc(value, {d})" for d in D.DECILES)
add_view("ref_long", long_sql("reference", ""), ["reference"])
add_view("cur_long", long_sql("served", "issue_d AS month,"), ["served"])
add_view(
    "edges",
    f"""SELECT feature, CASE WHEN count(DISTINCT value) > 20 THEN list_sort(list_distinct([{EDGES}])) END AS edges
        FROM ref_long GROUP BY feature""",
    ["ref_long"],
)
BIN = """CASE WHEN value IS NULL THEN text WHEN edges IS NULL THEN CAST(value AS VARCHAR)
         ELSE CAST(len(list_filter(edges, lambda e: e < value)) AS VARCHAR) END"""
add_view(
    "ref_bins",
    f"""SELECT feature, bin, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS share FROM (
          SELECT l.feature, {BIN} AS bin FROM ref_long l JOIN edges e ON l.feature = e.feature) q
        WHERE bin IS NOT NULL GROUP BY feature, bin""",
    ["ref_long", "edges"],
)
add_view(
    "cur_bins",
    f"""SELECT month, feature, bin, count(*) / sum(count(*)) OVER (PARTITION BY month, feature) AS share FROM (
          SELECT month, l.feature, {BIN} AS bin FROM cur_long l JOIN edges e ON l.feature = e.feature) q
        WHERE bin IS NOT NULL GROUP BY month, feature, bin""",
    ["cur_long", "edges"],
)
add_view(
    "psi",
    """SELECT month, feature, sum((c - r) * ln(c / r)) AS psi FROM (
         SELECT g.month, g.feature, CASE WHEN cb.share > 0 THEN cb.share ELSE 1e-4 END AS c,
                CASE WHEN rb.share > 0 THEN rb.share ELSE 1e-4 END AS r
         FROM (SELECT m.month, b.feature, b.bin FROM (SELECT DISTINCT month FROM cur_bins) m
                 CROSS JOIN (SELECT feature, bin FROM ref_bins UNION SELECT feature, bin FROM cur_bins) b) g
         LEFT JOIN cur_bins cb ON cb.month = g.month AND cb.feature = g.feature AND cb.bin = g.bin
         LEFT JOIN ref_bins rb ON rb.feature = g.feature AND rb.bin = g.bin
         WHERE cb.share IS NOT NULL OR rb.share IS NOT NULL) q GROUP BY month, feature""",
    ["cur_bins", "ref_bins"],
)
MISSING = "avg(CASE WHEN value IS NULL AND text IS NULL THEN 1.0 ELSE 0.0 END)"
add_view(
    "missing",
    f"""SELECT month, c.feature, c.rate AS missing_rate, abs(c.rate - r.rate) AS missing_change
        FROM (SELECT month, feature, {MISSING} AS rate FROM cur_long GROUP BY 1, 2) c
        JOIN (SELECT feature, {MISSING} AS rate FROM ref_long GROUP BY 1) r ON c.feature = r.feature""",
    ["cur_long", "ref_long"],
)
N_INPUTS = len(STANDIN.model_features)
add_view(
    "monthly",
    f"""SELECT s.month, loans, drifted_share, prediction_psi, mean_pd, reject_rate, refer_rate, missing_feature, missing_change FROM
        (SELECT month, round(count(*) FILTER (WHERE psi >= 0.1 AND feature <> 'pd') / {N_INPUTS}.0, 4) AS drifted_share,
                round(max(CASE WHEN feature = 'pd' THEN psi END), 4) AS prediction_psi FROM psi GROUP BY month) s
        JOIN (SELECT issue_d AS month, count(*) AS loans, round(avg(pd), 4) AS mean_pd,
                round(avg(CASE WHEN decision = 'reject' THEN 1.0 ELSE 0.0 END), 4) AS reject_rate,
                round(avg(CASE WHEN decision = 'refer' THEN 1.0 ELSE 0.0 END), 4) AS refer_rate FROM served GROUP BY 1) r
          ON s.month = r.month
        JOIN (SELECT month, feature AS missing_feature, round(missing_change, 4) AS missing_change FROM (
                SELECT *, row_number() OVER (PARTITION BY month ORDER BY missing_change DESC, feature) AS place
                FROM missing WHERE feature <> 'pd') w WHERE place = 1) m ON s.month = m.month""",
    ["psi", "served", "missing"],
)
ALERTS = """concat_ws('; ',
    CASE WHEN drifted_share >= 0.3 THEN CAST(CAST(round_even(drifted_share * 100, 0) AS INT) AS VARCHAR) || '% of model inputs drifted (PSI >= 0.1)' END,
    CASE WHEN prediction_psi >= 0.2 THEN 'prediction PSI ' || printf('%.3f', prediction_psi) || ' >= 0.2' END,
    CASE WHEN missing_change >= 0.1 THEN 'missing rate of ' || missing_feature || ' moved '
         || CAST(CAST(round_even(missing_change * 100, 0) AS INT) AS VARCHAR) || '%' END)"""
MONTH = "strftime(month, '%Y-%m') AS month"


def month_text(df):
    return df.withColumn("month", P.year_month(F.col("month")))


def seen(t):
    """The monitored rows as a narrow written table: bins and rates read it, not the raw loans."""
    return stored(D.monitored(served(t), STANDIN), "monitored")


def drift_table(t, rows=None):
    t.keep_clean()
    base = D.monitored(reference(t), STANDIN)
    edges = stored(D.reference_edges(base, STANDIN), "edges")
    counts = stored(D.bin_counts(rows or seen(t), edges, STANDIN, ["month"]), "bin-counts")
    return D.feature_drift(counts, D.sample_counts(base, edges, STANDIN))


def summary(t):
    t.keep_clean()
    rows = seen(t)
    return D.monthly_summary(drift_table(t, rows), D.decision_rates(rows), RULES)


@query(
    "d1_monitored_frame",
    "SELECT strftime(issue_d, '%Y-%m') AS month, pd, decision, " + ", ".join(
        f"round({MADE[c]}, 9) AS {c}" for c in MADE) + ", purpose FROM {served}",
)
def d1(t):
    rows = D.monitored(served(t), STANDIN)
    rounded = (F.round(c, 9).alias(c) for c in MADE)
    return month_text(rows.select("month", "pd", "decision", *rounded, "purpose"))


@query("d2_reference_sample", "SELECT id, pd, decision FROM {reference}")
def d2(t):
    return reference(t).select("id", "pd", "decision")


@query("d3_feature_psi", f"SELECT {MONTH}, feature, round(psi, 6) AS psi FROM {{psi}} WHERE feature <> 'pd'")
def d3(t):
    rows = drift_table(t).filter("feature <> 'pd'")
    return month_text(rows.select("month", "feature", F.round("psi", 6).alias("psi")))


@query("d4_prediction_psi", f"SELECT {MONTH}, round(psi, 6) AS psi FROM {{psi}} WHERE feature = 'pd'")
def d4(t):
    rows = drift_table(t).filter("feature = 'pd'")
    return month_text(rows.select("month", F.round("psi", 6).alias("psi")))


@query("d5_drifted_share", f"SELECT {MONTH}, drifted_share FROM {{monthly}}")
def d5(t):
    return month_text(summary(t).select("month", "drifted_share"))


TOP = f"""SELECT {MONTH}, string_agg(feature || '=' || printf('%.4f', psi), ',' ORDER BY place) AS top_drifted FROM (
    SELECT *, row_number() OVER (PARTITION BY month ORDER BY psi DESC, feature) AS place
    FROM {{psi}} WHERE feature <> 'pd' AND psi >= 0.1) q WHERE place <= 5 GROUP BY month"""


def top_drifted(t):
    shown = F.transform(
        "top_drifted", lambda d: F.concat(d["feature"], F.lit("="), F.format_string("%.4f", d["psi"]))
    )
    rows = summary(t).filter(F.size("top_drifted") > 0)
    return month_text(rows.select("month", F.array_join(shown, ",").alias("top_drifted")))


@query("d6_top_drifted", TOP)
def d6(t):
    return top_drifted(t)


@query(
    "w8_top_by_month",
    f"""SELECT {MONTH}, feature, place FROM (SELECT month, feature,
          row_number() OVER (PARTITION BY month ORDER BY round(psi, 9) DESC, feature) AS place FROM {{psi}} WHERE feature <> 'pd') q WHERE place <= 5""",
)
def w8(t):
    from pyspark.sql import Window as W

    # Rounded: features that are the same in a month tie, whatever the order of their sums.
    order = W.partitionBy("month").orderBy(F.round("psi", 9).desc(), "feature")
    rows = drift_table(t).filter("feature <> 'pd'").withColumn("place", F.row_number().over(order))
    return month_text(rows.filter("place <= 5").select("month", "feature", "place"))


@query(
    "d7_missing_change",
    f"""SELECT {MONTH}, feature, round(missing_rate, 6) AS missing_rate, round(missing_change, 6) AS missing_change
        FROM {{missing}} WHERE feature <> 'pd'""",
)
def d7(t):
    rows = drift_table(t).filter("feature <> 'pd'")
    rounded = (F.round(c, 6).alias(c) for c in ("missing_rate", "missing_change"))
    return month_text(rows.select("month", "feature", *rounded))


@query("w9_largest_missing_change", f"SELECT {MONTH}, missing_feature, missing_change FROM {{monthly}}")
def w9(t):
    return month_text(summary(t).select("month", "missing_feature", "missing_change"))


@query("d8_decision_rates", f"SELECT {MONTH}, loans, mean_pd, reject_rate, refer_rate FROM {{monthly}}")
def d8(t):
    return month_text(D.decision_rates(D.monitored(served(t), STANDIN)))


@query(
    "d9_monthly_summary",
    f"""SELECT {MONTH}, loans, drifted_share, prediction_psi, mean_pd, reject_rate, refer_rate,
               missing_feature, missing_change FROM {{monthly}}""",
)
def d9(t):
    return month_text(summary(t).drop("top_drifted", "alerts"))


@query("d10_alerts", f"SELECT {MONTH}, {ALERTS} AS alerts FROM {{monthly}}")
def d10(t):
    return month_text(summary(t).select("month", F.array_join("alerts", "; ").alias("alerts")))


@query(
    "d11_verdict",
    f"""SELECT strftime(month, '%Y-%m') AS latest_month, {ALERTS} <> '' AS drift_detected, 'standin-1' AS model_versions
        FROM {{monthly}} WHERE month = (SELECT max(month) FROM {{monthly}})""",
)
def d11(t):
    found = D.verdict(summary(t), served(t))
    return found.withColumn("model_versions", F.array_join("model_versions", ","))


@query("w10_latest_month", f"SELECT {MONTH}, loans FROM {{monthly}} WHERE month = (SELECT max(month) FROM {{monthly}})")
def w10(t):
    rates = D.decision_rates(D.monitored(served(t), STANDIN))
    latest = rates.agg(F.max_by(F.struct("month", "loans"), "month").alias("last"))
    return month_text(latest.select("last.month", "last.loans"))


@query(
    "d12_timeline",
    f"""SELECT {MONTH}, prediction_psi, reject_rate,
          (SELECT round(avg(CASE WHEN decision = 'reject' THEN 1.0 ELSE 0.0 END), 4) FROM {{reference}}) AS reference_reject_rate
        FROM {{monthly}}""",
)
def d12(t):
    return D.timeline(summary(t), reference(t))


@query("a17_decision_counts", "SELECT decision, count(*) AS n FROM {served} GROUP BY decision")
def a17(t):
    return served(t).groupBy("decision").agg(F.count("*").alias("n"))


# --- scoring -------------------------------------------------------------------------------
@query("x2_policy_flags", "SELECT id, policy_flags FROM {served}")
def x2(t):
    return served(t).select("id", F.array_join("policy_flags", ",").alias("policy_flags"))


@query("x3_decision", "SELECT id, decision FROM {served}")
def x3(t):
    return served(t).select("id", "decision")


@query("x4_expected_loss", f"SELECT id, round(pd * {RATE} * loan_amnt, 2) AS expected_loss FROM {{served}}")
def x4(t):
    return served(t).select("id", "expected_loss")


# A deterministic stand-in for contributions: distance from a fixed centre, in tenths.
PUSH = {
    "fico_mid": ("(720 - fico_mid) / 10", 720.0, -10.0),
    "loan_to_income": ("(loan_to_income - 0.2) * 10", 0.2, 0.1),
    "delinq_2yrs": ("(coalesce(delinq_2yrs, 9) - 1)", 1.0, 1.0),
    "mths_since_last_delinq": ("(coalesce(mths_since_last_delinq, 40) - 20) / 8", 20.0, 8.0),
    "tax_liens": ("(tax_liens - 1)", 1.0, 1.0),
}


def contributions():
    made = derived()
    return {
        "fico_mid": (720 - made["fico_mid"]) / 10,
        "loan_to_income": (made["loan_to_income"] - 0.2) * 10,
        "delinq_2yrs": F.coalesce(F.col("delinq_2yrs"), F.lit(9)) - 1,
        "mths_since_last_delinq": (F.coalesce(F.col("mths_since_last_delinq"), F.lit(40)) - 20) / 8,
        "tax_liens": F.col("tax_liens") - 1,
    }


FACTORS = " UNION ALL ".join(
    f"""SELECT id, '{n}' AS feature, {expr} AS push, {n} IS NULL AS absent FROM (
        SELECT *, {MADE['fico_mid']} AS fico_mid, loan_amnt / annual_inc AS loan_to_income FROM {{served}}) s"""
    for n, (expr, _, _) in PUSH.items()
)
LABEL_SQL = "CASE feature " + " ".join(
    f"WHEN '{n}' THEN '{REASON_LABELS.get(n, 'Tax liens')}'" for n in PUSH
) + " END"


@query(
    "x5_risk_factors",
    f"""SELECT id, string_agg({LABEL_SQL} || CASE WHEN absent THEN ' (not provided)' ELSE '' END || printf(' %.4f', push), '; ' ORDER BY place) AS factors
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY push DESC, feature) AS place FROM ({FACTORS}) f WHERE push > 0) q
        WHERE place <= 3 GROUP BY id""",
)
def x5(t):
    scored = t.replay.withColumn("pd", standin_score())
    decided = S.decide_applications(scored, CUT, PRICES, "standin-1", contributions())
    shown = F.transform(
        "risk_factors",
        lambda f: F.concat(f["description"], F.format_string(" %.4f", f["contribution"])),
    )
    rows = decided.filter(F.size("risk_factors") > 0)
    return rows.select("id", F.array_join(shown, "; ").alias("factors"))


@query(
    "x6_reason_labels",
    f"""SELECT feature, {LABEL_SQL} AS label, count(*) FILTER (WHERE push > 0) AS raised FROM ({FACTORS}) f GROUP BY feature""",
)
def x6(t):
    """Labels of the inputs, with how often each raised the risk."""
    pushes = t.replay.select(*(c.alias(n) for n, c in contributions().items()))
    raised = pushes.agg(*(F.count_if(F.col(n) > 0).alias(n) for n in PUSH))
    rows = raised.unpivot([], list(PUSH), "feature", "raised")
    return rows.select("feature", reason_label(F.col("feature")).alias("label"), "raised")


@query("x7_version_scores", f"SELECT id, pd, pd >= {CUT} AS reject FROM {{served}}")
def x7(t):
    scored = t.replay.select("id", standin_score().alias("pd"))
    return S.version_scores(scored, CUT)


@query(
    "x1_scored_applications",
    f"""SELECT id, pd, decision, round(pd * {RATE} * loan_amnt, 2) AS expected_loss, policy_flags, 'standin-1' AS model_version FROM {{served}}""",
)
def x1(t):
    """From JSON bodies through the request contract to results."""
    from duecourse.operators import requests as R

    read = R.read_requests(t.replay.select("id", R.request_json(STANDIN).alias("body")), STANDIN)
    typed = R.applications(read, STANDIN).drop("body")
    result = S.decide_applications(typed.withColumn("pd", standin_score()), CUT, PRICED, "standin-1")
    return result.select(
        "id", "pd", "decision", "expected_loss",
        F.array_join("policy_flags", ",").alias("policy_flags"), "model_version",
    )


# --- promotion -----------------------------------------------------------------------------
def version_rows(t):
    """Two versions of the score on the test loans: the second one shifted and with less noise."""
    test = Wn.assign_split(t.kept_scores, SETTINGS.splits).filter(F.col("split") == "test")
    other = F.col("pd") * 0.9 + 0.01
    return test.select(
        "id", "y", E.FUNDED, E.INTEREST,
        F.inline(
            F.array(
                F.struct(F.lit("1").alias("version"), F.col("pd"), (F.col("pd") >= 0.42).alias("reject")),
                F.struct(F.lit("2").alias("version"), other.alias("pd"), (other >= 0.39).alias("reject")),
            )
        ),
    )


add_view(
    "versions",
    """SELECT id, y, funded_cents, interest_cents, '1' AS version, pd, pd >= 0.42 AS reject FROM scored WHERE split = 'test'
       UNION ALL SELECT id, y, funded_cents, interest_cents, '2', pd * 0.9 + 0.01, pd * 0.9 + 0.01 >= 0.39 FROM scored WHERE split = 'test'""",
    ["scored"],
)
add_view(
    "evaluations",
    f"""SELECT a.version, a.cost, b.roc_auc, c.ece FROM
        (SELECT version, ({L} * sum(CASE WHEN NOT reject AND y = 1 THEN funded_cents ELSE 0 END)
            + {PRICES.haircut} * sum(CASE WHEN reject AND y = 0 THEN interest_cents ELSE 0 END)) / 100 AS cost FROM versions GROUP BY 1) a
        JOIN (SELECT version, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS roc_auc FROM (
                SELECT *, sum(neg) OVER (PARTITION BY version ORDER BY pd) - neg AS below FROM (
                  SELECT version, pd, sum(y) AS pos, sum(1 - y) AS neg FROM versions GROUP BY 1, 2) v) w GROUP BY 1) b ON a.version = b.version
        JOIN (SELECT version, sum(abs(mp - mo) * n) / sum(n) AS ece FROM (
                SELECT version, bin, avg(pd) AS mp, avg(y) AS mo, count(*) AS n FROM (
                  SELECT *, greatest(0, ((r - 1) * 10 + cnt - 2) // (cnt - 1) - 1) AS bin FROM (
                    SELECT *, row_number() OVER (PARTITION BY version ORDER BY pd, id) AS r,
                           count(*) OVER (PARTITION BY version) AS cnt FROM versions) x) y GROUP BY 1, 2) z GROUP BY 1) c ON a.version = c.version""",
    ["versions"],
)
LENIENT = PromotionRules(max_ece=0.9)


def evaluations(t):
    return Pr.evaluate_versions(version_rows(t), PRICES)


@query(
    "r1_version_evaluation",
    "SELECT version, round(cost, 2) AS cost, round(roc_auc, 5) AS roc_auc, round(ece, 5) AS ece FROM {evaluations}",
)
def r1(t):
    return evaluations(t).select(
        "version", F.round("cost", 2).alias("cost"), F.round("roc_auc", 5).alias("roc_auc"), F.round("ece", 5).alias("ece")
    )


DECIDE = """SELECT n.version AS challenger, o.version AS champion,
    CASE WHEN n.ece > {ece} THEN false WHEN n.roc_auc < o.roc_auc - 0.005 THEN false WHEN 1 - n.cost / o.cost < 0.001 THEN false ELSE true END AS promoted,
    CASE WHEN n.ece > {ece} THEN 'challenger ECE ' || printf('%.4f', n.ece) || ' exceeds {ece}'
         WHEN n.roc_auc < o.roc_auc - 0.005 THEN 'ROC-AUC dropped ' || printf('%.4f', o.roc_auc - n.roc_auc) || ' (max 0.005)'
         WHEN 1 - n.cost / o.cost < 0.001 THEN 'cost improvement ' || printf('%.3f', 100 * (1 - n.cost / o.cost)) || '% below 0.100%'
         ELSE 'cost ' || printf('%.3f', 100 * (1 - n.cost / o.cost)) || '% lower than champion v' || o.version END AS reason
  FROM (SELECT * FROM evaluations WHERE version = '2') n, (SELECT * FROM evaluations WHERE version = '1') o"""


def with_roles(t):
    role = F.when(F.col("version") == "2", "challenger").otherwise("champion")
    return evaluations(t).withColumn("role", role)


@query("r2_promotion_decision", DECIDE.replace("{ece}", "0.9").replace("FROM evaluations", "FROM {evaluations}"))
def r2(t):
    return Pr.decide(with_roles(t), LENIENT)


@query(
    "r3_prechecks",
    """SELECT split, '1' AS challenger, CASE WHEN split = 'train' THEN 'v1 was logged from uncommitted code'
         WHEN split = 'val' THEN 'v1 is not the expected model' ELSE 'v1 is already the champion' END AS blocked_by
       FROM (SELECT DISTINCT split FROM {scored}) q""",
)
def r3(t):
    """A version table per split, each blocked by another rule; fingerprints are the split's."""
    from duecourse.operators.ordering import union_all

    found = []
    for split in SETTINGS.splits:
        rows = Wn.assign_split(t.loans, SETTINGS.splits).filter(F.col("split") == split)
        mark = Pr.fingerprint(rows, ["id"]).select("content")
        version = mark.select(
            F.lit("1").alias("version"), (F.lit(split) == "train").alias("dirty"), F.col("content").alias("fingerprint")
        )
        table = version.withColumn("role", F.lit("challenger")).unionByName(version.withColumn("role", F.lit("champion")))
        expected = F.lit("other") if split == "val" else F.lit(None).cast("string")
        found.append(Pr.precheck(table, expected).select(F.lit(split).alias("split"), "challenger", "blocked_by"))
    return union_all(found)


@query(
    "r4_evaluation_table",
    """SELECT CASE WHEN version = '2' THEN 'challenger' ELSE 'champion' END AS role, version, round(cost) AS cost,
              round(roc_auc, 4) AS roc_auc, round(ece, 4) AS ece FROM {evaluations}""",
)
def r4(t):
    return with_roles(t).select(
        "role", "version", F.round("cost").alias("cost"), F.round("roc_auc", 4).alias("roc_auc"), F.round("ece", 4).alias("ece")
    )


@query(
    "r5_table_fingerprint",
    """WITH h AS (SELECT md5('{"id":' || coalesce('"' || CAST(id AS VARCHAR) || '"', 'null') || ',"purpose":'
                 || coalesce('"' || purpose || '"', 'null') || '}') AS m FROM {loans})
       SELECT count(*) AS rows, CAST(sum(CAST(('0x' || substr(m, 1, 16))::UBIGINT AS HUGEINT)) AS VARCHAR) || '-'
              || CAST(sum(CAST(('0x' || substr(m, 17, 16))::UBIGINT AS HUGEINT)) AS VARCHAR) AS content FROM h""",
)
def r5(t):
    return Pr.fingerprint(t.loans, ["id", "purpose"])


# --- evaluation of scored tables -----------------------------------------------------------
@query(
    "m6_test_evaluation",
    f"""SELECT round({L} * sum(CASE WHEN y = 1 THEN funded_cents ELSE 0 END) / 100) AS approve_all, count(*) AS loans,
         round(avg(y), 5) AS default_rate, round(avg((pd - y) * (pd - y)), 5) AS brier FROM {{scored}} WHERE split = 'test'""",
)
def m6(t):
    test = Wn.assign_split(t.scored, SETTINGS.splits).filter(F.col("split") == "test")
    return test.agg(
        F.round(E.decision_cost(F.lit(False), PRICES)).alias("approve_all"),
        F.count("*").alias("loans"),
        F.round(F.avg("y"), 5).alias("default_rate"),
        F.round(F.avg(F.pow(F.col("pd") - F.col("y"), F.lit(2))), 5).alias("brier"),
    )
