"""Monthly drift of served applications against a reference sample.

Everything follows from one small table, ``(month, feature, bin, n)``: missing values are counted
under a NULL bin, so missing rates, shares and the stability index (PSI) need no second pass. The
same table can be filled batch by batch from a stream and summed up on read.

The PSI used here: shares over non-missing values; a numeric feature with more than 20 distinct
reference values is cut at the reference deciles (outer bins open), any other feature has one bin
per value; an empty share counts as 1e-4.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duecourse.config import Monitoring
from duecourse.operators.features import engineer
from duecourse.operators.ordering import union_all
from duecourse.registry import EVENT_DATE, SCORE, Registry

FEW_VALUES = 20
# Values of a feature that are listed, counters of one aggregate, and codes of cells without a bin.
LISTED, COUNTERS = 64, 256
MISSING, UNSEEN = -1, -2
DECILES = [i / 10 for i in range(1, 10)]
EMPTY_SHARE = 1e-4
TOP_N = 5
MONTH = "month"


def monitored(frame: DataFrame, registry: Registry, keep: tuple[str, ...] = (SCORE, "decision")):
    """What the model saw and answered, by event month (not by log time)."""
    kept = tuple(c for c in keep if c in frame.columns)
    rows = engineer(frame, registry, (EVENT_DATE, *kept))
    return rows.withColumn(MONTH, F.trunc(EVENT_DATE, "MM")).drop(EVENT_DATE)


def _numeric(registry: Registry) -> list[str]:
    return [*registry.model_numeric, SCORE]


def _long(rows: DataFrame, registry: Registry, keep: list[str]) -> DataFrame:
    """``keep..., feature, value, text``: one row per feature; numbers in one column."""
    cells = [
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                 F.lit(None).cast("string").alias("text"))
        for c in _numeric(registry)
    ] + [
        F.struct(F.lit(c).alias("feature"), F.lit(None).cast("double").alias("value"),
                 F.col(c).alias("text"))
        for c in registry.categorical
    ]
    return rows.select(*keep, F.inline(F.array(*cells)))


def reference_edges(reference: DataFrame, registry: Registry) -> DataFrame:
    """``(feature, edges, known)``: decile edges, or NULL where every value is its own bin.

    The reference is a sample of fixed size, so exact percentiles per feature stay small. ``known`` lists
    the values of a feature that has few.
    """
    share = ", ".join(f"percentile_disc({d}) WITHIN GROUP (ORDER BY value)" for d in DECILES)
    per_feature = _long(reference, registry, []).groupBy("feature").agg(
        F.count_distinct("value").alias("n_values"),
        F.expr(f"array({share})").alias("edges"),
        F.array_sort(F.collect_set(F.coalesce(F.col("value").cast("string"), F.col("text")))).alias("known"),
    )
    many = F.col("n_values") > FEW_VALUES
    edges = F.when(many, F.array_sort(F.array_distinct("edges")))
    known = F.when(~many & (F.size("known") <= LISTED), F.col("known"))
    return per_feature.select("feature", edges.alias("edges"), known.alias("known"))


def sample_counts(rows: DataFrame, edges: DataFrame, registry: Registry) -> DataFrame:
    """``(feature, bin, n)`` of a small sample such as the reference: its cells are unfolded."""
    long = _long(rows, registry, []).join(F.broadcast(edges.drop("known")), "feature")
    number = F.col("value")
    passed = F.size(F.filter("edges", lambda edge: edge < number))
    bin_name = (
        F.when(number.isNotNull() & F.col("edges").isNotNull(), passed.cast("string"))
        .otherwise(F.coalesce(number.cast("string"), "text"))
    )
    return long.groupBy("feature", bin_name.alias("bin")).agg(F.count("*").alias("n"))


def bin_counts(rows: DataFrame, edges: DataFrame, registry: Registry, keep: list[str]) -> DataFrame:
    """``(keep..., feature, bin, n)``; a missing value has a NULL bin.

    Rows are not unfolded: one projection gives the bin numbers of a row, and the bins that the reference
    knows, a few hundred in all, are counters of one aggregate by ``keep``. Only values that the
    reference does not have, and features of very many values, are counted value by value.
    """

    def quoted(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    codes, bins, texts = [], [], []
    for at, row in enumerate(edges.collect()):  # a row a feature
        name = f"`{row['feature']}`"
        if row["edges"] is not None:
            passed = " + ".join(f"int(double({name}) > {edge!r}D)" for edge in row["edges"])
            code, known = f"coalesce({passed}, {MISSING})", [str(i) for i in range(len(row["edges"]) + 1)]
        else:
            text, known = name if row["feature"] in registry.categorical else f"string(double({name}))", row["known"] or []
            places = " ".join(f"WHEN {quoted(v)} THEN {k}" for k, v in enumerate(known))
            listed = f"CASE {text} {places} ELSE {UNSEEN} END" if known else str(UNSEEN)
            code = f"CASE WHEN {name} IS NULL THEN {MISSING} ELSE {listed} END"
            texts.append(f"IF({code} = {UNSEEN}, named_struct('feature', {quoted(row['feature'])}, 'bin', {text}), NULL)")
        codes.append(f"smallint({code}) AS bin_{at}")
        bins += [(row["feature"], at, k, label) for k, label in enumerate([None, *known], MISSING)]
    kept = [f"`{c}`" for c in keep]
    coded, parts = rows.selectExpr(*kept, *codes), []
    for start in range(0, len(bins), COUNTERS):
        part = bins[start : start + COUNTERS]
        counted = coded.groupBy(*keep).agg(
            *(F.expr(f"count(IF(bin_{at} = {k}, 1, NULL)) AS n_{i}") for i, (_, at, k, _) in enumerate(part))
        )
        cells = ", ".join(
            f"named_struct('feature', {quoted(name)}, 'bin', {'string(NULL)' if label is None else quoted(label)}, 'n', n_{i})"
            for i, (name, _, _, label) in enumerate(part)
        )
        parts.append(counted.selectExpr(*kept, f"inline(array({cells}))").filter("n > 0"))
    if texts:
        others = rows.selectExpr(*kept, f"array_compact(array({', '.join(texts)})) AS cells").filter("size(cells) > 0")
        parts.append(others.selectExpr(*kept, "inline(cells)").groupBy(*keep, "feature", "bin").agg(F.count("*").alias("n")))
    return union_all(parts)


def _shares(counts: DataFrame, keep: list[str]) -> DataFrame:
    """Totals are summed before the shuffle and joined back: a feature with a bin per row is then
    no single task, as it would be in a window."""
    key = [*keep, "feature"]
    totals = counts.groupBy(*key).agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("bin").isNotNull(), F.col("n"))).alias("present")
    )
    return counts.select(*key, "bin", "n").join(totals, key)


def _term(current: Column, reference: Column) -> Column:
    c = F.greatest(current, F.lit(EMPTY_SHARE))
    r = F.greatest(reference, F.lit(EMPTY_SHARE))
    c = F.when(current > 0, current).otherwise(c)
    r = F.when(reference > 0, reference).otherwise(r)
    return (c - r) * F.ln(c / r)


def feature_drift(current: DataFrame, reference: DataFrame) -> DataFrame:
    """``(month, feature, psi, missing_rate, missing_change)`` from two tables of bin counts.

    A reference bin that a month lacks adds a term of its own. Those are the terms of all
    reference bins, less the ones the month does have, so no grid of months and bins is built.
    """
    zero = F.lit(0.0)
    ref = _shares(reference, []).withColumn("ref_share", F.col("n") / F.col("present"))
    ref_bins = ref.filter("bin IS NOT NULL").select("feature", "bin", "ref_share")
    ref_whole = ref.groupBy("feature").agg(
        F.sum(F.when(F.col("bin").isNotNull(), _term(zero, F.col("ref_share")))).alias("all_absent"),
        (1 - F.max(F.coalesce("present", F.lit(0))) / F.max("rows")).alias("ref_missing"),
    )
    cur = _shares(current, [MONTH]).withColumn("share", F.col("n") / F.col("present"))
    joined = cur.join(ref_bins, ["feature", "bin"], "left")
    known = F.col("ref_share").isNotNull()
    own = F.when(
        F.col("bin").isNotNull(), _term(F.col("share"), F.coalesce("ref_share", zero))
    ).otherwise(0.0)
    instead = F.when(known, _term(zero, F.col("ref_share"))).otherwise(0.0)
    per_month = joined.groupBy(MONTH, "feature").agg(
        F.sum(own - instead).alias("own_terms"),
        (1 - F.max(F.coalesce("present", F.lit(0))) / F.max("rows")).alias("missing_rate"),
    )
    return per_month.join(ref_whole, "feature").select(
        MONTH,
        "feature",
        (F.col("own_terms") + F.coalesce("all_absent", zero)).alias("psi"),
        "missing_rate",
        F.abs(F.col("missing_rate") - F.col("ref_missing")).alias("missing_change"),
    )


def decision_rates(rows: DataFrame) -> DataFrame:
    """``(month, loans, mean_pd, reject_rate, refer_rate)``."""

    def rate(decision: str) -> Column:
        return F.round(F.avg((F.col("decision") == decision).cast("int")), 4)

    return rows.groupBy(MONTH).agg(
        F.count("*").alias("loans"),
        F.round(F.avg(SCORE), 4).alias("mean_pd"),
        rate("reject").alias("reject_rate"),
        rate("refer").alias("refer_rate"),
    )


def monthly_summary(drift: DataFrame, rates: DataFrame, p: Monitoring) -> DataFrame:
    """One row per month with drifted share, top features, prediction PSI and alerts.

    Both inputs hold a row per month (and feature), so nothing here grows with the data.
    """
    is_input = F.col("feature") != SCORE
    drifted = is_input & (F.col("psi") >= p.psi_threshold)
    # Rounded: features that are the same in a month tie, whatever the order of their sums.
    ranked = F.struct((-F.round("psi", 9)).alias("order"), "feature", F.round("psi", 4).alias("psi"))
    top = F.slice(F.array_sort(F.collect_list(F.when(drifted, ranked))), 1, TOP_N)
    most_missing = F.struct((-F.col("missing_change")).alias("order"), F.col("feature"))
    per_month = drift.groupBy(MONTH).agg(
        F.round(F.count_if(drifted) / F.count_if(is_input), 4).alias("drifted_share"),
        F.transform(top, lambda t: F.struct(t["feature"], t["psi"])).alias("top_drifted"),
        F.round(F.max(F.when(~is_input, F.col("psi"))), 4).alias("prediction_psi"),
        F.min_by(
            F.struct("feature", F.round("missing_change", 4).alias("change")),
            F.when(is_input, most_missing),
        ).alias("max_missing"),
    )
    joined = per_month.join(rates, MONTH)
    return joined.select(
        MONTH,
        "loans",
        "drifted_share",
        "top_drifted",
        "prediction_psi",
        "mean_pd",
        "reject_rate",
        "refer_rate",
        F.col("max_missing.feature").alias("missing_feature"),
        F.col("max_missing.change").alias("missing_change"),
        alerts(p).alias("alerts"),
    )


def alerts(p: Monitoring) -> Column:
    """Texts of the rules a month breaks; the figures are compared as rounded in the report."""

    def percent(value: Column) -> Column:
        return F.concat(F.bround(value * 100).cast("int").cast("string"), F.lit("%"))

    share, psi = F.col("drifted_share"), F.col("prediction_psi")
    change = F.col("max_missing.change")
    return F.array_compact(
        F.array(
            F.when(
                share >= p.drifted_share_alert,
                F.concat(percent(share), F.lit(f" of model inputs drifted (PSI >= {p.psi_threshold})")),
            ),
            F.when(
                psi >= p.prediction_psi_alert,
                F.concat(
                    F.lit("prediction PSI "),
                    F.format_string("%.3f", psi),
                    F.lit(f" >= {p.prediction_psi_alert}"),
                ),
            ),
            F.when(
                change >= p.missing_share_alert,
                F.concat(
                    F.lit("missing rate of "),
                    F.col("max_missing.feature"),
                    F.lit(" moved "),
                    percent(change),
                ),
            ),
        )
    )


def verdict(summary: DataFrame, served: DataFrame) -> DataFrame:
    """The latest month, whether it has alerts, and the model versions seen in the log."""
    versions = served.select("model_version").distinct().agg(
        F.array_sort(F.collect_list("model_version"))
    ).scalar()
    latest = F.struct(F.col(MONTH), (F.size("alerts") > 0).alias("drift_detected"))
    return summary.agg(F.max_by(latest, F.col(MONTH)).alias("latest")).select(
        F.date_format("latest.month", "yyyy-MM").alias("latest_month"),
        "latest.drift_detected",
        versions.alias("model_versions"),
    )


def timeline(summary: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows behind the drift chart."""
    base = reference.agg(F.round(F.avg((F.col("decision") == "reject").cast("int")), 4)).scalar()
    return summary.select(
        F.date_format(MONTH, "yyyy-MM").alias(MONTH),
        "prediction_psi",
        "reject_rate",
        base.alias("reference_reject_rate"),
    )
