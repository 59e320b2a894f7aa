"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and ``limit`` copies. Of all rates that give each source its
target of words, the ones wanted are those nearest to the middle rate ``limit / 2`` in bounded
relative entropy. The dual has one multiplier a source and is solved by Newton steps, each one
grouped sum over a histogram of sizes; the solution tilts every document exponentially,
``rate / (limit - rate) = exp(multiplier * u(size))`` with ``u(size) = 1 + ln(1 + size)``
(a document's divergence weighs ``size / u(size)``). Rates then become whole copies, bin by bin of
equal size, so that a source's words follow its target up to a fraction of one long document.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; rows
that are alike are separate documents; an empty table gives an empty mix; other columns of the
input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duecourse.llm.common import row_id, stored, word_count

WEIGHTS = (3.0, 1.0, 2.0)
#: Documents ranked together when the copies of a bin are dealt out.
SLICE = 4096
#: Starting points tried for the rounding of a source; the one nearest to the target is taken.
STARTS = 32


def sized(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per document: key, hash of the text, source and number of words."""
    return docs.select(
        F.col(key).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
    )


def targets(
    sizes: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    limit: float = 2.0,
) -> DataFrame:
    """``source, source_size, target``: words wanted of each source.

    Sources in code point order take the weights in turn. No target exceeds ``limit`` times its
    source; what is over goes to the others by weight, until nothing is.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Places of all sources without one task for them: ranges of sources, places within each.
    ranged = stored(
        totals.withColumn("last", F.col("source").isNull())
        .repartitionByRange(F.col("last"), F.col("source"))
        .withColumn("part", F.spark_partition_id()),
        "sources",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("part").agg(F.count("*").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    within = F.row_number().over(Window.partitionBy("part").orderBy("last", "source"))
    turn = (F.col("start") + within - 1) % len(weights)
    weighed = stored(
        ranged.join(starts, "part").select(
            "source", "source_size",
            F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).alias("weight"),
            (F.col("source_size") * F.lit(float(limit))).alias("most"),
        ),
        "weights",
    )
    level, capped = 0.0, -1
    while True:
        full = F.col("most") <= F.col("weight") * F.lit(level)
        found = weighed.agg(
            F.sum("source_size").alias("words"),
            F.count_if(full).alias("n"),
            F.sum(F.when(full, F.col("most"))).alias("taken"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
        ).first()
        if found["n"] == capped or found["words"] is None:
            break
        capped = found["n"]
        if found["weight"] is None:
            break
        level = (share * found["words"] - (found["taken"] or 0.0)) / found["weight"]
    return weighed.select(
        "source", "source_size", F.least(F.col("most"), F.col("weight") * F.lit(level)).alias("target")
    )


def _tilt(size: Column) -> Column:
    return F.lit(1.0) + F.log1p(size.cast("double"))


def multipliers(
    bins: DataFrame, goals: DataFrame, limit: float = 2.0, tolerance: float = 1e-9, steps: int = 60
) -> DataFrame:
    """``source, source_size, target, multiplier`` by distributed Newton steps.

    ``bins`` has ``source, size, n``. A step that leaves the bracket known so far is replaced by
    its middle, so the search cannot diverge. A source whose target is its upper end has a null
    multiplier: all its rates are ``limit``.
    """
    u, half = _tilt(F.col("size")), F.lit(limit / 2)
    words = F.col("n") * F.col("size")
    means = bins.groupBy(F.col("source").alias("of")).agg(F.try_divide(F.sum(words * u), F.sum(words)).alias("u"))
    share = F.try_divide(F.col("target"), F.col("source_size") * F.lit(float(limit)))
    free = (F.col("target") < F.col("source_size") * F.lit(float(limit))) & (F.col("target") > 0)
    state = stored(
        goals.filter(free)
        .join(means, F.col("source").eqNullSafe(F.col("of")), "left")
        .select(
            "source", "source_size", "target",
            F.try_divide(F.log(F.try_divide(share, 1 - share)), F.col("u")).alias("multiplier"),
            F.lit(-80.0).alias("low"), F.lit(80.0).alias("high"), F.lit(1.0).alias("gap"),
        ),
        "multipliers",
    )
    for _ in range(steps):
        at = bins.join(
            state.select(F.col("source").alias("of"), "multiplier"), F.col("source").eqNullSafe(F.col("of"))
        )
        # limit / (1 + exp(-x)) without overflow
        x = F.col("multiplier") * u
        part = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.abs(x)))
        odds = F.when(x >= 0, part).otherwise(1 - part)
        sums = at.groupBy("source").agg(
            F.sum(words * odds * F.lit(float(limit))).alias("words"),
            F.sum(words * u * odds * (1 - odds) * F.lit(float(limit))).alias("slope"),
        ).withColumnRenamed("source", "of")
        miss = F.col("words") - F.col("target")
        low = F.when(miss < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.col("multiplier") - F.try_divide(miss, F.col("slope"))
        inside = F.coalesce((newton > F.col("new_low")) & (newton < F.col("new_high")), F.lit(False))
        state = stored(
            state.join(sums, F.col("source").eqNullSafe(F.col("of")))
            .withColumns({"new_low": low, "new_high": high, "gap": F.try_divide(F.abs(miss), F.col("target"))})
            .withColumn(
                "multiplier",
                F.when(F.col("gap") <= tolerance, F.col("multiplier"))
                .when(inside, newton)
                .otherwise((F.col("new_low") + F.col("new_high")) / 2),
            )
            .select("source", "source_size", "target", "multiplier",
                    F.col("new_low").alias("low"), F.col("new_high").alias("high"), "gap"),
            "multipliers",
        )
        widest = state.agg(F.max("gap")).first()[0]
        if widest is None or widest <= tolerance:
            break
    return state.select("source", "source_size", "target", "multiplier").unionByName(
        goals.filter(~free | F.col("target").isNull()).withColumn("multiplier", F.lit(None).cast("double"))
    )


def mixed(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    limit: int = 2,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """``doc_id, th, source, size, source_size, target, rate, copies`` for every document; ``th`` is
    a hash of its text."""
    sizes = stored(sized(docs, text, key, source), "sizes")
    bins = stored(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "bins")
    goals = stored(multipliers(bins, targets(sizes, weights, share, limit), limit), "goals")
    x = F.col("multiplier") * _tilt(F.col("size"))
    part = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.abs(x)))
    rate = F.when(F.col("target") <= 0, F.lit(0.0)).when(F.col("multiplier").isNull(), F.lit(float(limit))).otherwise(
        F.when(x >= 0, part).otherwise(1 - part) * F.lit(float(limit))
    )
    # Expected copies run on from bin to bin of a source; a bin takes the whole numbers passed.
    # A window holds the distinct sizes of one source, never its documents.
    upto = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    rated = stored(
        bins.join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("rate", rate)
        .withColumn("upto", F.sum(F.col("n") * F.col("rate")).over(upto))
        .drop("of"),
        "rates",
    )

    def whole(start: Column) -> Column:
        return (F.floor(F.col("upto") + start + 1e-9)
                - F.floor(F.col("upto") - F.col("n") * F.col("rate") + start + 1e-9))

    tried = (
        rated.withColumn("start", F.explode(F.array(*(F.lit((2 * k + 1) / (2 * STARTS)) for k in range(STARTS)))))
        .groupBy("source", "start")
        .agg(F.abs(F.sum(whole(F.col("start")) * F.col("size")) - F.first("target")).alias("miss"))
        .groupBy(F.col("source").alias("of")).agg(F.min(F.struct("miss", "start"))["start"].alias("start"))
    )
    dealt = stored(
        rated.join(tried, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("copies", F.greatest(F.lit(0), F.least(whole(F.col("start")), F.col("n") * limit)))
        .select("source", "size", "n", "source_size", "target", "rate", F.col("copies").alias("bin_copies")),
        "dealt",
    )
    return _dealt_out(sizes, dealt)


def _dealt_out(sizes: DataFrame, dealt: DataFrame) -> DataFrame:
    """Copies of each document: those of its bin in equal parts, the rest by rank of a hash.
    A bin is ranked in slices, so a bin that holds a third of all rows is no single task."""
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size"))
    order = F.xxhash64("doc_id", "th")
    rows = sizes.join(
        dealt.withColumnsRenamed({"source": "of", "size": "of_size"}), same
    ).withColumn("slice", F.pmod(order, F.floor(F.col("n") / SLICE) + 1))
    of_bin = ["source", "size", "slice"]
    before = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.filter(F.col("n") >= SLICE).groupBy(*of_bin).agg(F.count("*").alias("in_slice"))
        .withColumn("earlier", F.coalesce(F.sum("in_slice").over(before), F.lit(0)))
        .select(F.col("source").alias("at"), F.col("size").alias("at_size"), F.col("slice").alias("at_slice"), "earlier")
    )
    here = (F.col("source").eqNullSafe(F.col("at")) & (F.col("size") == F.col("at_size"))
            & (F.col("slice") == F.col("at_slice")))
    place = F.row_number().over(Window.partitionBy(*of_bin).orderBy(order, "doc_id", "th"))
    return (
        rows.withColumn("place", place)
        .join(starts, here, "left")
        .withColumn("place", F.col("place") + F.coalesce(F.col("earlier"), F.lit(0)))
        .select(
            "doc_id", "th", "source", "size", "source_size", "target", "rate",
            (F.floor(F.col("bin_copies") / F.col("n"))
             + (F.col("place") <= F.col("bin_copies") % F.col("n")).cast("int")).cast("int").alias("copies"),
        )
    )


def repeated(
    docs: DataFrame, mix: DataFrame, key: str = "doc_id", text: str = "text", number: str = "copy"
) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as ``mix`` says, with the columns it had and
    the number of the copy. Rows alike in key and text share their copies."""
    of = mix.select(
        F.struct(F.col("doc_id").isNull().alias("unknown"),
                 F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("key"), "th").alias("doc"), "copies"
    ).groupBy("doc").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_id(key, text).alias("doc"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("doc"))
    own = F.floor(F.col("copies") / F.col("rows")) + (place <= F.col("copies") % F.col("rows")).cast("int")
    return (
        whole.join(of.filter("copies > 0"), "doc").withColumn("own", own).filter("own > 0")
        .select("row.*", F.explode(F.sequence(F.lit(1), F.col("own").cast("int"))).alias(number))
    )
