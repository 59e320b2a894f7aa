"""Ranks, running totals and quantiles over a total order, without sorting in one task.

A bare ``Window.orderBy`` moves every row to one task. Here rows are first counted per distinct
value (so a value shared by a third of the table becomes one row) and that table is stored, since
the later steps all read it. The distinct values are cut into ranges of about equal size by a
quantile sketch, and each range is ordered on its own. Range totals, at most one row per range and
key, carry the running totals across ranges.

``key`` names a text column with few values (a column name, a model version) whose groups are
ordered independently of each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duecourse.session import stored

HEAVY_SHARE = 256


def range_count(df: DataFrame) -> int:
    """Ranges per key: twice the shuffle width, so that it grows with the cluster's setting."""
    return max(64, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def literal_array(values) -> Column:
    """A constant array of doubles as one literal."""
    return F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})")


def count_up_to(edges: Column, value: Column, size: int) -> Column:
    """How many elements of a constant sorted array are <= value; binary search."""

    def advance(found: Column, half: Column) -> Column:
        hit = F.get(edges, found + half - 1) <= value
        return F.when(hit, found + half).otherwise(found)

    return F.aggregate(F.array(*map(F.lit, _halves(size))), F.lit(0), advance)


def with_count_below(df: DataFrame, name: str, edges: str, value: str, size: int) -> DataFrame:
    """Add how many elements of ``edges`` are < value.

    Each step of the binary search is an alias that the next one refers to, so all of it stays in
    generated code and the array is never copied per row, as it would be with a lambda.
    """
    steps, found = [], "0"
    for half in _halves(size):
        step = f"{name}_{half}"
        edge = f"get({edges}, {found} + {half - 1})"
        steps.append(F.expr(f"{found} + if({edge} < {value}, {half}, 0) AS {step}"))
        found = step
    kept = [F.col(c) for c in df.columns if c != edges]
    return df.select("*", *steps).select(*kept, F.col(found).alias(name))


def _halves(size: int) -> list[int]:
    return [1 << i for i in reversed(range(max(1, size).bit_length()))]


def distinct_values(df: DataFrame, value: str, key: str, **measures: Column) -> DataFrame:
    """One row per key and value with ``n`` and the given sums; NULL values are left out."""
    sums = {"n": F.count("*"), **measures}
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(key, value)
        .agg(*(column.alias(name) for name, column in sums.items()))
    )


def running_totals(values: DataFrame, value: str, key: str, measures: list[str]) -> DataFrame:
    """Add ``before_<m>`` (sum over smaller values of the key) and ``total_<m>`` to each row.

    ``values`` must hold one row per key and value.
    """
    values = stored(values, "values")
    ranges = range_count(values)
    shares = [i / ranges for i in range(1, ranges)]
    edges = values.groupBy(key).agg(
        F.percentile_approx(value, shares, 10 * ranges).alias("edges")
    )
    # One array of at most `ranges` numbers per key, so the broadcast cannot grow with the data.
    ranged = with_count_below(
        values.join(F.broadcast(edges), key), "range_no", "edges", value, ranges
    )
    across = W.partitionBy(key)
    earlier = across.orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(key, "range_no")
        .agg(*(F.sum(m).alias(m) for m in measures))
        .select(
            key,
            "range_no",
            *(F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"offset_{m}") for m in measures),
            *(F.sum(m).over(across).alias(f"total_{m}") for m in measures),
        )
    )
    inside = (
        W.partitionBy(key, "range_no").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    )
    # Again at most `ranges` rows per key.
    joined = ranged.join(F.broadcast(offsets), [key, "range_no"])
    return joined.withColumns(
        {
            f"before_{m}": F.col(f"offset_{m}") + F.coalesce(F.sum(m).over(inside), F.lit(0))
            for m in measures
        }
    ).drop("range_no", *(f"offset_{m}" for m in measures))


def value_ranks(df: DataFrame, value: str, key: str, **measures: Column) -> DataFrame:
    """Distinct values with their counts, running totals and average rank."""
    values = distinct_values(df, value, key, **measures)
    ranked = running_totals(values, value, key, ["n", *measures])
    return ranked.withColumn("average_rank", F.col("before_n") + (F.col("n") + 1) / 2)


def order_statistics(
    df: DataFrame, value: str, tie: str, key: str, places: list[Column]
) -> DataFrame:
    """The rows that stand at given places of the order by (value, tie): ``key, slot, value, tie``.

    ``places`` are 1-based ranks, written in terms of ``total_n``, the rows of the key. Only rows
    whose value holds a wanted place, and is shared, are ordered by ``tie``; those are again cut
    into ranges, so one very common value does not end up in one task.
    """
    ranked = running_totals(distinct_values(df, value, key), value, key, ["n"])

    def held(slot: int, place: Column) -> Column:
        here = (place > F.col("before_n")) & (place <= F.col("before_n") + F.col("n"))
        return F.when(here, F.struct(F.lit(slot).alias("slot"), place.alias("place")))

    wanted = (
        ranked.withColumn("held", F.array_compact(F.array(*map(held, range(len(places)), places))))
        .filter(F.size("held") > 0)
        .select(key, value, F.col("before_n").alias("smaller"), F.explode("held").alias("hit"))
        .select(
            key,
            value,
            F.col("hit.slot").alias("slot"),
            (F.col("hit.place") - F.col("smaller")).alias("place_in_tie"),
        )
    )
    tie_key = F.concat_ws("\x00", F.col(key), F.col(value).cast("string"))
    # At most one value per place and key, so the broadcast cannot grow with the data.
    tied = (
        df.join(F.broadcast(wanted.select(key, value).distinct()), [key, value], "left_semi")
        .withColumn("tie_key", tie_key)
    )
    in_tie = running_totals(distinct_values(tied, tie, "tie_key"), tie, "tie_key", ["n"])
    return (
        in_tie.join(F.broadcast(wanted.withColumn("tie_key", tie_key)), "tie_key")
        .filter(
            (F.col("place_in_tie") > F.col("before_n"))
            & (F.col("place_in_tie") <= F.col("before_n") + F.col("n"))
        )
        .select(key, "slot", value, tie)
    )


def row_places(df: DataFrame, value: str, tie: str, key: str) -> DataFrame:
    """Every row with a value, and its ``place`` from 1 in the order by (value, tie) of its key.

    A row's place is the number of smaller values of the key, which ranges give, and its place among
    the rows of its value. Rows of a value that few share are ordered together; a value held by more
    than 1/256 of the rows is cut into ranges of ``tie``, so that no task gets more than its range.
    """
    columns = df.columns
    ranked = stored(running_totals(distinct_values(df, value, key), value, key, ["n"]), "value-places")
    placed = stored(attach(df, ranked, [key, value]), "placed")
    heavy = F.col("n") * HEAVY_SHARE > F.col("total_n")
    inside = W.partitionBy(key, value).orderBy(tie)
    few = placed.filter(~heavy).withColumn("place", F.col("before_n") + F.row_number().over(inside))
    many = placed.filter(heavy).withColumn("tie_key", F.concat_ws("\x00", F.col(key), F.col(value).cast("string")))
    ties = running_totals(distinct_values(many, tie, "tie_key"), tie, "tie_key", ["n"])
    ties = ties.select("tie_key", tie, F.col("before_n").alias("before_tie"))
    alike = W.partitionBy("tie_key", tie).orderBy(value)
    cut = many.join(ties, ["tie_key", tie]).withColumn(
        "place", F.col("before_n") + F.col("before_tie") + F.row_number().over(alike)
    )
    return few.select(*columns, "place").unionByName(cut.select(*columns, "place"))


def percentiles(df: DataFrame, value: str, key: str, shares: list[float]) -> DataFrame:
    """Exact interpolated percentiles per key: ``key, p0, p1, ...`` in the order of ``shares``."""
    ranked = running_totals(distinct_values(df, value, key), value, key, ["n"])
    first, last = F.col("before_n"), F.col("before_n") + F.col("n") - 1

    def at(place: Column) -> Column:
        return F.max(F.when((place >= first) & (place <= last), F.col(value)))

    columns = []
    for i, share in enumerate(shares):
        place = F.lit(share) * (F.col("total_n") - 1)
        low = at(F.floor(place))
        weight = F.max(place - F.floor(place))
        columns.append((low + (at(F.ceil(place)) - low) * weight).alias(f"p{i}"))
    return ranked.groupBy(key).agg(*columns)


def attach(rows: DataFrame, lookup: DataFrame, on: list[str], count: str = "n") -> DataFrame:
    """Inner join to a lookup that has one row per ``on`` and says how many rows share it.

    Values held by more than 1/256 of the rows, of which there can be at most 256 per key, are
    broadcast; the others are joined by shuffle, where none of them is large.
    """
    heavy = F.col(count) * HEAVY_SHARE > F.col(f"total_{count}")
    common = F.broadcast(lookup.filter(heavy))
    rest = lookup.filter(~heavy)
    return rows.join(common, on).unionByName(
        rows.join(F.broadcast(lookup.filter(heavy).select(*on)), on, "left_anti").join(rest, on)
    )


def assign_bins(
    df: DataFrame, value: str, tie: str, bins: int, key: str | None = None
) -> DataFrame:
    """Equal-size bins on first-come ranks (ties broken by ``tie``): adds ``bin``, from 0.

    A rank r of n falls into bin ceil((r-1)*bins/(n-1)) - 1, the first one also taking r = 1, so
    bin b ends at rank floor((b+1)*(n-1)/bins) + 1. The rows at those ranks are the cut points.
    """
    frame = df if key else df.withColumn("all_rows", F.lit("all"))
    group = key or "all_rows"
    n = F.col("total_n")
    ends = [F.floor((b + 1) * (n - 1) / bins).cast("bigint") + 1 for b in range(bins - 1)]
    # One array of bins - 1 cut points per key.
    cuts = (
        order_statistics(frame, value, tie, group, ends)
        .groupBy(group)
        .agg(F.sort_array(F.collect_list(F.struct(F.col(value), F.col(tie)))).alias("cuts"))
    )
    row = F.struct(F.col(value), F.col(tie))
    passed = (
        F.coalesce((F.get("cuts", F.lit(b)) < row).cast("int"), F.lit(0)) for b in range(bins - 1)
    )
    binned = (
        frame.filter(F.col(value).isNotNull())
        .join(F.broadcast(cuts), group, "left")
        .withColumn("bin", sum(passed, F.lit(0)))
        .drop("cuts")
    )
    return binned if key else binned.drop("all_rows")


def first_by_hash(
    df: DataFrame, limit: int, seed: int, key: str, group: str | None = None
) -> DataFrame:
    """A repeatable sample: the ``limit`` rows (of each group) with the smallest hash of the key.

    Rows are counted per leading hash digits first, which tells the slice in which the limit
    falls. Only rows up to that slice are shuffled, by slice, so neither a group holding a third
    of the table nor a large limit puts many rows into one task. Groups are months (or one group
    for all rows), which is why the table of cut-offs is small.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    marked = df.withColumns({"hash": digest, "sample_group": F.col(group) if group else F.lit(0)})
    marked = marked.withColumn("slice", F.substring("hash", 1, 5))
    slices = marked.groupBy("sample_group", "slice").agg(F.count("*").alias("n"))
    before = (
        W.partitionBy("sample_group").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    )
    cutoff = (
        slices.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .filter((F.col("start") < limit) & (F.col("start") + F.col("n") >= limit))
        .select(
            "sample_group",
            F.col("slice").alias("last_slice"),
            (limit - F.col("start")).alias("rest"),
        )
    )
    order = W.partitionBy("sample_group", "slice").orderBy("hash", key)
    small_group = F.col("last_slice").isNull()
    return (
        marked.join(F.broadcast(cutoff), "sample_group", "left")
        .filter(small_group | (F.col("slice") <= F.col("last_slice")))
        .withColumn("place", F.row_number().over(order))
        .filter(
            small_group
            | (F.col("slice") < F.col("last_slice"))
            | (F.col("place") <= F.col("rest"))
        )
        .drop("hash", "slice", "last_slice", "rest", "sample_group", "place")
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
