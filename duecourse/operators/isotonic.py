"""Isotonic regression over any number of rows: pool-adjacent-violators by ranges of the score.

Rows are counted per distinct score and cut into ranges of about equal size. Each range pools on its
own; pooling blocks gives what pooling their rows gives, so only neighbouring ranges whose blocks at the
border are out of order are pooled again, together, until none are. What a range holds by then is a few
blocks. No range meets all rows, and the driver sees only which ranges must be joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duecourse.operators import ordering
from duecourse.session import forget, stored

BLOCK = "range_no int, low double, high double, total long, n long"


def _pooled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of one range in order, merged while a mean is not above the one before; whole numbers
    decide, so no rounding does."""
    for part in parts:
        blocks: list[list] = []
        for low, high, total, n in part.sort_values("low")[["low", "high", "total", "n"]].itertuples(index=False):
            blocks.append([low, high, int(total), int(n)])
            while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
                last = blocks.pop()
                blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
        made = pd.DataFrame(blocks, columns=["low", "high", "total", "n"])
        made.insert(0, "range_no", part["range_no"].iloc[0])
        yield made


def _pool(blocks: DataFrame) -> DataFrame:
    return stored(blocks.groupBy("range_no").applyInPandas(lambda part: next(_pooled(iter([part]))), BLOCK), "blocks")


def isotonic_blocks(df: DataFrame, score: str, label: str) -> DataFrame:
    """``range_no, low, high, total, n``: blocks of scores, ascending means ``total / n`` of 0/1 labels.

    Rows without a score or label are left out.
    """
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    values = stored(
        rows.groupBy(F.col(score).cast("double").alias("value")).agg(
            F.sum(F.col(label).cast("long")).alias("total"), F.count("*").alias("n")
        ).withColumn("key", F.lit(0)),
        "score-values",
    )
    ranges = ordering.range_count(values)
    shares = [i / ranges for i in range(1, ranges)]
    edges = values.groupBy("key").agg(F.percentile_approx("value", shares, 10 * ranges).alias("edges"))
    ranged = ordering.with_count_below(values.join(F.broadcast(edges), "key"), "range_no", "edges", "value", ranges)
    blocks = _pool(ranged.select("range_no", F.col("value").alias("low"), F.col("value").alias("high"), "total", "n"))
    forget(values)
    while True:
        ends = blocks.groupBy("range_no").agg(
            F.min_by(F.struct("total", "n"), "low").alias("first"), F.max_by(F.struct("total", "n"), "low").alias("last")
        ).orderBy("range_no").collect()  # a row a range
        joined, group = {}, None
        for before, own in zip([None, *ends], ends):
            if before and before["last"]["total"] * own["first"]["n"] >= own["first"]["total"] * before["last"]["n"]:
                joined[own["range_no"]] = group
            else:
                group = own["range_no"]
        if not joined:
            return blocks
        goes = F.create_map(*(F.lit(x) for pair in joined.items() for x in pair))
        moved = blocks.withColumn("range_no", F.coalesce(goes[F.col("range_no")], F.col("range_no")))
        changed = F.col("range_no").isin(sorted(set(joined.values())))
        again = _pool(moved.filter(changed))
        blocks, old = stored(moved.filter(~changed).unionByName(again), "blocks"), blocks
        forget(old, again)
