"""Connected components of a table of links, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duecourse.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a, b``, any orderable type); the root
    is the least node that can be reached. Each round is written to the shared folder; a path of n
    links takes about log2(n) rounds. A node with very many links is summed up before the shuffle."""
    edges = stored(
        links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
        .filter(F.col("a") != F.col("b")).distinct(),
        "edges",
    )
    roots = stored(
        edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
        .select("node", F.least("node", "b").alias("root")),
        "roots",
    )
    while True:
        near = (
            edges.join(roots.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        )
        hooked = stored(
            roots.join(near, "node").select(
                "node", F.least("root", "near").alias("root"), F.col("root").alias("was")
            ),
            "hooked",
        )
        above = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        roots = stored(
            hooked.join(above, "root").select("node", F.col("top").alias("root"), "was"), "roots"
        )
        if roots.filter(F.col("root") != F.col("was")).isEmpty():
            return roots.select("node", "root")
