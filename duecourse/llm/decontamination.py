"""Benchmark decontamination: SimHash windows of item size, multi-index Hamming blocks, exact check.

A document leaks an item if one of its windows, as long as the item, is similar to it: the weighted
Jaccard similarity of their five-word shingles (each weighing as often as it occurs) is at least
``num / den``. Looked at are the windows with so many shingles of items of their size, at whatever
places, that the similarity can be reached; a running count over their places finds these, and loses
nothing, since no item can have more in common with a window.

Each window and each item has a 64-bit SimHash of its words. Fingerprints are cut into
``RADIUS + 1`` blocks, so any two within the radius agree in a block; windows and items of a size
are joined on equal blocks, then held to the radius, then compared exactly. Half a radius covers
what a pair at the threshold differs in; the largest such differences lie within three standard
deviations of the radius.

Defined cases: letters A-Z count as a-z; a null or short text leaks nothing; items of fewer than
five words, or null, match nothing; a window at the edge of a text is moved inside, and is the whole
text if that is shorter than the item; rows alike in id and text are answered once; other columns
play no part; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecourse.llm.common import folded, hinted, row_id, stored, words

WIDTH = 5
RADIUS = 19


def _shingles(w: str, width: int) -> Column:
    """Shingle hashes in order of place; none for fewer words."""
    return F.when(
        F.size(w) >= width,
        F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width))),
    ).otherwise(F.array().cast("array<bigint>"))


def _bag(w: str, width: int) -> Column:
    """Shingles as text, the k-th occurrence of one marked k, so that sets stand for bags."""
    texts = F.transform(
        F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.array_join(F.slice(w, i, width), " ")
    )
    return F.when(
        F.size(w) >= width,
        F.transform(texts, lambda s, i: F.concat_ws(
            " ", s, F.size(F.filter(F.slice(texts, 1, i + 1), lambda x: x == s)).cast("string"))),
    ).otherwise(F.array().cast("array<string>"))


def simhash(hashes: Column) -> Column:
    """A 64-bit fingerprint: bit b is set if more than half of the hashes have it set."""
    out = F.lit(0).cast("long")
    for b in range(64):
        mask = F.shiftleft(F.lit(1).cast("long"), b)
        ones = F.size(F.filter(hashes, lambda x, m=mask: x.bitwiseAND(m) != 0))
        out = out.bitwiseOR(F.when(ones * 2 > F.size(hashes), mask).otherwise(F.lit(0).cast("long")))
    return out


def _blocks(fingerprint: str, radius: int) -> Column:
    """The fingerprint cut into ``radius + 1`` runs of bits, each with its number."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*(
        F.struct(
            F.lit(k).alias("block"),
            F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("bits"),
        )
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
    ))


def _starts(width: int) -> Column:
    """Starts of the windows of ``n`` words that hold ``need`` or more of the places ``at``, in order.
    Each belongs to the first place in its window, so none comes twice."""

    def first_at(j: Column) -> Column:
        low = F.greatest(
            F.get("at", j + F.col("need") - 1) - (F.col("n") - width), F.coalesce(F.get("at", j - 1), F.lit(-1)) + 1
        )
        high = F.least(F.get("at", j), F.greatest(F.lit(0), F.col("words") - F.col("n")))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), first_at))


def _printed(df: DataFrame, width: int) -> DataFrame:
    """With the fingerprint, and the bag, so that a pair only intersects."""
    hashed = df.withColumn("hashes", F.transform("w", lambda x: F.xxhash64(x)))
    return hashed.withColumns(
        {"print": simhash(F.col("hashes")), "bag": _bag("w", width)}).drop("hashes")


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    radius: int = RADIUS,
    num: int = 75,
    den: int = 100,
) -> DataFrame:
    """``doc, item_id, start, n_words, similarity, distance``: for each row and item it leaks the
    most similar window (the first, if several are). ``doc`` is the row as ``row_id`` names it."""
    items = stored(_printed(
        benchmark.select(F.col(item).alias("item_id"), words(folded(F.col(item_text))).alias("w"))
        .withColumn("n", F.size("w")).filter(F.col("n") >= width), width
    ), "items")
    seeds = stored(items.select("n", F.explode(_shingles("w", width)).alias("shingle")).distinct(), "seeds")
    hits = (
        docs.select(row_id(key, text).alias("doc"), words(folded(F.col(text))).alias("w"))
        .select("doc", F.size("w").alias("words"), F.posexplode(_shingles("w", width)).alias("p", "shingle"))
        .join(hinted(seeds), "shingle")
        .groupBy("doc", "n").agg(F.max("words").alias("words"), F.sort_array(F.collect_set("p")).alias("at"))
    )
    # common / (shingles of both - common) >= num / den
    both = F.least("words", "n") + F.col("n") - 2 * (width - 1)
    found = (
        hits.withColumn("need", F.greatest(F.lit(1), F.ceil(both * num / F.lit(num + den))).cast("int"))
        .filter(F.size("at") >= F.col("need"))
        .select("doc", F.struct("n", _starts(width).alias("starts")).alias("place")).filter(F.size("place.starts") > 0)
    )
    placed = stored(found.groupBy("doc").agg(F.collect_list("place").alias("places")), "windows")
    texts = docs.select(row_id(key, text).alias("of"), F.col(text).alias("text"))
    windows = stored(_printed(
        texts.join(hinted(placed), F.col("of") == F.col("doc"))
        .select("doc", words(folded(F.col("text"))).alias("all"), "places").dropDuplicates(["doc"])
        .select("doc", "all", F.explode("places").alias("place"))
        .select("doc", "all", "place.n", F.explode("place.starts").alias("start"))
        .select("doc", "n", "start", F.slice("all", F.col("start") + 1, F.col("n")).alias("w")), width
    ), "printed")

    def blocks(df: DataFrame, mark: str, *also: str) -> DataFrame:
        return df.select("n", F.col("print").alias("print" + mark), *also,
                         F.explode(_blocks("print", radius)).alias("b")).select(
            "n", "b.block", "b.bits", "print" + mark, *also)

    apart = F.bit_count(F.col("print1").bitwiseXOR(F.col("print2")))
    near = (
        blocks(windows, "1", "doc", "start").join(blocks(items, "2", "item_id"), ["n", "block", "bits"])
        .filter(apart <= radius)
        .select("doc", "start", "n", "item_id", apart.alias("distance")).distinct()
    )
    of_window = windows.select("doc", "start", "n", F.size("w").alias("n_words"), F.col("bag").alias("bag1"))
    of_item = items.select("item_id", "n", F.col("bag").alias("bag2")).dropDuplicates(["item_id", "n"])
    checked = (
        near.join(of_window, ["doc", "start", "n"]).join(of_item, ["item_id", "n"])
        .withColumns({
            "common": F.size(F.array_intersect("bag1", "bag2")), "both": F.size("bag1") + F.size("bag2"),
        })
        .filter(F.col("common") * (num + den) >= F.col("both") * num)
        .withColumn("similarity", F.col("common") / (F.col("both") - F.col("common")))
    )
    best = F.min_by(
        F.struct("start", "n_words", "similarity", "distance"),
        F.struct(-F.col("similarity"), F.col("start")),
    )
    return stored(checked.groupBy("doc", "item_id").agg(best.alias("best")).select("doc", "item_id", "best.*"), "leaks")


def clean(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item, with the columns they had."""
    hit = found.select("doc").distinct()
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_id(key, text).alias("doc"))
    return whole.join(hinted(stored(hit, "hit")), "doc", "left_anti").select("row.*")
