"""Exact self-join of texts on the Jaccard similarity of their word shingle sets.

Sets are related before they are compared:

* Texts with the same set are one class and take part once.
* A set's rarest ``n - ceil(t n) + 1`` shingles are its index entries (two sets that reach the
  threshold t share one of them). An entry's list is put in order of size and cut into blocks of
  like sizes and positions; a pair of blocks whose best case cannot reach the threshold is skipped
  without looking at its entries.
* Of each list one set is the leader. A component (at first each set by itself) is compared with the
  leader it meets in most lists. A set found similar takes over the leader's component: what the leader is linked
  to has been answered already. What is left to look at is the difference, pairs of a list that lie
  in different components, and those are all compared. So a group of n near copies costs n
  comparisons, not n squared, and no link between different components is missed.
* A candidate pair is first held to its sets' bitmaps, an exact upper bound of the overlap that is
  some thirty times smaller than the sets, then to the sets themselves.

Which shingles count as frequent (they come last in the order) is found on one in ``SAMPLE`` texts;
this decides the speed only. Any order gives the same links.

Defined cases: null and blank texts have empty sets and link with nothing; repeated rows are
answered alike; an empty table gives an empty result; other columns play no part, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duecourse.llm.common import hinted, row_id, stored
from duecourse.llm.components import components
from duecourse.llm.shingles import digest, shingle_sets

#: One text in so many is read to find frequent shingles.
SAMPLE = 16
#: Most shingles that are treated as frequent, 8 bytes each on every executor.
FREQUENT = 1_000_000
#: A frequent shingle's list is dealt into so many parts.
PARTS = 64
#: Times that components are compared with leaders before their differences are gone through.
ROUNDS = 2


def _frequent(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles of two or more sampled texts, only the most frequent ones if there are too many."""

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), width))
            of = np.repeat(np.asarray(batch.column(0)), [len(s) for s in sets])
            all_ = np.concatenate([*sets, np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(all_.view(np.int64)), pa.array(of)], names=["shingle", "of"]
            )

    found = stored(
        docs.select("th", "text").filter(F.pmod("th", F.lit(SAMPLE)) == 0)
        .mapInArrow(exploded, "shingle long, of long")
        .groupBy("shingle").agg(F.count("*").alias("n"), F.min("of").alias("a"), F.max("of").alias("b"))
        .filter("a <> b").select("shingle", F.floor(F.log2("n")).cast("int").alias("size")),
        "frequent",
    )
    # Counts by powers of two, the largest first, as long as they stay within the bound.
    least, kept = 64, 0
    for size, n in sorted(((r["size"], r["n"]) for r in found.groupBy("size").agg(F.count("*").alias("n")).collect()),
                          reverse=True):
        kept += n
        if kept > FREQUENT:
            break
        least = size
    rows = found.filter(F.col("size") >= least).select("shingle").toPandas()
    return np.sort(rows["shingle"].to_numpy(dtype=np.int64).view(np.uint64))


def _bitmap(s: np.ndarray) -> np.ndarray:
    """Which residues occur among a set's hashes: bits in 64-bit words, their number a power of two
    of at least two bits a hash."""
    bits = np.zeros(1 << max(6, (2 * len(s)).bit_length()), dtype=bool)
    bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.int64)


def _signed(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``key, th, n, d1, d2, cold, entries``: set size, digest and index entries of every row;
    the first ``cold`` entries are not frequent."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, width))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = frequent.value
        for batch in batches:
            sizes, ones, twos, colds, kept, maps = [], [], [], [], [], []
            for s in shingle_sets(batch.column(2), width):
                n = len(s)
                one, two = digest(s) if n else (0, 0)
                if n and len(hot):
                    at = np.searchsorted(hot, s)
                    is_hot = hot[np.minimum(at, len(hot) - 1)] == s
                    cold = s[~is_hot]
                    order = np.concatenate([cold, s[is_hot]])
                else:
                    cold = order = s
                entries = order[: n - -(-n * num // den) + 1] if n else order
                sizes.append(n)
                ones.append(one)
                twos.append(two)
                colds.append(min(len(cold), len(entries)))
                kept.append(entries)
                maps.append(_bitmap(s))
            offsets = np.concatenate([[0], np.cumsum([len(e) for e in kept])]).astype(np.int32)
            values = np.concatenate([*kept, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()),
                 pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(colds, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                 pa.array(maps, pa.list_(pa.int64()))],
                names=["key", "th", "n", "d1", "d2", "cold", "entries", "bits"],
            )

    schema = T.StructType([
        T.StructField("key", docs.schema["key"].dataType), T.StructField("th", T.LongType()),
        T.StructField("n", T.IntegerType()), T.StructField("d1", T.LongType()),
        T.StructField("d2", T.LongType()), T.StructField("cold", T.IntegerType()),
        T.StructField("entries", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType())),
    ])
    return stored(docs.select("key", "th", "text").mapInArrow(sign, schema), "signed")


def _reaches(overlap: Column, n: Column, m: Column, num: int, den: int) -> Column:
    """Can ``overlap`` common shingles of sets of n and m reach num / den of the union?"""
    return overlap * (num + den) >= (n + m).cast("long") * num


def _alike_in_size(n: Column, m: Column, num: int, den: int) -> Column:
    return F.least(n, m).cast("long") * den >= F.greatest(n, m).cast("long") * num


def _screened(pairs: DataFrame, single: DataFrame, num: int, den: int) -> DataFrame:
    """``pairs`` without those whose bitmaps prove too many shingles of one set to be missing in
    the other: a residue that only one of them has stands for at least one such shingle."""

    def side(name: str, mark: str) -> DataFrame:
        return single.select(F.col("d1").alias(name), F.col("n").alias("n" + mark), F.col("bits").alias("b" + mark))

    def halved(bits: str, other: str) -> Column:
        half = F.size(other)
        return F.when(F.size(bits) == half * 2, F.zip_with(
            F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda a, b: a.bitwiseOR(b)
        )).otherwise(F.col(bits))

    def alone(one: str, two: str) -> Column:
        only = F.zip_with(one, two, lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b))))
        return F.aggregate(only, F.lit(0), lambda total, k: total + k)

    most = F.least(F.col("n1") - alone("c1", "c2"), F.col("n2") - alone("c2", "c1"))
    return stored(
        pairs.join(side("x", "1"), "x").join(side("y", "2"), "y")
        .withColumns({"c1": halved("b1", "b2"), "c2": halved("b2", "b1")})
        .filter(_alike_in_size(F.col("n1"), F.col("n2"), num, den))
        .filter((F.size("c1") != F.size("c2")) | _reaches(most, F.col("n1"), F.col("n2"), num, den))
        .select("x", "y").distinct(),
        "screened",
    )


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (columns ``x, y``, first digests) that are similar, as links ``a, b``.
    Only the texts that take part are read into sets again."""
    wanted = pairs.select(F.col("x").alias("d1")).union(pairs.select(F.col("y").alias("d1"))).distinct()
    rows = stored(classes.join(wanted, "d1", "left_semi").select("th", "key"), "wanted")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(0), width))
            made = [digest(s) if len(s) else (0, 0) for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                names=["d1", "d2", "shingles"],
            )

    few = hinted(rows.withColumnsRenamed({"th": "rth", "key": "rkey"}))
    sets = stored(
        docs.join(few, (F.col("th") == F.col("rth")) & F.col("key").eqNullSafe(F.col("rkey")), "left_semi")
        .select("text").mapInArrow(again, "d1 long, d2 long, shingles array<long>"),
        "sets",
    ).dropDuplicates(["d1", "d2"])
    left = sets.select(F.col("d1").alias("x"), F.struct("d1", "d2").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("d1").alias("y"), F.struct("d1", "d2").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return stored(
        pairs.join(left, "x").join(right, "y")
        .filter(_reaches(common, F.size("sa"), F.size("sb"), num, den))
        .select("a", "b"),
        "links",
    )


def similar_groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 5,
    num: int = 75,
    den: int = 100,
) -> DataFrame:
    """``key, th, n, component, first`` for every row: hash of the text, size of its set, the least
    key in its component, and whether the row is the first of it; two texts are linked when
    den * intersection >= num * union."""
    docs = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    signed = _signed(docs, width, num, den)
    filled = signed.filter("n > 0")
    classes = stored(
        filled.groupBy("d1", "d2").agg(F.min(F.struct("th", "key")).alias("rep"), F.count("*").alias("rows"))
        .select("d1", "d2", "rep.th", "rep.key", "rows"),
        "classes",
    )
    # Of each class of equal sets one row goes on. Only classes with more rows need a look-up.
    many = hinted(stored(
        classes.filter("rows > 1").select(
            F.col("d1").alias("c1"), F.col("d2").alias("c2"), F.col("th").alias("cth"), F.col("key").alias("ckey")
        ), "many"))
    single = filled.join(many, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")), "left").filter(
        F.col("c1").isNull() | ((F.col("th") == F.col("cth")) & F.col("key").eqNullSafe(F.col("ckey")))
    )
    # An entry is three numbers: its list (a frequent shingle's list is dealt into parts), its set,
    # and size, place and part in one.
    part = F.when(F.col("pos") >= F.col("cold"), F.pmod("d1", F.lit(PARTS)) + 1).otherwise(0)
    entry = single.select("d1", "n", "cold", F.posexplode("entries").alias("pos", "token")).select(
        F.when(F.col("pos") >= F.col("cold"), F.xxhash64("token", part)).otherwise(F.col("token")).alias("list"), "d1",
        (F.shiftleft(F.col("n").cast("long"), 35) + F.shiftleft(F.col("pos").cast("long"), 7) + part).alias("about"),
        "token",
    )
    listed = Window.partitionBy("list")
    n, pos = F.shiftrightunsigned("about", 35), F.shiftrightunsigned("about", 7).bitwiseAND(F.lit((1 << 28) - 1))
    shared = stored(
        entry.select("list", "d1", "about", F.when(F.col("about").bitwiseAND(F.lit(127)) > 0, F.col("token")).alias("hot"))
        .withColumns({"low": F.min("d1").over(listed), "high": F.max("d1").over(listed)})
        .filter("hot is not null or low <> high")
        .select(F.coalesce("hot", "list").alias("token"), "d1", n.cast("int").alias("n"), pos.cast("int").alias("pos")),
        "entries",
    )
    # Of the sets of a list, one whose entries are nearly all shared with others leads: it stands in
    # the middle of its group, where an edited copy has entries of its own.
    share = shared.groupBy("d1").agg((F.count("*") / (F.max("n") + F.lit(1))).alias("share"))
    placed = stored(
        shared.join(share, "d1").select(
            "token", "d1", "n", "pos", F.struct(-F.col("share"), "n", "d1").alias("rank"), F.col("d1").alias("comp")
        ),
        "placed",
    )
    links = None
    for turn in range(ROUNDS):
        near = _led(placed, turn == 0, num, den)
        found = _verified(_screened(near, single, num, den), docs, classes, width, num, den)
        links = found if links is None else links.unionByName(found)
        if links.isEmpty():
            break
        known = components(links).select(F.col("node.d1").alias("known"), F.col("root.d1").alias("root"))
        placed = stored(
            shared.join(share, "d1").join(known.dropDuplicates(["known"]), F.col("d1") == F.col("known"), "left")
            .select("token", "d1", "n", "pos", F.struct(-F.col("share"), "n", "d1").alias("rank"),
                    F.coalesce("root", "d1").alias("comp")),
            "placed",
        )
    rest = _across(placed, num, den)
    if not rest.isEmpty():
        rest = _screened(rest, single, num, den)
        links = links.unionByName(_verified(rest, docs, classes, width, num, den))
    return _labelled(signed, links)


def _led(placed: DataFrame, alone: bool, num: int, den: int) -> DataFrame:
    """A pair ``x, y`` for each component that meets another one in a list: its best placed set there
    and the list's leader, for the leader it meets most often. ``alone``: each set is a component."""
    own = placed.select("token", "comp", "rank") if alone else (
        placed.groupBy("token", "comp").agg(F.min("rank").alias("rank"))
    )
    lead = own.groupBy("token").agg(F.min("rank").alias("lead"))
    return stored(
        own.join(lead, "token")
        .filter(F.col("rank") != F.col("lead"))
        .filter(_alike_in_size(F.col("rank.n"), F.col("lead.n"), num, den))
        .groupBy("comp", "rank", "lead").agg(F.count("*").alias("votes"))
        .groupBy("comp").agg(F.max_by(F.struct("rank", "lead"), F.struct("votes", -F.col("lead.n"), "lead.d1")).alias("best"))
        .select(F.col("best.rank.d1").alias("x"), F.col("best.lead.d1").alias("y")).filter("x <> y"),
        "pairs",
    )


def _across(placed: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``x, y`` of sets that share an entry, lie in different components, and may reach the
    threshold by sizes and positions. Of such a pair the smaller set has the first common shingle
    among its first ``n - ceil(2 t n / (1 + t)) + 1``; entries further on are only looked up by
    larger sets. Lists within one component, or without such an entry, are left out as a whole."""
    # 2 t n / (1 + t) = 2 num n / (num + den)
    indexed = F.col("pos") * (num + den) <= F.col("n").cast("long") * (den - num)
    open_ = placed.groupBy("token").agg(
        F.min("comp").alias("a"), F.max("comp").alias("b"), F.max(indexed).alias("some")
    ).filter("a <> b and some")
    rows = stored(
        placed.join(open_.select("token"), "token", "left_semi").select(
            "token", "d1", "n", "pos", "comp", indexed.alias("indexed"),
            F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))).cast("int").alias("band"),
            F.floor(F.log2(F.col("pos") + F.lit(1.0))).cast("int").alias("spot"),
        ),
        "open",
    )
    names = ("comp", "band", "spot")

    def side(mark: str) -> DataFrame:
        block = rows.filter("indexed" if mark == "1" else "true").groupBy("token", *names).agg(
            F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("pos")).alias("tail")
        )
        return block.select("token", *(F.col(c).alias(c + mark) for c in block.columns if c != "token"))

    best = F.least("tail1", "tail2")
    blocks = side("1").join(side("2"), "token").filter(
        (F.col("comp1") != F.col("comp2")) & (F.col("least1") <= F.col("most2"))
        & (F.col("most1").cast("long") * den >= F.col("least2").cast("long") * num)
        & _reaches(best, F.col("least1"), F.col("least2"), num, den)
    ).select("token", "comp1", "band1", "spot1", "comp2", "band2", "spot2")

    def members(mark: str) -> DataFrame:
        return rows.filter("indexed" if mark == "1" else "true").select(
            "token", *(F.col(c).alias(c + mark) for c in (*names, "d1", "n", "pos")))

    pairs = blocks.join(members("1"), ["token", "comp1", "band1", "spot1"]).join(
        members("2"), ["token", "comp2", "band2", "spot2"]
    )
    overlap = F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2"))
    return stored(
        pairs.filter((F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("d11") < F.col("d12"))))
        .filter(_alike_in_size(F.col("n1"), F.col("n2"), num, den)
                     & _reaches(overlap, F.col("n1"), F.col("n2"), num, den))
        .select(F.col("d11").alias("x"), F.col("d12").alias("y")).distinct(),
        "across",
    )


def _labelled(signed: DataFrame, links: DataFrame) -> DataFrame:
    rows = signed.select("key", "th", "n", F.when(F.col("n") > 0, F.struct("d1", "d2")).alias("set"))
    if not links.isEmpty():
        rows = rows.join(components(links).withColumnRenamed("node", "set"), "set", "left")
        rows = rows.withColumn("set", F.coalesce("root", "set")).drop("root")
    row = F.struct(F.col("key").isNull().alias("unknown"), "key", "th")
    least = rows.filter("n > 0").groupBy("set").agg(F.min("key").alias("least"), F.min(row).alias("top"))
    filled = F.col("n") > 0
    return rows.join(least, "set", "left").select(
        "key", "th", "n", F.when(filled, F.col("least")).otherwise(F.col("key")).alias("component"),
        F.when(filled, row == F.col("top")).otherwise(F.lit(True)).alias("first"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """``docs`` with one row of each group of similar texts: the first by key, null last. Texts
    without words all stay. The columns come back as they were."""
    rows = similar_groups(docs, key, text, **limits).select(
        F.struct(F.col("key").isNull().alias("unknown"),
                 F.coalesce(F.col("key").cast("long"), F.lit(0)).alias("key"), "th").alias("doc"), "n", "first")
    seen = rows.groupBy("doc").agg(F.first("first").alias("first"), F.count("*").alias("rows"), F.max("n").alias("n"))
    gone = stored(
        seen.filter("not first or (rows > 1 and n > 0)").select("doc", (F.col("first")).alias("again")), "gone"
    )
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_id(key, text).alias("doc"))
    kept = whole.join(hinted(gone), "doc", "left_anti").select("row.*")
    again = gone.filter("again")
    if again.isEmpty():
        return kept
    # Rows alike in key and text count as one.
    return kept.unionByName(
        whole.join(hinted(again), "doc", "left_semi").dropDuplicates(["doc"]).select("row.*")
    )
