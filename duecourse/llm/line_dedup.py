"""Line dedup by a deletion-neighbourhood join.

The lines of all documents are compared as sequences of words. A line is removed if an equal line
comes earlier (documents by id, lines by place), or if both have ``least`` words or more and an
earlier line is one word edit away: one word put in, taken out or exchanged. All variants of a line
with one word deleted are hashed; two lines within the bound have an equal variant (or one is a
variant of the other). Equal variants are joined, the edit distance of each pair is verified on the
words, and the earliest line stays.

* Which lines can have a neighbour at all is found first, without loss: of two lines one edit apart,
  the first or the last half of the words is equal. Lines that share a half with no other line have
  no variants made.
* Lines with an equal variant at an equal place are all within the bound of each other, so each is
  held against the earliest of them alone. A family of n such lines costs n comparisons.

Defined cases: a null text stays null; lines without words always stay; a text that loses all its
lines becomes empty; rows with equal id and text count as one and keep the same lines; the columns
of the input come back as they were, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duecourse.llm.common import WORD, hinted, row_id, stored, words

#: Lines with fewer words are removed only for an equal line.
LEAST = 8


def _lines(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """``doc, line_no, l1, l2, halves``: each line with words; two hashes stand for it, and
    ``halves`` are hashes of the halves that a line one edit away may share."""
    n, w = F.col("n"), F.col("w")
    # Lines one edit apart, the shorter of n words, agree in their first or last n div 2 words; n is
    # this line's length or one less.
    sizes = F.array_distinct(F.array(F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")))

    def half(side: int):
        return F.transform(sizes, lambda m: F.xxhash64(
            F.lit(side), m, F.array_join(F.slice(w, F.lit(1) if side == 0 else n - m + 1, m), " ")))

    halves = F.when(n < least, F.array().cast("array<bigint>")).otherwise(F.concat(half(0), half(1)))
    return (
        docs.select(row_id(key, text).alias("doc"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
        .filter(F.col("line").rlike(WORD))
        .select("doc", "line_no", words(F.col("line")).alias("w"))
        .withColumns({"n": F.size("w"), "line": F.array_join("w", " ")})
        .select("doc", "line_no", F.xxhash64("line").alias("l1"), F.xxhash64(F.lit(7), "line").alias("l2"), halves.alias("halves"))
    )


def _variants(lines: DataFrame) -> DataFrame:
    """``v, pos, id``: a hash of each line without its word at ``pos``, and one of the whole line at
    -1, each with its length. Hashes are exclusive ors over (place, word), so a line of n words takes
    n steps."""
    line = Window.partitionBy("id")
    upto = line.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    made = (
        lines.select("id", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))
        .select("id", "n", "pos", F.xxhash64("pos", "word").alias("here"),
                F.xxhash64(F.col("pos") - 1, "word").alias("moved"))
        .withColumns({
            "whole": F.bit_xor("here").over(line), "all_moved": F.bit_xor("moved").over(line),
            "here_upto": F.bit_xor("here").over(upto), "moved_upto": F.bit_xor("moved").over(upto),
        })
    )
    before = F.col("here_upto").bitwiseXOR(F.col("here"))
    after = F.col("all_moved").bitwiseXOR(F.col("moved_upto"))
    less = F.named_struct(F.lit("v"), F.xxhash64(before.bitwiseXOR(after), F.col("n") - 1), F.lit("pos"), F.col("pos"))
    entire = F.named_struct(F.lit("v"), F.xxhash64("whole", "n"), F.lit("pos"), F.lit(-1))
    both = F.when(F.col("pos") == 0, F.array(less, entire)).otherwise(F.array(less))
    return made.select(F.explode(both).alias("x"), "id").select("x.v", "x.pos", "id")


def _candidates(docs: DataFrame, lines: DataFrame, key: str, text: str) -> DataFrame:
    """``id, l1, l2, w``: the lines that share a half with another line; ids are in order of first
    places (ranges of places, numbered through within each)."""
    halves = lines.select("l1", "l2", "doc", "line_no", F.explode("halves").alias("half"))
    open_ = stored(
        halves.groupBy("half").agg(F.min("l1").alias("a"), F.max("l1").alias("b")).filter("a <> b").select("half"),
        "halves",
    )
    firsts = (
        halves.join(hinted(open_), "half", "left_semi")
        .groupBy("l1", "l2").agg(F.min(F.struct("doc", "line_no")).alias("first"))
    )
    wanted = stored(
        firsts.groupBy("first.doc").agg(F.sort_array(F.collect_list(F.struct("first.line_no", "l1", "l2"))).alias("wanted"))
        .withColumnRenamed("doc", "of"),
        "wanted",
    )
    numbers = F.transform("wanted", lambda x: x["line_no"])
    found = F.filter(F.split("text", "\n"), lambda _, i: F.array_contains(numbers, i))
    return stored(
        docs.select(row_id(key, text).alias("doc"), F.col(text).alias("text"))
        .join(hinted(wanted), F.col("doc") == F.col("of"))
        .select("doc", F.explode(F.zip_with("wanted", found, lambda x, line: F.named_struct(
            F.lit("line_no"), x["line_no"], F.lit("l1"), x["l1"], F.lit("l2"), x["l2"], F.lit("line"), line))).alias("x"))
        .select("x.l1", "x.l2", F.struct("doc", "x.line_no").alias("first"), words(F.col("x.line")).alias("w"))
        .repartitionByRange("first", "l1", "l2").dropDuplicates(["first", "l1", "l2"])
        .sortWithinPartitions("first", "l1", "l2")
        .select(F.monotonically_increasing_id().alias("id"), "l1", "l2", "w"),
        "candidates",
    )


def _near(docs: DataFrame, lines: DataFrame, key: str, text: str) -> DataFrame:
    """``l1, l2`` of the lines that have an earlier neighbour one word edit away."""
    lone = _candidates(docs, lines, key, text)
    variants = stored(_variants(lone.select("id", "w")), "variants")
    deleted, entire = variants.filter("pos >= 0"), variants.filter("pos < 0")
    swapped = deleted.groupBy("v", "pos").agg(F.min("id").alias("o"))
    exchanged = deleted.join(swapped, ["v", "pos"]).select("id", "o", "pos", F.lit(0).alias("kind"))
    taken_out = deleted.join(entire.select("v", F.col("id").alias("o")), "v").select("id", "o", "pos", F.lit(1).alias("kind"))
    longer = deleted.groupBy("v").agg(F.min(F.struct("id", "pos")).alias("best"))
    put_in = entire.join(longer, "v").select("id", F.col("best.id").alias("o"), F.col("best.pos").alias("pos"), F.lit(2).alias("kind"))
    pairs = exchanged.union(taken_out).union(put_in).filter(F.col("o") < F.col("id")).dropDuplicates(["id", "o", "kind"])
    mine = lone.select("id", "l1", "l2", "w")
    other = lone.select(F.col("id").alias("o"), F.col("w").alias("ow"))

    def without(w: str) -> Column:
        return F.concat(F.slice(w, F.lit(1), F.col("pos")), F.slice(w, F.col("pos") + 2, F.size(w)))

    differing = F.zip_with("w", "ow", lambda a, b: F.when(a.eqNullSafe(b), 0).otherwise(1))
    one_edit = (
        F.when(F.col("kind") == 0, (F.size("w") == F.size("ow"))
               & (F.size(F.filter(differing, lambda x: x == 1)) <= 1))
        .when(F.col("kind") == 1, without("w") == F.col("ow"))
        .otherwise(without("ow") == F.col("w"))
    )
    return stored(
        pairs.join(mine, "id").join(other, "o").filter(one_edit).select("l1", "l2").distinct(), "near"
    )


def deduplicated(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least: int = LEAST,
    removed: str | None = None,
) -> DataFrame:
    """``docs`` without the lines that an earlier line stands for; with the number of lines
    removed in a column ``removed`` if that is named."""
    lines = stored(_lines(docs, key, text, least), "lines")
    near = _near(docs, lines, key, text).withColumn("near", F.lit(True))
    places = lines.select("l1", "l2", "doc", "line_no")
    repeated = (
        places.groupBy("l1", "l2").agg(F.min(F.struct("doc", "line_no")).alias("first"), F.count("*").alias("n"))
        .join(near, ["l1", "l2"], "left")
        .filter("n > 1 or near").select("l1", "l2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    )
    drop = (
        places.join(repeated, ["l1", "l2"])
        .filter(F.col("near") | (F.struct("doc", "line_no") != F.col("first")))
        .groupBy("doc").agg(F.collect_set("line_no").alias("drop"))
    )
    parts = F.split(f"row.{text}", "\n")
    kept = F.when(F.col("drop").isNull(), F.col("row")[text]).otherwise(
        F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("drop", i)), "\n")
    )
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_id(key, text).alias("doc"))
    out = whole.join(drop, "doc", "left").select(
        *(kept.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns),
        *([F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias(removed)] if removed else []),
    )
    return out
