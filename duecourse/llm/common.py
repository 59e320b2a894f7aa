"""What the operators of this subpackage share: words, folds, stored steps, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duecourse.session import stored

__all__ = ["WORD", "words", "word_count", "learnable", "held_out", "table", "stored", "hinted", "folded", "example_texts"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that may be sent to every executor; 16 to 48 bytes a row here.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """The words in order; none for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def folded(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model learns from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """True where a model may learn; a row without an id is in neither part."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hinted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table with a broadcast hint if it has at most ``rows`` rows; else as it is, so
    that the join shuffles both sides."""
    return F.broadcast(df) if df.count() <= rows else df


def example_texts(rows: DataFrame, most: int) -> DataFrame:
    """``id, y, text`` and the other columns of ``rows`` (``key, y, text, ...``): one row for each
    different key and text, and about ``most`` at most, chosen by a hash of both.

    A key may hold a third of all rows. Repeated rows are reduced in each task before they are
    shuffled, and what a driver may fetch is bounded by rows, not by keys.
    """
    rows = rows.withColumn("id", F.xxhash64("key", "text")).drop("key")
    n = rows.select("id").distinct().count()
    if n > most:
        rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(2**20)) < int(2**20 * most / n))
    return rows.dropDuplicates(["id"])


def row_id(key: str, text: str) -> Column:
    """What tells one row from another and orders rows: by key, null last, then by a hash of the
    text. Nothing in it is null, so it can be joined on. Rows alike in both count as one row."""
    # Named so, not by aliases: beside a generator Spark drops the aliases inside a struct.
    return F.named_struct(
        F.lit("unknown"), F.col(key).isNull(),
        F.lit("key"), F.coalesce(F.col(key).cast("long"), F.lit(0)),
        F.lit("th"), F.xxhash64(text),
    )
