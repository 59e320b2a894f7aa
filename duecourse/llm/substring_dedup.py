"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of each text (it depends on the last 16 of them); a chunk ends
where its upper bits are zero, about every ``2 ** BITS`` bytes, so borders move with the content and
an insertion changes only the chunks it touches. Chunks are deduplicated by digest: the first
document that has one (by key) owns it, in other documents it is a repeat. Repeats that follow one
another make a span. A span of ``LEAST`` bytes or more is a repeated passage and can be cut out; the
chunks at its two ends that reach into other text are left. A passage of p bytes is found if its
whole chunks, all but some 80 bytes of it, come to ``LEAST``.

Chunks of runs that never end one (a sign repeated) end after ``LONGEST`` bytes, counted from the
last border.

Defined cases: null and empty texts have no chunks; rows with one key (all without one, too) are one
document, and a passage repeated inside one document only is no repeat; other columns come back as
they were; an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duecourse.llm.common import row_id, stored
from duecourse.llm.shingles import _BYTE, _powers, mixed, pieces

BITS = 5
LONGEST = 4096
LEAST = 100
NO_KEY = 2**63 - 1
ROLLED = 16
_GEAR = (mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def borders(data: np.ndarray, bits: int = BITS) -> np.ndarray:
    """True at the last byte of each chunk. The rolling sum over 16 bytes is made by doubling:
    a sum over 2k bytes is one over k plus the one before it, shifted by k."""
    rolled = _GEAR[data]
    for k in (1, 2, 4, 8):
        rolled[k:] = rolled[k:] + (rolled[:-k] << np.uint32(k))
    return (rolled >> np.uint32(32 - bits)) == 0


def chunked(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece of texts: text number within the piece, start and end (in bytes of the text),
    and two digests of every chunk, as a tuple of arrays per text batch."""
    base = 0
    for data, offsets in pieces(column):
        n = len(offsets) - 1
        if len(data):
            last = borders(data)
            last[offsets[1:][offsets[1:] > 0] - 1] = True
            # the first bytes of a text may not depend on the text before
            ends = np.flatnonzero(last) + 1
            firsts = np.flatnonzero(np.diff(offsets) > 0)
            for a, end in zip(offsets[firsts].tolist(), offsets[firsts + 1].tolist(), strict=True):
                ends = _own_start(ends, data, a, min(a + ROLLED, end), end)
            starts = np.concatenate([[0], ends[:-1]])
            starts, ends = _cut_long(starts, ends)
            place = np.arange(len(data)) - np.repeat(starts, ends - starts)
            powers = _powers(int(place.max()) + 1)
            values = _BYTE[data] * powers[place]
            raw = np.add.reduceat(values, starts)
            values = mixed(_BYTE[data] + np.uint64(977)) * powers[place]
            raw2 = np.add.reduceat(values, starts) + (ends - starts).astype(np.uint64)
            of = np.searchsorted(offsets, starts, side="right") - 1
            yield of + base, np.stack([starts - offsets[of], ends - offsets[of]]), np.stack([mixed(raw), mixed(raw2)])
        base += n


def _own_start(ends: np.ndarray, data: np.ndarray, a: int, b: int, end: int) -> np.ndarray:
    """Borders among the first bytes, up to ``b``, of the text that starts at ``a``, hashed anew."""
    i, j = np.searchsorted(ends, [a, b], side="right")
    own = np.flatnonzero(borders(data[a:b])) + 1 + a
    if b == end:
        own = np.union1d(own, [end])
    if len(own) == j - i and (own == ends[i:j]).all():
        return ends
    return np.concatenate([ends[:i], own, ends[j:]])


def _cut_long(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    long = np.flatnonzero(ends - starts > LONGEST)
    if len(long):
        more = np.concatenate([np.arange(starts[k] + LONGEST, ends[k], LONGEST) for k in long])
        ends = np.union1d(ends, more)
        starts = np.concatenate([[0], ends[:-1]])
    return starts, ends


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, th, no, a, b, c``: the chunks of every row, from byte ``a`` up to ``b``, with a digest.
    ``th`` is a hash of the text; a null key is the largest number."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, span, digests in chunked(batch.column(2)):
                first, rows = np.searchsorted(of, of), pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows),
                     pa.array((np.arange(len(of)) - first).astype(np.int32)), pa.array(span[0].astype(np.int32)),
                     pa.array(span[1].astype(np.int32)), pa.array(digests[0].view(np.int64))],
                    names=["key", "th", "no", "a", "b", "c"],
                )

    known = F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key")
    return docs.select(known, F.xxhash64(text).alias("th"), F.col(text).alias("text")).mapInArrow(
        cut, "key long, th long, no int, a int, b int, c long"
    )


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``key, th, a, b, first``: passages (bytes ``a`` up to ``b``) that a document with a smaller key
    has as well, and the key that owns the first chunk of them."""
    cut = stored(chunks(docs, key, text), "chunks")
    owned = (
        cut.groupBy("c").agg(F.min("key").alias("first"), F.max("key").alias("last"))
        .filter("first <> last").select("c", "first")
    )
    again = cut.join(owned, "c").filter(F.col("key") != F.col("first"))
    # Chunks of one text in order of place: a new span begins where a number is missing.
    order = Window.partitionBy("key", "th").orderBy("no")
    return stored(
        again.select("key", "th", "no", "a", "b", "first").distinct()
        .withColumn("run", F.col("no") - F.row_number().over(order))
        .groupBy("key", "th", "run")
        .agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min_by("first", "no").alias("first"))
        .filter(F.col("b") - F.col("a") >= least).select("key", "th", "a", "b", "first"),
        "repeats",
    )


def cut_out(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the passages found, with the columns they had."""
    doc = F.struct((F.col("key") == NO_KEY).alias("unknown"),
                   F.when(F.col("key") == NO_KEY, F.lit(0)).otherwise(F.col("key")).alias("key"), "th")
    spans = found.groupBy(doc.alias("doc")).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_id(key, text).alias("doc"))
    joined = whole.join(spans, "doc", "left")
    raw = F.encode(F.col("row")[text], "UTF-8")
    # Parts between the spans; each is cut in bytes and trimmed of a broken character at its ends.
    parts = F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["b"])),
        F.concat(F.transform("spans", lambda s: s["a"]), F.array(F.octet_length(raw))),
        lambda a, b: F.decode(F.substring(raw, a + 1, b - a), "UTF-8"),
    )
    kept = F.when(F.col("spans").isNull(), F.col("row")[text]).otherwise(F.array_join(parts, ""))
    return joined.select(*(kept.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))
