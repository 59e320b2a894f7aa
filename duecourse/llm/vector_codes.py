"""Vector codes by product quantisation: each vector is cut into ``POSITIONS`` equal parts, each part
is replaced by the nearest of ``ENTRIES`` codebook entries of its position.

Codebooks are fitted by Lloyd's rounds over all vectors in whole numbers (``floor(SCALE * x)``), so the
result does not depend on the order of sums. Parts live with their entry: rows are dealt by (position,
entry, salt) and written there. In a round every task compares its parts with the codebook and writes
those that keep their entry where they are; only those that change it are shuffled, to the tasks of their
new entry. The new entries come from what then lies there: sums a task, one small shuffle of those.
A salt, enough values of it that an entry that a third of all vectors share is many tasks, keeps hot
entries apart; it has nothing to do with the codes. A state is deleted once the next one is written.

Defined cases: a vector that is null or holds a null, a NaN or an infinity gives no row. Vectors of
other lengths count as followed by zeros up to the longest (and up to a multiple of ``POSITIONS``); an
empty vector is all zeros. Components whose whole number lies beyond 2^62 count as 2^62, and errors or
sums of them beyond the largest long are that long, or null for sums over labels. Rows alike count one
by one; with less than ``ENTRIES`` vectors there are as many entries; equal ids are ordered by vector,
null ids come last. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duecourse.llm.common import hinted, stored
from duecourse.session import forget

POSITIONS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Least number of salts, and the parts that a salt of one entry should not exceed.
SALTS, RESIDENTS = 64, 1_000_000
_BOUND = 2.0**62
_LONGEST = 2**63 - 1


def whole_vectors(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``vec_id, numbers, label`` of the usable vectors."""
    value = F.col("value")

    def usable(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    scaled = F.transform(
        value, lambda x: F.floor(F.greatest(F.lit(-_BOUND), F.least(F.lit(_BOUND), x.cast("double") * SCALE)))
    )
    return (
        vectors.select(F.col(key).alias("vec_id"), F.col(vector).alias("value"), F.col(label).alias("label"))
        .filter(value.isNotNull() & F.forall(value, usable))
        .select("vec_id", scaled.cast("array<long>").alias("numbers"), "label")
    )


def _part(width: int, position: int) -> Column:
    own = F.slice("numbers", position * width + 1, width)
    return F.concat(own, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(own)))


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry nearest to each part (the lowest of equals), and its squared distance; exact."""
    largest = max((int(np.abs(a).max()) for a in (parts, book) if a.size), default=0)
    most = 4 * largest * largest * max(parts.shape[1], 1)
    if most < 1 << 53:  # doubles hold all sums
        x, c = parts.astype(np.float64), book.astype(np.float64)
        squares = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    else:
        kind = np.int64 if most <= _LONGEST else object
        x, c = parts.astype(kind), book.astype(kind)
        squares = np.stack([((x - entry) ** 2).sum(1) for entry in c], axis=1)
    entry = squares.argmin(1)
    return entry, squares[np.arange(len(parts)), entry]


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _assigned(state: DataFrame, books: np.ndarray) -> DataFrame:
    """The state with the entry nearest now, and whether it is another one."""
    width = books.shape[2]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position = batch.column("position").to_numpy()
            parts = _matrix(batch.column("part"), width)
            entry = np.zeros(len(position), np.int32)
            for p in np.unique(position).tolist():
                own = position == p
                entry[own] = nearest(parts[own], books[p])[0]
            moved = entry != batch.column("entry").to_numpy()
            yield pa.record_batch(
                [batch.column("position"), pa.array(entry), batch.column("salt"), batch.column("part"), pa.array(moved)],
                names=["position", "entry", "salt", "part", "moved"],
            )

    return state.mapInArrow(assign, "position int, entry int, salt int, part array<long>, moved boolean")


def _updated(state: DataFrame, books: np.ndarray, kind: str) -> np.ndarray:
    """Each entry becomes the mean of its members, rounded down; without members it stays."""
    width = books.shape[2]
    sums = state.groupBy("position", "entry").agg(
        F.count("*").alias("n"), *(F.sum(F.get("part", F.lit(i)).cast(kind)).alias(f"s{i}") for i in range(width))
    )
    books = books.copy()
    for row in sums.collect():  # a row for each entry of the codebooks
        books[row["position"], row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(width)]
    return books


def fitted(vectors: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (position, entry, component) of the vectors that ``whole_vectors`` gives."""
    found = vectors.agg(
        F.count("*").alias("n"), F.max(F.size("numbers")).alias("length"),
        F.max(F.greatest(F.abs(F.array_max("numbers")), F.abs(F.array_min("numbers")))).alias("largest"),
    ).first()
    width = -(-(found["length"] or 0) // POSITIONS)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "numbers").limit(ENTRIES).collect()
    start = np.zeros((len(first), POSITIONS * width), np.int64)
    for i, row in enumerate(first):
        start[i, : len(row["numbers"])] = row["numbers"]
    books = start.reshape(len(first), POSITIONS, width).transpose(1, 0, 2)
    if not len(first) or not width:
        return books
    kind = "long" if found["largest"] < 1 << 31 else "decimal(38,0)"
    salts = max(SALTS, found["n"] // RESIDENTS)
    parts = F.array(*(_part(width, p) for p in range(POSITIONS)))
    salted = vectors.select("numbers", (F.monotonically_increasing_id() % salts).cast("int").alias("salt"))
    state = salted.select(F.posexplode(parts).alias("position", "part"), "salt").select(
        "position", F.lit(-1).alias("entry"), "salt", "part"
    )
    held: list[DataFrame] = []
    for _ in range(rounds):
        assigned = stored(_assigned(state, books), "assigned", ("moved",))
        arrived = stored(
            assigned.filter("moved").drop("moved").repartition("position", "entry", "salt")
            .sortWithinPartitions("position", "entry"), "arrived",
        )
        forget(*held)
        held = [assigned, arrived]
        state = assigned.filter("NOT moved").drop("moved").unionByName(arrived)
        books = _updated(state, books, kind)
    forget(*held)
    return books


def coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error``: the entry of each part, two hex digits each, and the squared
    distances to them, summed."""
    width = books.shape[2]
    label = vectors.schema["label"].dataType
    columns = [F.array(*(_part(width, p) for p in range(POSITIONS))).alias("parts")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            parts = batch.column("parts").flatten().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            parts = parts.reshape(n, POSITIONS, width)
            entries, errors = zip(*(nearest(parts[:, p], books[p]) for p in range(POSITIONS)))
            error = [min(int(sum(own)), _LONGEST) for own in zip(*(e.tolist() for e in errors))]
            code = [bytes(own).hex() for own in np.stack(entries, axis=1).astype(np.uint8)]
            yield pa.record_batch(
                [batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    schema = T.StructType([
        T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("label", label),
        T.StructField("code", T.StringType()), T.StructField("error", T.LongType()),
    ])
    return vectors.select("vec_id", "label", *columns).mapInArrow(encode, schema)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by position, entry and place, as decimal numbers with commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error, label_error`` for each usable vector (``label_error`` sums the
    errors of its label), and the codebooks."""
    usable = whole_vectors(vectors, key, vector, label)
    books = fitted(usable, rounds)
    rows = stored(coded(usable, books), "codes")
    by_label = stored(rows.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")), "label-errors")
    return rows.join(hinted(by_label), F.col("label").eqNullSafe(F.col("of"))).drop("of"), books
