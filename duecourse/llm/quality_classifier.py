"""Quality classification by co-training two views of a page.

The content view reads the words: hashed words and word beginnings, and how varied they are. The
page view knows what can be told without reading: source, language, length, lines and kinds of
characters. Both are ridge logistic regressions. In each round either view scores the unlabelled
pool and hands the pages it is surest of, in the proportion of the classes, to the other view as
labels. Afterwards both are calibrated on labelled pages that neither was fitted on, and a third
regression over the two calibrated views gives the score of every document.

Fitted on about ``LABELLED`` labelled documents at most (of those the caller lets it learn from, by
hashes of id and text; rows alike in both count once) and a pool of about ``POOL`` others at most;
every document is scored.

Defined cases: null texts, languages and sources are values like others; without labelled documents
of both classes every score is the share of good ones, or 0.5; a document with several labels
counts as bad if one says so; every row is answered once, also when rows repeat; columns that are
missing count as null; other columns play no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecourse.llm.common import example_texts, stored
from duecourse.llm.lettering import begun_words, logistic
from duecourse.llm.quality_rules import _CAPITAL, _DIGIT, _LOUD, _SPACE
from duecourse.llm.shingles import pieces

LABELLED = 3_000
POOL = 6_000
ROUNDS = 5
HANDED = 200
WORDS = 192
KINDS = 16


def content_view(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares of hashed words and beginnings in each text, roots taken, and their variety."""
    n = len(offsets) - 1
    of, feature = begun_words(data, offsets)
    bucket = (feature >> np.uint64(32)).astype(np.int64) % WORDS
    counts = np.bincount(of * WORDS + bucket, minlength=n * WORDS).reshape(n, WORDS).astype(float)
    total = counts.sum(axis=1)
    own = np.unique(np.stack([of.astype(np.uint64), feature]), axis=1)[0].astype(np.int64) if len(of) else of
    variety = np.bincount(own, minlength=n) / np.maximum(total, 1)
    return np.column_stack([
        np.sqrt(counts / np.maximum(total, 1)[:, None]) * 3, variety,
        variety < 0.2, variety < 0.4, variety > 0.95, total == 0,
    ])


def page_view(data: np.ndarray, offsets: np.ndarray, language: list, source: list) -> np.ndarray:
    """Hashed language and source, length, lines, and shares of kinds of characters."""
    n = len(offsets) - 1

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets]) if len(data) else np.zeros(n)

    size = np.maximum(np.diff(offsets), 1).astype(float)
    lines = per_text(data == 10) + 1.0
    named = np.zeros((n, 2 * KINDS))
    for k, (a, b) in enumerate(zip(language, source, strict=True)):
        named[k, _kind(a)] = named[k, KINDS + _kind(b)] = 1
    shares = [per_text(t[data]) / size for t in (_LOUD, _CAPITAL, _DIGIT, _SPACE)]
    steps = [shares[0] > 0.01, shares[0] > 0.04, shares[0] > 0.12, shares[1] > 0.1, shares[1] > 0.4, shares[2] > 0.05]
    return np.column_stack([
        named, np.log1p(np.diff(offsets)) / 8, np.log1p(lines) / 4, np.log(size / lines) / 8, np.stack(shares, axis=1) * 5,
        np.stack(steps, axis=1),
    ])


def _kind(value: str | None) -> int:
    return 0 if value is None else 1 + sum((i + 1) * b for i, b in enumerate(value.encode())) % (KINDS - 1)


@dataclass(frozen=True)
class Model:
    """Weights of both views, their calibrations (slope, constant), and of the combination."""

    content: np.ndarray
    page: np.ndarray
    calibrated: np.ndarray
    combined: np.ndarray

    def score(self, content: np.ndarray, page: np.ndarray) -> np.ndarray:
        z = self.combined[-1] + sum(
            w * (slope * _logit(x, v) + constant)
            for w, (slope, constant), x, v in zip(
                self.combined, self.calibrated, (content, page), (self.content, self.page), strict=False)
        )
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def cotrained(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, rounds: int = ROUNDS, handed: int = HANDED) -> Model:
    """The model from both views of the same pages; ``y`` is 1, 0, or -1 for unlabelled. Every
    fourth labelled page of each class is kept for calibration."""
    known = np.flatnonzero(y >= 0)
    held = np.concatenate([np.flatnonzero(y == c)[::4] for c in (0, 1)])
    fit = np.setdiff1d(known, held)
    if len(np.unique(y[fit])) < 2:
        fit = held = known
    good = float(np.mean(y[fit]))
    pool = np.flatnonzero(y < 0)
    told = [dict(zip(fit.tolist(), y[fit].tolist(), strict=True)) for _ in views]
    for k in range(rounds + 1):
        weights = []
        for x, labels in zip(views, told, strict=True):
            rows = np.fromiter(labels, dtype=np.int64)
            weights.append(logistic(x[rows], np.fromiter(labels.values(), dtype=float), ridge=2.0, steps=12))
        if k == rounds or not len(pool):
            break
        for i, (x, w) in enumerate(zip(views, weights, strict=True)):
            z, other = _logit(x[pool], w), told[1 - i]
            order = np.argsort(z, kind="stable")
            sure = [(order[::-1][: round(handed * good)], 1, z > 2), (order[: round(handed * (1 - good))], 0, z < -2)]
            for some, label, certain in sure:
                for p in pool[some[certain[some]]].tolist():
                    other.setdefault(p, label)
        used = np.array(sorted(set(told[0]) & set(told[1])), dtype=np.int64)
        pool = np.setdiff1d(pool, used)
    scale = [logistic(_logit(x[held], w)[:, None], y[held].astype(float), ridge=0.01) for x, w in zip(views, weights, strict=True)]
    both = np.column_stack([s[0] * _logit(x[held], w) + s[1] for x, w, s in zip(views, weights, scale, strict=True)])
    return Model(weights[0], weights[1], np.stack(scale), logistic(both, y[held].astype(float), ridge=0.1))


def _views(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Both views of the texts in column ``at``, piece by piece; language and source follow it."""
    base = 0
    for data, offsets in pieces(batch.column(at)):
        n = len(offsets) - 1
        yield base, n, content_view(data, offsets), page_view(
            data, offsets, batch.column(at + 1).slice(base, n).to_pylist(), batch.column(at + 2).slice(base, n).to_pylist()
        )
        base += n


def _read(docs: DataFrame, key: str, text: str) -> DataFrame:
    def named(c: str) -> Column:
        return F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text"), named("lang").alias("lang"), named("source").alias("source"))


def fitted(
    docs: DataFrame,
    labels: DataFrame,
    may_learn: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    labelled: int = LABELLED,
    pool: int = POOL,
) -> Model | float:
    """The model, or the share of good pages if there are not both classes to learn from.
    ``may_learn`` is a condition on the key column, named ``key``."""
    marked = (
        labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y"))
        .filter(F.col("key").isNotNull() & F.col("y").isNotNull() & may_learn)
        .groupBy("key").agg(F.min("y").alias("y"))
    )
    place = F.pmod(F.xxhash64("key"), F.lit(2**20))
    n, total = marked.count(), docs.count()
    chosen = stored(marked.filter(place < math.ceil(2**20 * min(1.0, labelled / max(n, 1)))), "examples")
    # The pool comes from the other end of the hash, and from documents without a label.
    rows = _read(docs, key, text).filter(may_learn)
    taken = rows.join(F.broadcast(chosen), "key")
    near = rows.filter(place >= math.floor(2**20 * (1 - min(1.0, pool / max(total, 1)))))
    free = near.join(marked.select("key"), "key", "left_anti").withColumn("y", F.lit(-1))

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, size, content, page in _views(batch, 2):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(base, size), batch.column(1).slice(base, size),
                     pa.array(list(content.astype(np.float32)), pa.list_(pa.float32())),
                     pa.array(list(page.astype(np.float32)), pa.list_(pa.float32()))],
                    names=["id", "y", "content", "page"],
                )

    columns = ["id", "y", "text", "lang", "source"]
    table = (
        example_texts(taken, labelled).select(*columns).unionByName(example_texts(free, pool).select(*columns))
        .mapInArrow(see, "id long, y int, content array<float>, page array<float>").toPandas().sort_values(["id", "y"])
    )
    y = table["y"].to_numpy(dtype=np.int64)
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return float((y == 1).sum() / max((y >= 0).sum(), 1)) if (y >= 0).any() else 0.5
    return cotrained(tuple(np.stack(table[c].to_numpy()).astype(float) for c in ("content", "page")), y)


def scored(docs: DataFrame, model: Model | float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score`` for every row: how likely its page is good."""
    rows = _read(docs, key, text)
    if isinstance(model, float):
        return rows.select("key", F.lit(model).alias("score"))
    told = docs.sparkSession.sparkContext.broadcast((model.content, model.page, model.calibrated, model.combined))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*told.value)
        for batch in batches:
            for base, n, content, page in _views(batch, 1):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(base, n), pa.array(own.score(content, page))], names=["key", "score"]
                )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(score, f"key {kind}, score double")
