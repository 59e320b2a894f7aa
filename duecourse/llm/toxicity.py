"""Toxicity by noisy-channel deobfuscation.

A character model of the corpus (trigram counts over the letters of all texts) says how likely a
spelling is. Where a text looks tampered with (signs or digits inside words, letters three times in
a row, single letters spaced out) the characters become a lattice: each may stand for the letters
it looks like, for nothing (separators, signs), or for a repetition of the one before; a separator
may also end a word. The Viterbi path of least cost, model and channel together, is the restored word,
or several. A logistic regression over
words and word beginnings of the text and its restored words gives the score.

The model of spellings counts all texts. The regression is fitted on the labelled texts of all documents
that the caller lets it learn from (rows alike in id and text count once); its features are
the ``FEATURES`` that differ most between the classes there, by ``SIGNIFICANT`` deviations at least.

Defined cases: null and empty texts get the score of a text without any known feature; a document
with several labels counts as toxic if one of them says so; a null label or id is not learned from;
without labelled documents of both classes every score is the share of toxic ones, or 0; every row
gets one answer, also when rows repeat; other columns play no part, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecourse.llm.common import hinted, stored
from duecourse.llm.lettering import Weights, features_of
from duecourse.llm.shingles import pieces

FEATURES = 600
#: Standard deviations that a feature's shares in the two classes must lie apart.
SIGNIFICANT = 4.0
RIDGE = 0.1
#: Symbols of the spelling model: 0 outside words, 1 to 26 a to z, 27 any other letter.
SYMBOLS = 28
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[65:91] = _SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = 27

# The letters that a sign or digit is written for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c", "<": "c", "£": "l", "¥": "y",
}
_L = r"[^\W\d_]"
_SIGN = r"[0-9@$!|+€(<£¥]"
_TAMPERED = re.compile(
    rf"{_SIGN}{_L}|{_L}[0-9@$|+€]|({_L})\1\1|(?<!\S)(?:(?:{_L}|{_SIGN})[ .\-_*]){{2,}}(?:{_L}|{_SIGN})(?!\w)"
)
#: Between single letters these stand for nothing or for a word's end.
SEPARATORS = " .-_*"
#: Costs of the channel, as negative natural logarithms.
LOOK, SKIP_REPEAT, KEEP_REPEAT = 1.0, 0.5, 2.0


def skip_cost(char: str) -> float:
    """Of a character that is no letter standing for nothing: dear for digits and the like inside
    words, cheap for signs, least for separators."""
    if char not in LOOKS_LIKE:
        return 0.2
    return 2.5 if char in "!|+(<" else 8.0


def spelling_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``gram, n``: letter trigrams of all texts, words set off by one symbol."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for data, offsets in pieces(batch.column(0)):
                if not len(data):
                    continue
                s = _SYMBOL[data]
                s = np.insert(s, offsets[1:-1], 0)  # texts do not run into each other
                s = np.concatenate([[0, 0], s, [0, 0]])
                s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
                # of a letter in several bytes one is left
                s = s[np.concatenate([[True], (s[1:] != 27) | (s[:-1] != 27)])]
                s = np.concatenate([[0], s])
                grams = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
                total += np.bincount(grams, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    return (
        docs.select(text).mapInArrow(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    )


@dataclass(frozen=True)
class Spelling:
    """Costs (negative log probabilities) of a symbol after two others."""

    costs: list[float]

    @classmethod
    def learned(cls, docs: DataFrame, text: str = "text") -> Spelling:
        """The counts have SYMBOLS ** 3 rows at most, whatever the corpus."""
        rows = spelling_counts(docs, text).toPandas()
        n = np.zeros(SYMBOLS**3)
        n[rows["gram"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=float)
        n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        pair = n.sum(axis=0) + 0.5
        back = pair / pair.sum(axis=1, keepdims=True)
        p = (n + 5.0 * back[None]) / (n.sum(axis=2, keepdims=True) + 5.0)
        return cls((-np.log(p)).ravel().tolist())

    def restored(self, written: str) -> str:
        """The letters that ``written`` most likely stands for, words set apart by one space."""
        costs, paths, last = self.costs, {0: (0.0, "")}, ""
        for char in written.lower():
            code = ord(char) - 96
            if char.isalpha():
                reads = [(char, code if 0 < code < 27 else 27, 0.0)]
                skip = SKIP_REPEAT if char == last else None
                if char == last:
                    reads = [(char, reads[0][1], KEEP_REPEAT)]
            else:
                reads = [(c, ord(c) - 96, LOOK) for c in LOOKS_LIKE.get(char, "")]
                skip = skip_cost(char)
            ends = char in SEPARATORS
            last = char
            after: dict[int, tuple[float, str]] = {}
            for state, (cost, out) in paths.items():
                if skip is not None and (state not in after or cost + skip < after[state][0]):
                    after[state] = (cost + skip, out)
                if ends and state % SYMBOLS:
                    total, to = cost + costs[state * SYMBOLS], state % SYMBOLS * SYMBOLS
                    if to not in after or total < after[to][0]:
                        after[to] = (total, out + " ")
                for letter, symbol, price in reads:
                    total = cost + price + costs[state * SYMBOLS + symbol]
                    to = state % SYMBOLS * SYMBOLS + symbol
                    if to not in after or total < after[to][0]:
                        after[to] = (total, out + letter)
            paths = after
        # a path that has just ended a word does not end it again
        return min(
            (cost + (0.0 if state and not state % SYMBOLS else costs[state * SYMBOLS]), out)
            for state, (cost, out) in paths.items()
        )[1].strip()


def restored_words(text: str | None, spelling: Spelling, known: dict[str, str]) -> str:
    """The restored forms of all tampered words of a text, in order, set apart by spaces."""
    if not text:
        return ""
    out, done = [], 0
    for m in _TAMPERED.finditer(text):
        if m.start() < done:
            continue
        a, b = m.span()
        while a > done and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        done, written = b, text[a:b]
        if written not in known:
            if len(known) >= 50_000:
                known.clear()
            known[written] = " ".join(_read(part, spelling) for part in re.split(r"[^\S ]+", written))
        out.append(known[written])
    return " ".join(out)


def _read(written: str, spelling: Spelling) -> str:
    """Long strings (keys, links) are read in parts, so that paths stay short. Parts overlap, so that
    a word of up to 32 letters is whole in one of them."""
    if " " in written:
        parts = [written[a : a + 256] for a in range(0, max(1, len(written) - 64), 192)]
    else:
        parts = [written[a : a + 64] for a in range(0, max(1, len(written) - 32), 32)]
    return " ".join(_with_joins(spelling.restored(p)) for p in parts)


def _with_joins(read: str) -> str:
    """Of several words also each two neighbours as one, and all: a word like "i" at the front of
    another can be taken off it wrongly."""
    w = read.split()
    if len(w) < 2:
        return read
    joined = ["".join(w)] if len(w) > 2 else []
    return " ".join([*w, *map("".join, zip(w, w[1:], strict=False)), *joined])


@dataclass(frozen=True)
class Model:
    spelling: Spelling
    features: np.ndarray
    weights: np.ndarray
    constant: float


def _repaired(column: pa.Array, spelling: Spelling, known: dict[str, str]) -> pa.Array:
    return pa.array([restored_words(t, spelling, known) for t in column.to_pylist()], pa.large_string())


def fitted(
    docs: DataFrame,
    labels: DataFrame,
    may_learn: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    features: int = FEATURES,
) -> Model:
    """The model. ``may_learn`` is a condition on the key column, named ``key``."""
    spelling = Spelling.learned(docs, text)
    marked = (
        labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y"))
        .filter(F.col("key").isNotNull() & F.col("y").isNotNull() & may_learn)
        .groupBy("key").agg(F.max("y").alias("y"))
    )
    marked = hinted(stored(marked, "examples"))
    told = docs.sparkSession.sparkContext.broadcast(spelling.costs)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(marked, "key")
    # Rows alike in id and text count once: each of n for the nth part. Texts are not shuffled for that.
    rows = rows.withColumn("id", F.xxhash64("key", "text"))
    alike = hinted(stored(rows.groupBy("id").agg(F.count("*").alias("copies")).filter("copies > 1"), "alike"))
    part = (1 / F.coalesce("copies", F.lit(1))).alias("part")
    rows = rows.join(alike, "id", "left").select(F.col("y").cast("double").alias("y"), part, "text")
    size = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.sum("part").alias("n")).collect()}
    if len(size) < 2:
        share = 0.0 if not size.get(1) else 1.0
        return Model(spelling, np.zeros(0, np.uint64), np.zeros(0), math.log((share + 1e-3) / (1 - share + 1e-3)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of either class that have a feature, summed over a batch."""
        known: dict[str, str] = {}
        spelling = Spelling(told.value)
        for batch in batches:
            column = batch.column(2)
            both = [
                np.union1d(a, b)
                for a, b in zip(features_of(column), features_of(_repaired(column, spelling, known)), strict=True)
            ]
            y, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found, at = np.unique(np.concatenate([*both, np.zeros(0, np.uint64)]), return_inverse=True)
            of = np.repeat(np.arange(len(both)), [len(x) for x in both])
            sums = [np.bincount(at, (part * c)[of], minlength=len(found)).astype(float) for c in (y, 1 - y)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.view(np.int64)), *map(pa.array, sums)], names=["feature", "ones", "zeros"]
            )

    ones, zeros = F.col("ones"), F.col("zeros")
    share = (ones + zeros) / (size[1] + size[0])
    spread = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / size[1] + 1 / size[0]))
    chosen = (
        rows.mapInArrow(count, "feature long, ones double, zeros double")
        .groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
        .select("feature", (F.abs(ones / size[1] - zeros / size[0]) / spread).alias("gap"))
        .filter(F.col("gap") >= SIGNIFICANT).orderBy(F.desc("gap"), "feature").limit(features).select("feature")
    )
    kept = np.sort(chosen.toPandas()["feature"].to_numpy(dtype=np.int64).view(np.uint64))
    if not len(kept):
        return Model(spelling, kept, np.zeros(0), math.log(size[1] / size[0]))

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of the chosen features that each text has."""
        known: dict[str, str] = {}
        spelling, weights = Spelling(told.value), Weights(kept, np.zeros(len(kept)))
        for batch in batches:
            column = batch.column(2)
            found = [weights.present(c) for c in (column, _repaired(column, spelling, known))]
            pairs = np.unique(np.concatenate([of * len(kept) + at for of, at in found]))
            ends = np.searchsorted(pairs // len(kept), np.arange(len(column) + 1))
            has = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pairs % len(kept)).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), has], names=["y", "part", "has"])

    # Texts of one class with the same features are one weighted row.
    seen = rows.mapInArrow(see, "y double, part double, has array<string>").groupBy("y", "has").agg(F.sum("part").alias("n"))
    places = CountVectorizerModel.from_vocabulary([str(i) for i in range(len(kept))], "has", "x", binary=True)
    regression = LogisticRegression(
        featuresCol="x", labelCol="y", weightCol="n", regParam=RIDGE / (size[0] + size[1]), standardization=False,
        maxIter=200, tol=1e-10,
    )
    fit = regression.fit(places.transform(stored(seen, "read")))
    return Model(spelling, kept, fit.coefficients.toArray(), fit.intercept)


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, th, score`` for every row, ``th`` a hash of its text."""
    plain = (model.spelling.costs, model.features, model.weights, model.constant)
    told = docs.sparkSession.sparkContext.broadcast(plain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, features, values, constant = told.value
        spelling, weights, known = Spelling(costs), Weights(features, values), {}
        for batch in batches:
            column = batch.column(2)
            z = weights.sums(column, _repaired(column, spelling, known)) + constant
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))],
                names=["key", "th", "score"],
            )

    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(score, f"key {kind}, th long, score double")


def without_toxic(docs: DataFrame, model: Model, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with the columns they had."""
    plain = (model.spelling.costs, model.features, model.weights, model.constant)
    told, place = docs.sparkSession.sparkContext.broadcast(plain), docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, features, values, constant = told.value
        spelling, weights, known = Spelling(costs), Weights(features, values), {}
        for batch in batches:
            column = batch.column(place)
            z = weights.sums(column, _repaired(column, spelling, known)) + constant
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))) < limit))

    return docs.mapInArrow(keep, docs.schema)
