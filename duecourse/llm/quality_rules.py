"""Quality rules with line labelling by a linear-chain conditional random field.

Counts of words, signs, repeated lines and repeated three-word windows come first (``base``). Then
each line with words gets features of its make (length, signs, capitals, digits, repetition, how it
ends, where it stands), and the Viterbi path of a chain over the labels content and boilerplate
marks the lines of a document together. The share of its words that lie in content lines decides
whether the document is kept.

The chain's weights are found by gradient steps on the exact likelihood (forward-backward) over at
most ``EXAMPLES`` labelled documents that the caller lets it learn from. Lines of documents marked
good count as content, those of documents marked bad as boilerplate, and so do lines found in
``COMMON`` or more of these documents.

Defined cases: a null or blank text has no words and fails the base rules; without labelled
documents every line is content; every row is answered once, also when rows repeat; other columns
play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecourse.llm.common import example_texts, stored
from duecourse.llm.shingles import _POWERS, _SHINGLE, _SPACE, _powers, mixed, pieces

EXAMPLES = 3_000
COMMON = 10
KEEP_SHARE = 0.5
LEAST_WORDS = 50


def _marks(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


_SIGNS = _marks("#*$%&|<>")
_LOUD = _marks("!#*$%&|<>")
_CAPITAL = _marks("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _marks("0123456789")
_END = _marks(".?:;")
FEATURES = 22


@dataclass(frozen=True)
class Lines:
    """Counts of a piece of texts: one entry a text, and one a line with words."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    of: np.ndarray  # text of each line
    words: np.ndarray  # words of each line
    digest: np.ndarray
    features: np.ndarray


def _place(starts: np.ndarray, size: int) -> np.ndarray:
    return np.arange(size) - np.repeat(starts, np.diff(np.append(starts, size)))


def _hashes(values: np.ndarray, starts: np.ndarray, place: np.ndarray) -> np.ndarray:
    top = int(place.max()) + 1
    return mixed(np.add.reduceat(values * (_POWERS if top <= len(_POWERS) else _powers(top))[place], starts))


def read(data: np.ndarray, offsets: np.ndarray) -> Lines:
    n, size = len(offsets) - 1, len(data)
    none = np.zeros(n, np.int64)
    if not size:
        empty = np.zeros(0, np.int64)
        return Lines(none, none, none, none, none, empty, empty, empty.astype(np.uint64), np.zeros((0, FEATURES)))

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])

    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    filled = offsets[:-1][np.diff(offsets) > 0]
    begins[filled] = inside[filled]
    counted = inside & ((data & 0xC0) != 0x80)
    n_words = per_text(begins)

    # Lines: from a text's start or the byte after a line feed on.
    feeds = np.flatnonzero(data == 10) + 1
    lines = np.union1d(filled, feeds[feeds < size])
    of = np.searchsorted(offsets, lines, side="right") - 1

    def per_line(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, lines, dtype=np.int64)

    values = data.astype(np.uint64) + np.uint64(1)
    values[data == 10] = 0
    digest = _hashes(values, lines, _place(lines, size))
    words = per_line(begins)
    has = words > 0

    # Of lines alike in one text, all but the first.
    dup = np.zeros(len(lines), dtype=bool)
    key = mixed(digest ^ mixed(of.astype(np.uint64)))
    where = np.flatnonzero(has)
    if len(where):
        _, first = np.unique(key[where], return_index=True)
        dup[where] = True
        dup[where[first]] = False
    n_dup = np.bincount(of[dup], minlength=n)

    # Words in three-word windows that the text has twice.
    starts = np.flatnonzero(begins)
    covered = np.zeros(len(starts), dtype=bool)
    if len(starts) >= 3:
        place = np.arange(size) - starts[np.maximum(np.cumsum(begins) - 1, 0)]
        place[~inside] = 0
        word = _hashes(np.where(inside, data.astype(np.uint64) + np.uint64(1), np.uint64(0)), starts, place)
        text = np.searchsorted(offsets, starts, side="right") - 1
        three = (word[:-2] * _SHINGLE + word[1:-1]) * _SHINGLE + word[2:]
        real = np.flatnonzero(text[:-2] == text[2:])
        three = mixed(three[real] ^ mixed(text[real].astype(np.uint64)))
        _, back, times = np.unique(three, return_inverse=True, return_counts=True)
        twice = real[times[back] > 1]
        for k in range(3):
            covered[twice + k] = True
        n_repeat = np.bincount(text[covered], minlength=n)
    else:
        n_repeat = none

    cover = np.zeros(size, dtype=bool)
    cover[starts[covered]] = True
    chars = np.maximum(per_line(counted), 1)
    w = np.maximum(words, 1)
    # the byte that ends the last word of a line
    last = np.flatnonzero(inside & np.append(~inside[1:], True))
    at = np.maximum(np.cumsum(words) - 1, 0)
    ends = _END[data[last[np.minimum(at, len(last) - 1)]]] if len(last) else np.zeros(len(lines), bool)
    loud, capital = per_line(_LOUD[data]) / chars, per_line(_CAPITAL[data]) / chars
    digit, again, length = per_line(_DIGIT[data]) / chars, per_line(cover) / w, chars / w
    opens = np.append([True], of[1:] != of[:-1])
    shuts = np.append(of[1:] != of[:-1], [True])
    columns = [
        np.ones(len(lines), bool), words < 3, (words >= 3) & (words < 6), (words >= 6) & (words < 11), words > 60,
        ends, loud > 0.01, loud > 0.04, loud > 0.12, capital > 0.15, capital > 0.5, digit > 0.05, digit > 0.2,
        again > 0.1, again > 0.3, again > 0.7, dup, length < 3, length > 8, length > 12, opens, shuts,
    ]
    return Lines(
        n_words, per_text(counted), per_text(_SIGNS[data]), n_dup, n_repeat,
        of[has], words[has], digest[has], np.stack(columns, axis=1)[has].astype(float),
    )


@dataclass(frozen=True)
class Chain:
    """Weights of the features for the label boilerplate, and of following labels."""

    state: np.ndarray
    follow: np.ndarray  # 2 x 2, from a label to the next

    def _steps(self, of: np.ndarray) -> list[np.ndarray]:
        """Line numbers of every text's first line, then of every second line, and so on."""
        firsts = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1]) if len(of) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(firsts, len(of)))
        order = np.argsort(-sizes, kind="stable")
        firsts, sizes = firsts[order], sizes[order]
        return [firsts[: np.searchsorted(-sizes, -t, side="left")] + t for t in range(int(sizes[0]) if len(sizes) else 0)]

    def labels(self, of: np.ndarray, features: np.ndarray) -> np.ndarray:
        """The Viterbi path: 1 for boilerplate, for all texts side by side."""
        score = np.stack([np.zeros(len(of)), features @ self.state], axis=1)
        steps, back = self._steps(of), np.zeros((len(of), 2), dtype=np.int64)
        for before, now in zip(steps, steps[1:], strict=False):
            reach = score[before[: len(now)]][:, :, None] + self.follow[None]
            back[now] = reach.argmax(axis=1)
            score[now] += reach.max(axis=1)
        out = np.zeros(len(of), dtype=np.int64)
        for t in range(len(steps) - 1, -1, -1):
            now = steps[t]
            out[now] = score[now].argmax(axis=1)
            if t + 1 < len(steps):
                longer = steps[t + 1]
                out[now[: len(longer)]] = back[longer, out[longer]]
        return out

    @classmethod
    def learned(cls, of: np.ndarray, features: np.ndarray, labels: np.ndarray,
                rounds: int = 150, ridge: float = 1.0) -> Chain:
        """Adam steps on the penalised log likelihood."""
        size = features.shape[1]
        w = np.zeros(size + 4)
        first, second = np.zeros_like(w), np.zeros_like(w)
        same = of[1:] == of[:-1]
        pairs = np.bincount(labels[:-1][same] * 2 + labels[1:][same], minlength=4)
        seen = np.concatenate([features.T @ labels, pairs])
        steps = cls(w[:size], w[size:].reshape(2, 2))._steps(of)
        for k in range(1, rounds + 1):
            score = np.stack([np.zeros(len(of)), features @ w[:size]], axis=1)
            follow = w[size:].reshape(2, 2)
            ahead, behind = score.copy(), np.zeros_like(score)
            for before, now in zip(steps, steps[1:], strict=False):
                reach = ahead[before[: len(now)]][:, :, None] + follow[None]
                ahead[now] += np.logaddexp(reach[:, 0], reach[:, 1])
            for before, now in list(zip(steps, steps[1:], strict=False))[::-1]:
                reach = (score[now] + behind[now])[:, None, :] + follow[None]
                behind[before[: len(now)]] = np.logaddexp(reach[:, :, 0], reach[:, :, 1])
            total = np.logaddexp(*(ahead + behind).T)
            one = np.exp(ahead[:, 1] + behind[:, 1] - total)
            both = np.zeros(4)
            for before, now in zip(steps, steps[1:], strict=False):
                b = before[: len(now)]
                joint = ahead[b][:, :, None] + follow[None] + (score[now] + behind[now])[:, None, :]
                both += np.exp(joint - total[now][:, None, None]).sum(axis=0).ravel()
            slope = (seen - np.concatenate([features.T @ one, both]) - ridge * w) / max(len(of), 1)
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            w = w + 0.1 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
        return cls(w[:size], w[size:].reshape(2, 2))


def fitted(
    docs: DataFrame,
    labels: DataFrame,
    may_learn: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    examples: int = EXAMPLES,
) -> Chain:
    """The chain; ``may_learn`` is a condition on the key column, named ``key``."""
    marked = (
        labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y"))
        .filter(F.col("key").isNotNull() & F.col("y").isNotNull() & may_learn)
        .groupBy("key").agg(F.min("y").alias("y"))
    )
    sizes = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, examples / len(sizes) / n))).otherwise(share)
    marked = stored(marked.filter(F.pmod(F.xxhash64("key"), F.lit(2**20)) < share * 2**20), "examples")

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = 0
            for data, offsets in pieces(batch.column(2)):
                found = read(data, offsets)
                rows = pa.array(found.of + base)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found.digest.view(np.int64)),
                     pa.array(list(found.features.astype(bool)), pa.list_(pa.bool_()))],
                    names=["id", "y", "digest", "has"],
                )
                base += len(offsets) - 1

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(marked), "key")
    table = (
        example_texts(rows, examples).select("id", "y", "text")
        .mapInArrow(lines_of, "id long, y int, digest long, has array<boolean>").toPandas()
    )
    if not len(table):
        return Chain(np.concatenate([[-5.0], np.zeros(FEATURES - 1)]), np.zeros((2, 2)))
    table["order"] = np.arange(len(table))
    table = table.sort_values(["id", "order"])
    common = table.groupby("digest")["id"].transform("nunique") >= COMMON
    wanted = ((table["y"] == 0) | common).to_numpy().astype(np.int64)
    ids = table["id"].to_numpy()
    of = np.concatenate([[0], np.cumsum(ids[1:] != ids[:-1])])
    return Chain.learned(of, np.stack(table["has"].to_numpy()).astype(float), wanted)


def judged(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text",
           keep_share: float = KEEP_SHARE) -> DataFrame:
    """``key``, the base counts, ``base_failed``, ``content_share`` and ``kept`` for every row."""
    told = docs.sparkSession.sparkContext.broadcast((chain.state, chain.follow))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Chain(*told.value)
        for batch in batches:
            base = 0
            for data, offsets in pieces(batch.column(1)):
                found = read(data, offsets)
                content = found.words * (1 - own.labels(found.of, found.features))
                good = np.bincount(found.of, content, minlength=len(offsets) - 1)
                share = good / np.maximum(found.n_words, 1)
                failed = (found.n_words < LEAST_WORDS) | (100 * found.n_repeat_words > 50 * found.n_words)
                counts = [found.n_words, found.word_chars, found.n_symbols, found.n_dup_lines, found.n_repeat_words]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(base, len(offsets) - 1), *(pa.array(c.astype(np.int64)) for c in counts),
                     pa.array(failed), pa.array(share), pa.array(~failed & (share >= keep_share))],
                    names=["key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                           "base_failed", "content_share", "kept"],
                )
                base += len(offsets) - 1

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(
        judge, f"key {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, content_share double, kept boolean",
    )
