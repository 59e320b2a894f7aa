"""Periodic runs of words, found in a Re-Pair grammar of the texts.

A run is a stretch of words that repeats with smallest period q (words q apart are the same), is at
least ``max(LEAST, POWER * q)`` words long, and that no neighbouring word continues.

The texts of a batch become one grammar. In each round pairs of neighbouring symbols that are more
frequent than the pairs they overlap with (ties by a hash of the pair) are replaced, each pair by a
symbol of its own, until every text is one symbol. A run lies inside the smallest symbol that holds it
and crosses the border between the two parts of that symbol; so each symbol is looked through once, for
stretches that cross its border, at its first place. What is found holds at all places of the symbol;
pieces of one run that several symbols gave are merged.

Stretches are compared through hashes of prefixes; every run found is then checked word by word, and a
batch in which one fails (no such text is known) is done again without hashes.

Defined cases: a null, empty or blank text has no run and collapses to an empty text; repeated rows are
answered one by one; a null id stays null; other columns are ignored; an empty table gives no rows. A
text is worked on whole: a very long one takes some 300 bytes of memory a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words, and so many periods.
LEAST, POWER = 6, 4
#: Words that share a grammar; a longer text has one for itself.
BATCH_WORDS = 1 << 19
#: Candidate periods looked at together.
CANDIDATES = 1 << 21

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * _BASE
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class Words:
    """Word ids of a batch and comparisons of stretches of them."""

    def __init__(self, ids: np.ndarray, hashed: bool = True) -> None:
        self.ids, self.hashed = ids, hashed
        if hashed:
            powers = np.full(len(ids) + 1, _BASE, np.uint64)
            powers[0] = 1
            self.powers = np.multiply.accumulate(powers)
            self.sums = np.zeros(len(ids) + 1, np.uint64)
            np.cumsum(_mixed(ids) * self.powers[:-1], out=self.sums[1:])

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` words from ``a`` are those from ``b``; ``a`` lies before ``b``."""
        if self.hashed:
            one = (self.sums[a + n] - self.sums[a]) * self.powers[b - a]
            return one == self.sums[b + n] - self.sums[b]
        stretches = zip(a.tolist(), b.tolist(), n.tolist())
        return np.array([np.array_equal(self.ids[i : i + k], self.ids[j : j + k]) for i, j, k in stretches], bool)

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words, at most ``most``, are the same from ``a`` and from ``b`` on, or before them."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            n = (low + high + 1) >> 1
            equal = self.same(a - n, b - n, n) if back else self.same(a, b, n)
            low, high = np.where(equal, n, low), np.where(equal, high, n - 1)
        return low


def _counted_up(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each size its index as often as it says, with numbers from 1 to the size."""
    who = np.repeat(np.arange(len(sizes)), sizes)
    return who, np.arange(1, len(who) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _crossing(words: Words, low: np.ndarray, middle: np.ndarray, high: np.ndarray):
    """``node, start, end, period`` of the long enough stretches in [low, high) across ``middle``,
    as far as they reach inside; the smallest period of each."""
    t = words.ids
    most = (high - low) // POWER
    found = []
    # One side of the border has half the run, two periods at least: the left one ...
    node, q = _counted_up(np.minimum((middle - low) // 2, most))
    m = middle[node]
    kept = t[m] == t[m - q]
    node, q, m = node[kept], q[kept], m[kept]
    kept = (t[m - 1] == t[m - 1 - q]) & words.same(m - 2 * q, m - q, q)
    node, q, m = node[kept], q[kept], m[kept]
    end = m + words.common(m - q, m, high[node] - m)
    start = m - q - words.common(m - q, m, m - q - low[node], back=True)
    found.append((node, start, end, q))
    # ... or the right one.
    node, q = _counted_up(np.minimum((high - middle) // 2, most))
    m = middle[node]
    kept = t[m - 1] == t[m - 1 + q]
    node, q, m = node[kept], q[kept], m[kept]
    kept = (t[m] == t[m + q]) & words.same(m, m + q, q)
    node, q, m = node[kept], q[kept], m[kept]
    end = m + q + words.common(m, m + q, high[node] - m - q)
    start = m - words.common(m, m + q, m - low[node], back=True)
    found.append((node, start, end, q))
    node, start, end, q = (np.concatenate(x) for x in zip(*found))
    kept = (start < middle[node]) & (end > middle[node]) & (end - start >= np.maximum(LEAST, POWER * q))
    node, start, end, q = node[kept], start[kept], end[kept], q[kept]
    order = np.lexsort((q, end, start, node))
    node, start, end, q = node[order], start[order], end[order], q[order]
    first = np.ones(len(q), bool)
    first[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return node[first], start[first], end[first], q[first]


def _chosen(symbols: np.ndarray, text: np.ndarray, top: int, by_count: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs to replace in this round, and a number for each different pair."""
    inside = text[:-1] == text[1:]
    places = np.flatnonzero(inside)
    pairs, which, counts = np.unique(
        symbols[places] * top + symbols[places + 1], return_inverse=True, return_counts=True
    )
    hashes = _mixed(pairs)
    order = np.lexsort((hashes, counts)) if by_count else np.argsort(hashes, kind="stable")
    rank = np.empty(len(pairs), np.int64)
    rank[order] = np.arange(len(pairs))
    strength = np.full(len(symbols) + 1, -1, np.int64)  # of the pair that starts before each place
    strength[places + 1] = rank[which]
    before, own, after = strength[:-2], strength[1:-1], strength[2:]
    # Equal pairs in a row overlap: every second one, from the first on, may be replaced.
    chained = own == before
    at = np.arange(len(own))
    odd = (at - np.maximum.accumulate(np.where(chained, 0, at))) & 1
    taken = np.flatnonzero(inside & (odd == 0) & (chained | (own > before)) & (own >= after))
    return taken, own[taken]


def _pieces(words: Words, bounds: np.ndarray):
    """``start, end, period`` of runs and pieces of runs, each whole run among them."""
    n = len(words.ids)
    symbols, starts, ends = words.ids.astype(np.int64), np.arange(n), np.arange(1, n + 1)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    top = int(symbols.max(initial=0)) + 1
    found, by_count = [], True
    while (text[:-1] == text[1:]).any():
        taken, pair = _chosen(symbols, text, top, by_count)
        # Counts alone may let one pair in a row of rising ones through; then a round goes by hash.
        by_count = not by_count or 10 * len(taken) > len(symbols)
        _, first, node = np.unique(pair, return_index=True, return_inverse=True)
        low, middle, high = starts[taken[first]], starts[taken[first] + 1], ends[taken[first] + 1]
        places = np.argsort(node, kind="stable")
        times = np.bincount(node, minlength=len(first))
        behind = np.cumsum(times)
        large = np.flatnonzero(high - low >= LEAST)
        load = np.cumsum((high - low)[large])
        for part in np.split(large, np.searchsorted(load, np.arange(CANDIDATES, load[-1] if len(load) else 0, CANDIDATES))):
            at, start, end, q = _crossing(words, low[part], middle[part], high[part])
            at = part[at]
            # The same at every place of the symbol.
            who, nth = _counted_up(times[at])
            shift = starts[taken[places[behind[at[who]] - times[at[who]] + nth - 1]]] - low[at[who]]
            found.append((start[who] + shift, end[who] + shift, q[who]))
        symbols[taken] = top + node
        ends[taken] = ends[taken + 1]
        top += len(first)
        left = np.ones(len(symbols), bool)
        left[taken + 1] = False
        symbols, starts, ends, text = symbols[left], starts[left], ends[left], text[left]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _merged(start: np.ndarray, end: np.ndarray, q: np.ndarray):
    """Pieces of one period that share a period's length are one run; of runs over the same words the
    smallest period counts."""
    order = np.lexsort((start, q))
    start, end, q = start[order], end[order], q[order]
    far = int(end.max(initial=0)) + 1
    _, rank = np.unique(q, return_inverse=True)
    reach = np.maximum.accumulate(end + rank * far) - rank * far
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (start[1:] > reach[:-1] - q[1:])
    first = np.flatnonzero(new)
    start, q = start[first], q[first]
    end = np.maximum.reduceat(end, first) if len(first) else end
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    kept = np.ones(len(q), bool)
    kept[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[kept], end[kept], q[kept]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def _holds(ids: np.ndarray, bounds: np.ndarray, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> bool:
    for s, e, p, text in zip(start.tolist(), end.tolist(), q.tolist(),
                             (np.searchsorted(bounds, start, "right") - 1).tolist()):
        low, high = bounds[text], bounds[text + 1]
        if not np.array_equal(ids[s : e - p], ids[s + p : e]):
            return False
        if (s > low and ids[s - 1] == ids[s - 1 + p]) or (e < high and ids[e] == ids[e - p]):
            return False
    return True


def find(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, end, period`` of all runs in texts that lie one after the other in ``ids``, text k from
    ``bounds[k]`` to ``bounds[k + 1]``; by start and period."""
    for hashed in (True, False):
        runs = _merged(*_pieces(Words(ids, hashed), bounds))
        if not hashed or _holds(ids, bounds, *runs):
            break
    return runs


def runs(
    docs: DataFrame,
    altered: Callable[[int | None, int], np.ndarray | None] | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: the runs of each text by start and period, and its words,
    joined by spaces, without those that a run repeats after its first period.

    ``altered`` may give, for an id and a number of words, the places of the words to take instead.
    """

    def answered(keys: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
        flat = [w for words in texts for w in words]
        ids = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        start, end, q = find(ids.astype(np.int64), bounds)
        change = np.zeros(len(flat) + 1, np.int64)
        np.add.at(change, start + q, 1)
        np.add.at(change, end, -1)
        kept = np.cumsum(change)[:-1] == 0
        first = np.searchsorted(start, bounds)
        structs = pa.StructArray.from_arrays(
            [pa.array(start - np.repeat(bounds[:-1], np.diff(first))), pa.array(end - start), pa.array(q)],
            ["start", "length", "period"],
        )
        collapsed = [
            b" ".join(words if own.all() else [w for w, k in zip(words, own) if k]).decode()
            for words, own in ((w, kept[a : a + len(w)]) for w, a in zip(texts, bounds))
        ]
        return pa.record_batch(
            [pa.array(keys, pa.int64()), pa.array(np.diff(bounds)),
             pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), structs), pa.array(collapsed, pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, held = [], [], 0
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                words = (value.as_py() or b"").split()
                places = altered(i, len(words)) if altered else None
                if places is not None:
                    words = [words[k] for k in places]
                keys.append(i)
                texts.append(words)
                held += len(words)
                if held > BATCH_WORDS:
                    yield answered(keys, texts)
                    keys, texts, held = [], [], 0
            if keys:
                yield answered(keys, texts)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(
        searched, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )


def with_strongest(found: DataFrame) -> DataFrame:
    """Adds ``strongest``, the run of most periods; ties: smallest start, then period."""

    def before(a, b):
        one, other = a["length"] * b["period"], b["length"] * a["period"]
        return (
            F.when(one > other, -1).when(one < other, 1)
            .when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
            .when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)
        )

    return found.withColumn("strongest", F.get(F.array_sort("runs", before), F.lit(0)))
