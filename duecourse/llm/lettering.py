"""Runs of letters in text and hashes of their beginnings, over the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from duecourse.llm.shingles import _BYTE, _POWERS, _powers, mixed, pieces

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
PREFIXES = (4, 5, 6)


def begun_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, feature)`` of every whole word and of its first 4, 5 and 6 bytes; a word is
    a run of letters, A-Z taken as a-z."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if not len(data):
        return none
    inside = _LETTER[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    borders = offsets[:-1][offsets[:-1] < len(data)]
    start[borders] = inside[borders]
    starts = np.flatnonzero(start)
    if not len(starts):
        return none
    place = np.arange(len(data)) - starts[np.maximum(np.cumsum(start) - 1, 0)]
    place[~inside] = 0
    top = int(place.max()) + 1
    values = _BYTE[data] * (_POWERS if top <= len(_POWERS) else _powers(top))[place]
    values[~inside] = 0
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    nexts = np.append(starts[1:], len(data))
    run = np.concatenate([np.zeros(1, np.int64), np.cumsum(inside)])
    lengths = run[nexts] - run[starts]
    of = np.searchsorted(offsets, starts, side="right") - 1
    texts, features = [of], [mixed(sums[nexts] - sums[starts])]
    for k in PREFIXES:
        long = lengths > k
        texts.append(of[long])
        features.append(mixed((sums[starts[long] + k] - sums[starts[long]]) ^ np.uint64(k << 56)))
    return np.concatenate(texts), np.concatenate(features)


def features_of(column: pa.Array) -> list[np.ndarray]:
    """For each text its distinct features."""
    out: list[np.ndarray] = []
    for data, offsets in pieces(column):
        of, features = begun_words(data, offsets)
        order = np.argsort(of, kind="stable")
        of, features = of[order], features[order]
        cuts = np.searchsorted(of, np.arange(len(offsets)))
        out += [np.unique(features[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


class Weights:
    """Weights of known features; which of them a text has is found by one table look-up a word."""

    def __init__(self, features: np.ndarray, weights: np.ndarray) -> None:
        order = np.argsort(features)
        self.features, self.weights = features[order], weights[order]
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[(self.features >> np.uint64(48)).astype(np.int64)] = True

    def present(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(text number, place in features)`` of each known feature that a text has, once."""
        texts, places, base = [], [], 0
        for data, offsets in pieces(column):
            of, features = begun_words(data, offsets)
            if len(self.features):
                maybe = self.seen[(features >> np.uint64(48)).astype(np.int64)]
                of, features = of[maybe], features[maybe]
                at = np.minimum(np.searchsorted(self.features, features), len(self.features) - 1)
                known = self.features[at] == features
                texts.append(of[known] + base)
                places.append(at[known])
            base += len(offsets) - 1
        return (np.concatenate([*texts, np.zeros(0, np.int64)]), np.concatenate([*places, np.zeros(0, np.int64)]))

    def sums(self, *columns: pa.Array) -> np.ndarray:
        """Sum of the weights that each text has; several columns count as one text."""
        found = [self.present(c) for c in columns]
        n, k = len(columns[0]), max(len(self.features), 1)
        pairs = np.unique(np.concatenate([of * k + at for of, at in found]))
        return np.bincount(pairs // k, self.weights[pairs % k] if len(pairs) else None, minlength=n).astype(float)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression by Newton steps; the last is the constant,
    which is not penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (penalty * w * w).sum())

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step, rate = np.linalg.solve(hessian, gradient), 1.0
        while rate > 1e-6 and (new := loss(w - rate * step)) > now:
            rate /= 2
        w = w - rate * step
        if now - new < 1e-9 * max(1.0, abs(now)):
            break
        now = new
    return w
