"""Language identification by string kernels.

Two texts are compared by the blended spectrum kernel: how many character 1-, 2- and 3-grams
(letters in lower case, anything else one space) are present in both, divided by the geometric mean
of how many each has. A few labelled texts of each language are landmarks. The Nyström method turns
the kernel to the landmarks into features, in which one ridge regression per language (that language
against the rest) is solved. Scoring is two products of matrices a batch: presence by landmarks gives
the kernel, kernel by weights gives the languages.

The model is fitted on at most ``EXAMPLES`` different labelled texts, as many of each language as there are of
it up to an equal share, chosen by a hash of the text; ``LANDMARKS`` of them in all are landmarks, at
least one a language. n-grams count as equal if they fall on one of 2 ** 17 residues.

Defined cases: a null text, and one without a letter, is ``und`` with score 0; so is every text if
nothing is labelled; rows without a language are not learned from; every row is answered once, also
when rows repeat; other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecourse.llm.common import stored
from duecourse.llm.shingles import mixed, pieces

EXAMPLES = 2_000
LANDMARKS = 128
RESIDUES = 17
RIDGE = 1e-3
UNKNOWN = "und"
#: Texts in one product of matrices.
ROWS = 128
_KEPT: dict[str, np.ndarray] = {}


def _letter(code: int) -> int:
    """The lower case of a letter, 0 for any other code point."""
    low = chr(code).lower()
    return 0 if not chr(code).isalpha() else ord(low) if len(low) == 1 else code


def _letters() -> np.ndarray:
    """``_letter`` of each code point below 65,536; made once."""
    if "table" not in _KEPT:
        _KEPT["table"] = np.array([_letter(code) for code in range(1 << 16)], dtype=np.uint32)
    return _KEPT["table"]


def present(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text the residues of its n-grams, each once; none for a text without letters."""
    table, seen = _letters(), np.zeros(1 << RESIDUES, dtype=bool)
    for data, offsets in pieces(column):
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        cuts = begun[offsets]
        low = table[np.minimum(points, (1 << 16) - 1)]
        high = points >= 1 << 16
        if high.any():
            codes, which = np.unique(points[high], return_inverse=True)
            low[high] = np.array([_letter(c) for c in codes.tolist()], dtype=np.uint32)[which]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            s = low[a:b]
            if not s.any():
                yield np.zeros(0, np.int64)
                continue
            s = np.concatenate([[0], s, [0]])
            s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])].astype(np.uint64)
            two = (s[:-1] << np.uint64(21)) | s[1:]
            three = (two[:-1] << np.uint64(21)) | s[2:]
            for grams in (s[s != 0], two | np.uint64(1 << 62), three):
                seen[(mixed(grams) >> np.uint64(64 - RESIDUES)).astype(np.int64)] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            yield found


@dataclass(frozen=True)
class Kernel:
    """Landmarks as a matrix over the residues that occur in any of them."""

    column: np.ndarray  # of a residue, or -1
    landmarks: np.ndarray  # residues x landmarks, 0 or 1
    sizes: np.ndarray

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Kernel:
        used = np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]))
        column = np.full(1 << RESIDUES, -1, dtype=np.int32)
        column[used] = np.arange(len(used))
        matrix = np.zeros((len(used), len(sets)), dtype=np.float32)
        for k, s in enumerate(sets):
            matrix[column[s], k] = 1
        return cls(column, matrix, np.array([max(len(s), 1) for s in sets], dtype=float))

    def to(self, sets: list[np.ndarray]) -> np.ndarray:
        """The kernel of each set with each landmark."""
        out = np.zeros((len(sets), len(self.sizes)))
        for first in range(0, len(sets), ROWS):
            some = sets[first : first + ROWS]
            rows = np.zeros((len(some), len(self.landmarks)), dtype=np.float32)
            for k, s in enumerate(some):
                at = self.column[s]
                rows[k, at[at >= 0]] = 1
            out[first : first + len(some)] = rows @ self.landmarks
        own = np.array([max(len(s), 1) for s in sets], dtype=float)
        return out / np.sqrt(own[:, None] * self.sizes[None, :])


@dataclass(frozen=True)
class Model:
    languages: list[str]
    kernel: Kernel
    weights: np.ndarray  # landmarks x languages
    constants: np.ndarray

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row a text, one column a language, each row adding up to 1."""
        raw = np.clip(self.kernel.to(sets) @ self.weights + self.constants, 1e-6, 1.0)
        return raw / raw.sum(axis=1, keepdims=True)


def fitted(
    docs: DataFrame,
    may_learn: Column,
    text: str = "text",
    language: str = "lang",
    examples: int = EXAMPLES,
    landmarks: int = LANDMARKS,
) -> Model | None:
    """The model, or nothing if no row can be learned from. ``may_learn`` is a condition on docs."""
    usable = docs.filter(may_learn & F.col(language).isNotNull() & F.col(text).isNotNull()).select(
        F.col(language).cast("string").alias("lang"), F.xxhash64(text).alias("id"), F.col(text).alias("text")
    )
    # Copies of a text count once, here and in the sample: all of them have one place.
    counts = stored(usable.select("lang", "id").distinct().groupBy("lang").agg(F.count("*").alias("n")), "languages")
    languages = counts.count()
    if not languages:
        return None
    each = max(1, examples // languages)
    share = F.least(F.lit(1.0), F.lit(1.2 * each + 20) / F.col("n"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()  # as many as the sample has at most
        for batch in batches:
            new = []
            for i, one in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if one not in seen:
                    seen.add(one)
                    new.append(i)
            some = batch.take(pa.array(new, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [some.column(0), some.column(1),
                 pa.array([s.astype(np.int32) for s in present(some.column(2))], pa.list_(pa.int32()))],
                names=["lang", "id", "has"],
            )

    place = F.pmod("id", F.lit(2**20))
    table = (
        usable.join(F.broadcast(counts) if languages <= 100_000 else counts, "lang")
        .filter(place < share * 2**20)
        .select("lang", "id", "text")
        .mapInArrow(read, "lang string, id long, has array<int>")
        .filter(F.size("has") > 0)
        .groupBy("lang", "id").agg(F.min("has").alias("has"))
        .toArrow()
    )
    if not table.num_rows:
        return None
    has = table["has"].combine_chunks()
    cuts, values = has.offsets.to_numpy(), has.values.to_numpy()
    rows = pd.DataFrame({"lang": table["lang"].to_pylist(), "id": table["id"].to_numpy(), "at": range(table.num_rows)})
    rows = rows.sort_values(["lang", "id"], kind="stable").groupby("lang").head(each)
    names = sorted(rows["lang"].unique())
    sets = [values[cuts[i] : cuts[i + 1]] for i in rows["at"]]
    of = np.searchsorted(names, rows["lang"].to_numpy())
    turn = rows.groupby("lang").cumcount().to_numpy()
    chosen = np.flatnonzero(turn < max(1, landmarks // len(names)))
    kernel = Kernel.of([sets[i] for i in chosen])
    among = kernel.to([sets[i] for i in chosen])
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    kept = values > 1e-6 * values.max()
    turned = vectors[:, kept] / np.sqrt(values[kept])
    features = kernel.to(sets) @ turned
    wanted = (of[:, None] == np.arange(len(names))[None, :]).astype(float)
    # Each language weighs the same, however many texts it has.
    weight = 1 / np.bincount(of)[of]
    weight /= weight.sum()
    mean_x, mean_y = weight @ features, weight @ wanted
    x, y = features - mean_x, wanted - mean_y
    inner = (x * weight[:, None]).T @ x + RIDGE * np.eye(x.shape[1])
    solved = np.linalg.solve(inner, (x * weight[:, None]).T @ y)
    return Model(names, kernel, turned @ solved, mean_y - mean_x @ solved)


def identified(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score`` for every row."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if model is None:
        return rows.select("key", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    k = model.kernel
    told = docs.sparkSession.sparkContext.broadcast(
        (model.languages, k.column, k.landmarks, k.sizes, model.weights, model.constants)
    )

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, column, landmarks, sizes, weights, constants = told.value
        own = Model(names, Kernel(column, landmarks, sizes), weights, constants)
        for batch in batches:
            languages: list[str] = []
            scores: list[float] = []
            some: list[np.ndarray] = []

            def flush() -> None:
                found = own.scores(some)
                best = found.argmax(axis=1)
                for s, b, row in zip(some, best, found, strict=True):
                    languages.append(names[b] if len(s) else UNKNOWN)
                    scores.append(float(row[b]) if len(s) else 0.0)
                some.clear()

            for s in present(batch.column(1)):
                some.append(s)
                if len(some) == ROWS:
                    flush()
            if some:
                flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                names=["key", "lang_pred", "score"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(predict, f"key {kind}, lang_pred string, score double")
