"""Packing of tokenised documents into training sequences by shortest-pack-first over lengths.

A document's ids (those of its text and an end id) are cut at every ``size`` ids; what is left over is
shorter. How many such pieces of each length there are is all that the packing looks at: lengths are
placed longest first, all pieces of one length at once, into the packs with the most room (the
shortest packs). A new pack is opened where none has room, as long as there are ids for another full
one; after that a piece is cut to fill the pack. Packs alike are one entry with a count, so the state
is a few thousand numbers whatever the number of documents. What remains fills packs of 2, 4, 8 ... ids.
No sequence is padded: all have ``size`` ids, but for at most one of each smaller power of two.

Pieces are told apart by their place among those of their length: a task numbers its own, and counts of
tasks and lengths, summed in order, give the number in the whole table. By it each piece finds its
pack (``Slots``), so no piece has to be sorted or sent anywhere.

Defined cases: a null or empty text has the end id alone; rows repeat as often as they are there; a
null id stays null; other columns are ignored; an empty table gives no pieces. A text is tokenised word
by word, so a very long one needs memory for its words and ids (some 100 bytes a word). Reruns agree as
long as the table is read in the same splits; other splits give another, equally full, packing.
"""

from __future__ import annotations

import heapq
import os
import re
import string
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duecourse.llm.common import hinted, stored

#: Ids of a sequence.
SIZE = 2048
#: Words whose ids a task keeps.
KNOWN_WORDS = 400_000
#: New words given to the tokenizer at once.
NEW_WORDS = 4096
#: Letters with a short way to their ids, and the marks that may stand behind them.
LETTERS = range(0x41, 0x180)
MARKS = "!\"#$%&()*+,-./:;=?@[]^_`{}~"
#: Bytes of text or ids worked on at once.
CHUNK = 2 << 20

PIECES = "doc_id long, doc_tokens long, start long, length int, task int, nth long, ids binary"


class WordIds:
    """Ids of texts through the ids of their words. No token reaches across ASCII white space, so the
    words of a text (few of them new) have the ids that the text has.

    Most new words are letters with marks behind. For letters that the steps before the tokenizer's
    model map one by one (asked for here), the model is asked at once; those steps take four fifths of
    the time.
    """

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        self.mapped = self._letters()
        self.marks: dict[str, list[int]] = {"": []}
        self.simple = re.compile(f"[{''.join(map(chr, self.mapped))}]+") if self.mapped else None
        self._forget()

    def _letters(self) -> dict[int, str]:
        """What the model sees of each letter; none where the letter's neighbours or marks matter."""
        steps = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer

        def pieces(text: str) -> list[str]:
            return [p for p, _ in steps[1].pre_tokenize_str(steps[0].normalize_str(text))]

        if None in steps:
            return {}
        found = {ord(x): pieces(x) for x in map(chr, LETTERS) if x.isalpha()}
        found = {x: own[0] for x, own in found.items() if len(own) == 1}
        every = "".join(map(chr, found))
        if not set(string.ascii_letters) <= set(every):
            return {}
        for text in (every, every[::-1], *(m + n for m in MARKS for n in MARKS)):
            own = text.translate(found)
            if pieces("a" + text)[-1] != (found.get(97, "") + own if text[0].isalpha() else own):
                return {}
        return found

    def _forget(self) -> None:
        self.places: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        flat, lengths, others = [], [], []
        # Places go on with the simple words, then the others.
        simple, stems, tokenize = [], {}, self.tokenizer.model.tokenize
        every = b"\n".join(words).decode()
        for w, line, mapped in zip(words, every.split("\n"), every.translate(self.mapped).split("\n")):
            stem = line.rstrip(MARKS)
            if not self.simple or not (stem.isascii() and stem.isalpha() or self.simple.fullmatch(stem)):
                others.append(w)
                continue
            letters, marks = mapped.rstrip(MARKS), line[len(stem) :]
            if marks not in self.marks:
                self.marks[marks] = self.tokenizer.encode(marks, add_special_tokens=False).ids
            ids = stems.get(letters)
            if ids is None:
                ids = stems[letters] = [t.id for t in tokenize(letters)]
            ids = ids + self.marks[marks]
            flat += ids
            lengths.append(len(ids))
            simple.append(w)
        for k in range(0, len(others), NEW_WORDS):
            part = [w.decode() for w in others[k : k + NEW_WORDS]]
            for found in self.tokenizer.encode_batch_fast(part, add_special_tokens=False):
                ids = found.ids
                flat += ids
                lengths.append(len(ids))
        words = simple + others
        self.places.update(zip(words, range(len(self.places), len(self.places) + len(words))))
        self.ids = np.concatenate([self.ids, np.array(flat, np.uint32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths, dtype=np.int64)])

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.places) > KNOWN_WORDS:
            self._forget()
        words, ends = [], [0]
        for text in texts:
            words += text.split()
            ends.append(len(words))
        coded = pa.array(words, pa.binary()).dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        somewhere = np.zeros(len(coded.dictionary), np.int64)
        somewhere[which] = np.arange(len(words))
        different = [words[i] for i in somewhere.tolist()]
        new = [w for w in different if w not in self.places]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.places.__getitem__, different), np.int64, len(different))[which]
        first, lengths = self.starts[at], self.starts[at + 1] - self.starts[at]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.repeat(first - upto[:-1], lengths) + np.arange(upto[-1])]
        return np.split(ids, upto[ends[1:-1]]) if texts else []


def pieces(docs: DataFrame, tokenizer_path: str, size: int, end_id: int, key: str, text: str) -> DataFrame:
    """Every document cut at each ``size`` ids, with the piece's number among those of its length in
    its task."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    schema = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("start", pa.int64()),
                        ("length", pa.int32()), ("task", pa.int32()), ("nth", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
        words = WordIds(Tokenizer.from_str(vocabulary.value))
        seen = np.zeros(size + 1, np.int64)
        task = TaskContext.get().partitionId()
        rows: list[tuple] = []
        held = 0

        def made() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[] for _ in schema]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())
            for part in _chunks(texts):
                for i, ids in zip(part, words.of([texts[i].as_py() or b"" for i in part])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), size):
                        own = ids[start : start + size]
                        rows.append((keys[i], len(ids), start, len(own), task, int(seen[len(own)]), own.tobytes()))
                        seen[len(own)] += 1
                        held += own.nbytes
                        if held > CHUNK:
                            yield made()
                            rows, held = [], 0
        if rows:
            yield made()

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


def _chunks(texts: pa.Array) -> Iterator[list[int]]:
    part, held = [], 0
    for i in range(len(texts)):
        part.append(i)
        held += len(texts[i].as_buffer() or b"")
        if held > CHUNK:
            yield part
            part, held = [], 0
    if part:
        yield part


@dataclass
class Slots:
    """Where pieces go: rows of (length of the piece, start of the part in it, first and last number of
    the pieces among those of their length, ids of the part, first pack, place in the pack)."""

    rows: list[tuple[int, int, int, int, int, int, int]]
    size: int

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys in ascending order by length, start and first number, and what belongs to each."""
        table = np.array(sorted(self.rows), np.int64).reshape(-1, 7)
        return self.keys(table[:, 0], table[:, 1], table[:, 2]), table

    def keys(self, length: np.ndarray, rel: np.ndarray, number: np.ndarray) -> np.ndarray:
        return (length * (self.size + 1) + rel) * (1 << 38) + number


def pack_lengths(counts: dict[int, int], size: int = SIZE) -> Slots:
    """Shortest-pack-first over the histogram of lengths, with cuts where no pack has room."""
    total = sum(length * n for length, n in counts.items())
    unopened, rest = divmod(total, size)
    # Packs for what no full pack takes, largest first.
    small = [1 << b for b in range(size.bit_length()) if rest >> b & 1]
    waiting: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    for length, n in counts.items():
        if n:
            waiting[length].append((length, 0, 0, n))
    rows, opened = [], 0
    # Packs alike: (minus room, first pack, packs, ids in each so far); the most room comes first.
    packs: list[tuple[int, int, int, int]] = []
    for length in range(size, 0, -1):
        queue = waiting.pop(length, [])
        while queue:
            origin, rel, first, n = queue.pop()
            room = -packs[0][0] if packs else 0
            if room < length and unopened:
                taken = min(n, unopened)
                heapq.heappush(packs, (-size, opened, taken, 0))
                opened, unopened = opened + taken, unopened - taken
            elif not packs:
                heapq.heappush(packs, (-small[-1], opened, 1, 0))
                opened += 1
                small.pop()
            room, pack, alike, filled = heapq.heappop(packs)
            part, placed = min(length, -room), min(n, alike)
            rows.append((origin, rel, first, first + placed, part, pack, filled))
            if part < -room:
                heapq.heappush(packs, (room + part, pack, placed, filled + part))
            if placed < alike:
                heapq.heappush(packs, (room, pack + placed, alike - placed, filled))
            if placed < n:
                queue.append((origin, rel, first + placed, n - placed))
            if part < length:
                waiting[length - part].append((origin, rel + part, first, placed))
    return Slots(rows, size)


def packed(
    docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = 1, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, doc_tokens, start, length, sequence_id, offset, ids`` for each piece; ``ids`` are its
    ids as little-endian unsigned 32-bit numbers, ``start`` counts the document's ids before it."""
    cut = stored(pieces(docs, tokenizer_path, size, end_id, key, text), "pieces")
    counts = stored(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    by_length = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``size`` rows
    slots = pack_lengths({r["length"]: r["n"] for r in by_length}, size)
    places = docs.sparkSession.sparkContext.broadcast((slots.arrays(), slots))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = stored(
        counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "piece-firsts"
    )
    numbered = cut.join(hinted(firsts), ["length", "task"]).select(
        "doc_id", "doc_tokens", "start", "length", (F.col("first") + F.col("nth")).alias("number"), "ids"
    )

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, table), own = places.value
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            number = batch.column("number").to_numpy().astype(np.int64)
            start = batch.column("start").to_numpy()
            rel, rows = np.zeros(len(length), np.int64), np.arange(len(length))
            while len(rows):
                at = np.searchsorted(keys, own.keys(length[rows], rel[rows], number[rows]), "right") - 1
                slot = table[at]
                part, pack = slot[:, 4], slot[:, 5] + number[rows] - slot[:, 2]
                ids = batch.column("ids").take(pa.array(rows))
                if (part < length[rows]).any():
                    ids = pa.array(
                        [x.as_py()[4 * a : 4 * (a + n)] for x, a, n in zip(ids, rel[rows].tolist(), part.tolist())],
                        pa.binary(),
                    )
                yield pa.record_batch(
                    [batch.column("doc_id").take(pa.array(rows)), batch.column("doc_tokens").take(pa.array(rows)),
                     pa.array(start[rows] + rel[rows]), pa.array(part), pa.array(pack), pa.array(slot[:, 6]), ids],
                    names=["doc_id", "doc_tokens", "start", "length", "sequence_id", "offset", "ids"],
                )
                rel[rows] += part
                rows = rows[rel[rows] < length[rows]]

    return numbered.mapInArrow(
        placed, "doc_id long, doc_tokens long, start long, length long, sequence_id long, offset long, ids binary"
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, n_ids, n_pieces, ids``: the pieces of each sequence one after the other. A group
    is one sequence, so it has at most ``size`` ids."""
    parts: Column = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_ids"), F.count("*").alias("n_pieces"),
        F.unhex(F.concat_ws("", F.transform(parts, lambda p: p["ids"]))).alias("ids"),
    )
