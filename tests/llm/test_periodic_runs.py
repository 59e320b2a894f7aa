"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from duecourse.llm import catalog, periodic_runs

from .conftest import prose


def plain(words):
    """(start, length, period) of all runs by start and period."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(rng):
    letters = "abcdefghij"[: rng.choice([1, 2, 3, 10])]
    out = []
    for _ in range(rng.randint(0, 7)):
        kind = rng.random()
        if kind < 0.5:
            period = [rng.choice(letters) for _ in range(rng.randint(1, 7))]
            out += (period * 9)[: rng.randint(1, 9 * len(period))]
        elif kind < 0.6 and out:
            at = rng.randrange(len(out))
            out += out[at : at + rng.randint(1, 50)]
        else:
            out += [rng.choice(letters) for _ in range(rng.randint(0, 15))]
    return out


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_all_kinds(seed):
    rng = random.Random(seed)
    for _ in range(25):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 6))]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        ids = np.array([ord(w) for t in texts for w in t], np.int64)
        got = [[] for _ in texts]
        for s, e, q in zip(*periodic_runs.find(ids, bounds)):
            k = int(np.searchsorted(bounds, s, "right")) - 1
            got[k].append((int(s - bounds[k]), int(e - s), int(q)))
        assert got == [plain(t) for t in texts]


def test_one_word_and_long_periods_and_no_hashes(monkeypatch):
    n = 40_000
    for ids in (np.zeros(n, np.int64), np.tile(np.arange(n // 5), 5), np.arange(n)):
        s, e, q = periodic_runs.find(ids, np.array([0, n]))
        expected = [] if ids[1] and ids[n // 5] else [(0, n, 1 if not ids[1] else n // 5)]
        assert list(zip(s.tolist(), e.tolist(), q.tolist())) == expected
    monkeypatch.setattr(periodic_runs, "_holds", lambda *a: False)
    ids = np.array([1, 2, 3] + [4, 5] * 6 + [6], np.int64)
    assert [x.tolist() for x in periodic_runs.find(ids, np.array([0, len(ids)]))] == [[3], [15], [2]]


def test_query_against_plain_search(spark, make, tmp_path):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(0, 120)) if i % 3 else " ".join(repetitive(rng))) for i in range(150)]
    rows += [(7, "x " * 30), (None, "no id but a a a a a a a a"), (200, None), (201, " \n"), (202, "ä ö " * 5)]
    make(rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.op13_periodic_runs(spark, str(tmp_path)).collect()
    expected = []
    for key, text in rows:
        words = (text or "").split()
        h, n = zlib.crc32(str(key).encode()), len((text or "").split())
        if key is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = plain(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        expected.append((
            key, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest(),
        ))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert sum(r[1] > 0 for r in expected) > 20
    assert any(r[1] > 0 and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in expected)


def test_awkward_rows(awkward, no_rows):
    rows = periodic_runs.runs(awkward).collect()
    assert len(rows) == awkward.count()
    assert all(r["collapsed"] is not None and r["runs"] is not None for r in rows)
    assert {r["n_words"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert periodic_runs.with_strongest(periodic_runs.runs(no_rows)).count() == 0


def test_long_text_is_read_whole(make):
    words = [f"w{i}" for i in range(60_000)]
    text = " ".join(words + ["end", "of"] * 5 + ["x"])
    [row] = periodic_runs.runs(make([(1, text)])).select("n_words", "runs", F.length("collapsed").alias("n")).collect()
    assert row["n_words"] == 60_011
    assert [tuple(r) for r in row["runs"]] == [(60_000, 10, 2)]
    assert row["n"] == len(" ".join(words + ["end", "of", "x"]))
