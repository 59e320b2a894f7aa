"""Product quantisation against plain loops in Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from duecourse.llm import catalog, vector_codes
from duecourse.session import shared_folder

SCHEMA = "vec_id long, embedding array<float>, label int, code string, entry int, salt string"


def plain(rows, rounds=6):
    kept = [(k, [float(np.float32(x)) for x in v], lab) for k, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], ""
    width = -(-max(len(v) for _, v, _ in kept) // 8)
    whole = [[math.floor(4096 * x) for x in v] + [0] * (8 * width - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, whole[i]))[:16]
    books = [[whole[i][p * width : (p + 1) * width] for i in order] for p in range(8)]

    def nearest(p, part):
        far = [sum((a - b) ** 2 for a, b in zip(part, entry)) for entry in books[p]]
        return min(range(len(far)), key=lambda k: (far[k], k)), min(far)

    def parts(v):
        return [v[p * width : (p + 1) * width] for p in range(8)]

    for _ in range(rounds):
        own = [[nearest(p, part)[0] for p, part in enumerate(parts(v))] for v in whole]
        for p in range(8):
            for k in range(len(books[p])):
                members = [parts(v)[p] for v, e in zip(whole, own) if e[p] == k]
                if members:
                    books[p][k] = [sum(column) // len(members) for column in zip(*members)]
    coded = [[nearest(p, part) for p, part in enumerate(parts(v))] for v in whole]
    errors = [sum(d for _, d in c) for c in coded]
    errors = [min(e, 2**63 - 1) for e in errors]
    sums = {}
    for (_, _, lab), e in zip(kept, errors):
        sums[lab] = sums.get(lab, 0) + e
    sums = {lab: e if e < 2**63 else None for lab, e in sums.items()}
    flat = ",".join(str(x) for book in books for entry in book for x in entry)
    rows = [(k, "".join(f"{e:02x}" for e, _ in c), err, sums[lab]) for (k, _, lab), c, err in zip(kept, coded, errors)]
    return rows, hashlib.sha256(flat.encode()).hexdigest()


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "s") for r in rows], SCHEMA)


def checked(spark, rows):
    found, books = vector_codes.compressed(table(spark, rows))
    expected, digest = plain(rows)
    got = [tuple(r) for r in found.select("vec_id", "code", "error", "label_error").collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    if expected:
        assert vector_codes.digest(books) == digest
    return got


def test_clusters_ties_and_unusable_vectors(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(32)] for _ in range(12)]
    rows = [(1000 - i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)], rng.choice([1, 2, None])) for i in range(300)]
    rows += [(i, rows[0][1], 3) for i in range(2000, 2150)]  # a third of all vectors are one
    rows += [(1, None, 1), (2, [None] + [0.0] * 31, 1), (3, [math.nan] * 32, 1), (4, [math.inf] * 32, None)]
    rows += [(None, rows[1][1], None), (None, rows[1][1], None), (1000, rows[3][1], 4)]
    assert len(checked(spark, rows)) == len(rows) - 4


@pytest.mark.parametrize("rows", [
    [],
    [(1, None, 1)],
    [(1, [], None), (2, [], 2)],
    [(3, [0.5] * 8, 1), (1, [0.25] * 8, 1)],
    [(k, [0.1 * ((k * j) % 7) for j in range(k % 12)], k % 2) for k in range(40)],
    [(k, [-1e-6 * k, 3e4 * k, 1.0, -2e5, 7.0, 8.0, 9.0, 1e6] * 2, None) for k in range(30)],
    [(k, [2e7 * math.sin(k * j) for j in range(16)], 1) for k in range(30)],
])
def test_few_short_uneven_and_large_vectors(spark, rows):
    checked(spark, rows)


def test_distances_are_exact_at_every_size():
    rng = random.Random(1)
    for bits in (10, 24, 29, 40, 61):
        parts = np.array([[rng.randint(-(2**bits), 2**bits) for _ in range(5)] for _ in range(20)], np.int64)
        entry, far = vector_codes.nearest(parts, np.vstack([parts[3:6], parts[3:4]]))
        for x, e, d in zip(parts.tolist(), entry.tolist(), far.tolist()):
            all_far = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in (*parts[3:6].tolist(), parts[3].tolist())]
            assert (all_far.index(min(all_far)), min(all_far)) == (e, int(d))


def test_only_changed_parts_move_and_old_states_go(spark, monkeypatch):
    import os

    rng = random.Random(6)
    rows = [(i, [rng.gauss(i % 5, 0.2) for _ in range(16)], 0) for i in range(400)]
    moved = []
    keep = vector_codes.stored

    def counted(df, name, *rest):
        out = keep(df, name, *rest)
        if name == "arrived":
            moved.append(out.count())
        return out

    monkeypatch.setattr(vector_codes, "stored", counted)
    vector_codes.fitted(vector_codes.whole_vectors(table(spark, rows), "vec_id", "embedding", "label"))
    assert moved[0] == 8 * 400 and len(moved) == 6
    assert max(moved[1:]) < 8 * 400 and moved[-1] < 800
    left = [f for f in os.listdir(shared_folder(spark)) if f.startswith(("assigned-", "arrived-"))]
    assert left == []


def test_query(spark, tmp_path):
    rows = [(i, [math.sin(i * j) for j in range(64)], i % 3) for i in range(100)]
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in catalog.op12_vector_codes(spark, str(tmp_path)).collect()]
    expected, digest = plain(rows)
    assert sorted(got) == sorted((*r, digest) for r in expected)
