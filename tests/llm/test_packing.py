"""Packing: every id in one piece, sequences without gaps and padding, patterns joined by rank."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from duecourse.llm import catalog, packing

from .conftest import prose

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("seed", range(6))
def test_lengths_fill_every_pack(seed):
    rng = random.Random(seed)
    for _ in range(40):
        size = rng.choice([1, 8, 16, 64, 2048])
        counts = {rng.randint(1, size): rng.randint(1, 20) for _ in range(rng.randint(0, 12))}
        filled, covered = defaultdict(list), defaultdict(list)
        for length, rel, first, last, part, pack, at in packing.pack_lengths(counts, size).rows:
            for k in range(last - first):
                filled[pack + k].append((at, part))
                covered[length, first + k].append((rel, part))
        assert Counter(length for length, _ in covered) == Counter(counts)
        for (length, _), parts in covered.items():
            assert np.cumsum([0] + [n for _, n in sorted(parts)])[:-1].tolist() == [r for r, _ in sorted(parts)]
            assert sum(n for _, n in parts) == length
        sums = [sum(n for _, n in parts) for parts in filled.values()]
        for parts in filled.values():
            assert np.cumsum([0] + [n for _, n in sorted(parts)])[:-1].tolist() == [a for a, _ in sorted(parts)]
        assert sorted(filled) == list(range(len(filled)))
        assert all(s <= size and s & (s - 1) == 0 for s in sums)
        assert all(n == 1 for s, n in Counter(sums).items() if s < size)


def test_longest_first_into_the_shortest_pack():
    # 6 and 5 open packs; 3 goes where most room is (with 5), 2 with 6: no cut is needed.
    rows = packing.pack_lengths({6: 1, 5: 1, 3: 1, 2: 1}, 8).rows
    assert sorted(rows) == [(2, 0, 0, 1, 2, 0, 6), (3, 0, 0, 1, 3, 1, 5), (5, 0, 0, 1, 5, 1, 0), (6, 0, 0, 1, 6, 0, 0)]
    # The state does not grow with the number of documents.
    one, many = ({n: times * (n % 50 + 1) for n in range(1, 2048)} for times in (10, 10**7))
    assert len(packing.pack_lengths(many).rows) < 2 * len(packing.pack_lengths(one).rows) < 60_000


def test_ids_by_words_are_those_of_the_text(tokenizer):
    rng = random.Random(3)
    odd = "it's\t'S 12á ́x y 가 ΣΣ İ <|endoftext|> a<|startoftext|>b \x1c\x1d \U0001f600\U0001f600   don't!?"
    texts = [odd, "", " ", odd.replace(" ", "\n\n "), "x" * 5000, prose(rng, 400)]
    alphabet = list(odd) + list(" \t\n\x0b\x0c\r")
    texts += [c for c in map(chr, range(0x21, 0x250))] + ["Größe, (naïve)!! ÉTÉ*** it's, x<| a|>b ĳĲŉſ"]
    texts += ["".join(rng.choice("aZßéÀİıŉſ'.,*<|\u0301") for _ in range(rng.randint(1, 8))) for _ in range(1500)]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    got = list(packing.WordIds(tokenizer).of([t.encode() for t in texts]))
    for text, ids in zip(texts, got):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_query_is_an_exact_round_trip(spark, make, tmp_path, tokenizer):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.choice([3, 30, 300, 900]))) for i in range(60)]
    rows += [(100, prose(rng, 9000)), (101, None), (102, ""), (5, rows[5][1]), (None, "no id"), (103, "x" * 4000)]
    make(rows).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = packing.packed(spark.read.parquet(f"{tmp_path}/documents.parquet"), PATH)
    digests = catalog.op11_packing(spark, str(tmp_path))
    assert digests.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    of = defaultdict(list)
    for p in pieces.collect():
        assert len(p["ids"]) == 4 * p["length"]
        of[p["doc_id"], p["doc_tokens"]].append((p["start"], bytes(p["ids"])))
    expected = defaultdict(bytes)
    for key, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        expected[key, len(ids)] += np.array(ids, "<u4").tobytes()
    got = {}
    for key, parts in of.items():
        seen = Counter(start for start, _ in parts)
        assert len(set(seen.values())) == 1 or key[0] == 5  # cut alike, but for the repeated row
        got[key] = b"".join(b for _, b in sorted(parts))
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in expected.items()}
    assert all(got[k] == expected[k] for k in expected if k[0] != 5)
    crcs = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in digests.collect())
    assert crcs == Counter((p["doc_id"], p["start"], p["length"], zlib.crc32(p["ids"])) for p in pieces.collect())
    whole = packing.sequences(pieces).collect()
    assert sorted(r["sequence_id"] for r in whole) == list(range(len(whole)))
    assert all(len(r["ids"]) == 4 * r["n_ids"] and r["n_ids"] & (r["n_ids"] - 1) == 0 for r in whole)
    assert sum(r["n_ids"] == 2048 for r in whole) == sum(r["n_ids"] for r in whole) // 2048


def test_awkward_rows(awkward, no_rows):
    pieces = packing.packed(awkward, PATH, size=64).collect()
    assert sum(p["length"] for p in pieces if p["doc_id"] == 1) == 1
    assert len({(p["sequence_id"], p["offset"]) for p in pieces}) == len(pieces)
    assert sum(p["start"] == 0 for p in pieces) == awkward.count()
    assert packing.packed(no_rows, PATH).count() == 0
    assert packing.sequences(packing.packed(no_rows, PATH)).count() == 0
