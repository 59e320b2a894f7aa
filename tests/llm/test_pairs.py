"""Jaccard join, line dedup, decontamination and substring dedup against plain loops."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from duecourse.llm import decontamination, jaccard_join, line_dedup, substring_dedup
from duecourse.llm.components import components

from .conftest import prose, word

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, width=5):
    w = WORDS.findall(folded(text))
    if 0 < len(w) < width:
        return {tuple(w)}
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def grouped(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    answers = Counter((k, len(s), least.get(find(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets)))
    return answers, len({find(i) for i, s in enumerate(sets) if s})


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = word(rng)
    return " ".join(w)


def corpus(rng):
    rows, passage = [], prose(rng, 40)
    for n in (3, 4, 5, 6, 20, 60, 150, 400):
        base = prose(rng, n)
        rows += [base, base.upper(), "  " + base.replace(" ", "\n\t")]
        rows += [edited(rng, base, k) for k in (1, 1, 2, 3, 5, 8, 13) if n > 5]
        rows.append(base + " " + prose(rng, max(1, n // 4)))
    chain = prose(rng, 120).split()
    for k in range(12):  # each like the next one, the ends unlike
        rows.append(" ".join(chain[6 * k : 6 * k + 50]))
    rows += [passage + " " + prose(rng, n) for n in (4, 6, 8, 10, 60, 90)]
    rows += ["", None, " \n ", "a b c d", "A B C D", "a b c d e"]
    rng.shuffle(rows)
    return [(k + 10, t) for k, t in enumerate(rows)] + [(10, rows[3]), (10, rows[3]), (None, rows[5]), (None, None)]


def test_groups_are_those_of_all_pairs(make):
    for seed in (1, 2):
        rows = corpus(random.Random(seed))
        out = jaccard_join.similar_groups(make(rows)).collect()
        assert Counter((r["key"], r["n"], r["component"]) for r in out) == grouped(rows)[0]


def test_one_document_of_each_group_stays(make, awkward):
    rows = corpus(random.Random(3))
    kept = jaccard_join.one_of_each(make(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len([t for _, t in left if shingles(t)]) == grouped(rows)[1]
    assert sum(not shingles(t) for _, t in left) == sum(not shingles(t) for _, t in rows)
    out = jaccard_join.one_of_each(awkward)
    assert out.columns == awkward.columns
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 0, 1, 2, 3, 4, 6, 7, 8, 9]


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(6, 90)] + [(300, 300)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[i] for i in range(100, 161)} == {100} and {found[i] for i in range(5, 90)} == {5}


def near_lines(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_lines(rows, least=8):
    lines = [(k, i, line, WORDS.findall(line)) for k, t in sorted(r for r in rows if r[1] is not None)
             for i, line in enumerate(t.split("\n"))]
    out, firsts = {k: [] for k, t in rows if t is not None}, []
    for k, _, line, w in lines:
        gone = bool(w) and any(w == f or (min(len(w), len(f)) >= least and near_lines(w, f)) for f in firsts)
        if w and w not in firsts:
            firsts.append(w)
        if not gone:
            out[k].append(line)
    return {k: "\n".join(v) for k, v in out.items()} | {k: None for k, t in rows if t is None}


def test_lines_against_a_plain_loop(make):
    rng = random.Random(4)
    pool = [prose(rng, n) for n in (1, 2, 5, 7, 8, 8, 9, 12, 30)]
    for line in list(pool):
        w = line.split()
        for i in {0, len(w) // 2, len(w) - 1}:
            pool += [" ".join([*w[:i], word(rng), *w[i + 1 :]]), " ".join(w[:i] + w[i + 1 :]),
                     " ".join([*w[:i], word(rng), *w[i:]])]
    pool += ["x x x x x x x x x", "x x x x x x x x", "", "  ", prose(rng, 3000)]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 8)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n")]
    out = line_dedup.deduplicated(make(rows), removed="gone").collect()
    assert {r["doc_id"]: r["text"] for r in out} == plain_lines(rows)
    texts = dict(rows)
    assert all(r["gone"] == 0 or len(r["text"].split("\n")) < len(texts[r["doc_id"]].split("\n")) or r["text"] == ""
               for r in out)


def test_lines_of_awkward_rows(awkward, no_rows):
    out = line_dedup.deduplicated(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert [r["text"] for r in out.filter("doc_id = 5").collect()] == ["", ""]  # 4 has the line first
    assert line_dedup.deduplicated(no_rows).count() == 0


def plain_leaks(rows, items, num=75, den=100):
    out = {}
    for k, text in rows:
        w = WORDS.findall(folded(text))
        for item, it in items:
            v = WORDS.findall(folded(it))
            if len(v) < 5:
                continue
            bag = Counter(tuple(v[i : i + 5]) for i in range(len(v) - 4))
            best = 0
            for s in range(max(1, len(w) - len(v) + 1)):
                x = w[s : s + len(v)]
                other = Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4))
                common, either = sum((bag & other).values()), sum((bag | other).values())
                if common * den >= either * num:
                    best = max(best, common / either)
            if best:
                out[k, item] = best
    return out


def test_leaks_against_all_windows(spark, make):
    rng = random.Random(6)
    items = [(k, prose(rng, n)) for k, n in enumerate((14, 20, 37, 37, 59, 5, 9))] + [(90, None), (91, "too short"), (92, "")]
    rows = []
    for k, it in items[:7]:
        w = it.split()
        for form in (it, it.upper(), it.replace(" ", "\n"), " ".join(w[1:]), " ".join(w[:-2]), edited(rng, it, 1),
                     " ".join([*w[: len(w) // 2], "new", *w[len(w) // 2 :]]), it + " " + it):
            rows.append(prose(rng, rng.randint(0, 50)) + " " + form + " " + prose(rng, rng.randint(0, 50)))
        rows.append(it)
    rows += ["", None, prose(rng, 300), "ba ba ba ba ba ba ba"]
    rows = list(enumerate(rows))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.leaks(make(rows), benchmark)
    got = {(r["doc"]["key"], r["item_id"]): r["similarity"] for r in found.collect()}
    wanted = plain_leaks(rows, items)
    assert got.keys() == wanted.keys()
    assert all(abs(got[k] - wanted[k]) < 1e-12 for k in wanted)
    kept = {r["doc_id"] for r in decontamination.clean(make(rows), found).collect()}
    assert kept == {k for k, _ in rows} - {k for k, _ in wanted}


def test_leaks_with_moved_parts(spark, make):
    rng = random.Random(16)
    item = prose(rng, 38).split()
    moved = " ".join(item[19:] + item[:19])
    odd = " ".join(item[30:] + item[:30])
    rows = [(1, prose(rng, 60) + " " + moved + " " + prose(rng, 60)), (2, moved), (3, prose(rng, 7) + " " + odd),
            (4, " ".join(item[:19]) + " " + prose(rng, 40) + " " + " ".join(item[19:])), (5, " ".join(item[:34]))]
    items = [(1, " ".join(item)), (2, prose(rng, 38))]
    found = decontamination.leaks(make(rows), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc"]["key"], r["item_id"]): r["similarity"] for r in found.collect()}
    assert got == plain_leaks(rows, items) and {(1, 1), (2, 1), (3, 1)} <= got.keys()


def test_leaks_of_awkward_rows(spark, awkward, no_rows):
    benchmark = spark.createDataFrame([(1, "no id here at all, really none")], "item_id long, text string")
    found = decontamination.leaks(awkward, benchmark)
    assert [(r["doc"]["unknown"], r["item_id"]) for r in found.collect()] == [(True, 1)]
    assert decontamination.clean(awkward, found).columns == awkward.columns
    assert decontamination.leaks(no_rows, benchmark).count() == 0
    assert decontamination.leaks(awkward, benchmark.limit(0)).count() == 0


def test_fingerprint_blocks_meet_within_the_radius():
    rng, radius = random.Random(7), decontamination.RADIUS
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), radius):
            b ^= 1 << bit
        assert any((a ^ b) >> lo & (1 << hi - lo) - 1 == 0 for lo, hi in zip(cuts, cuts[1:]))


def test_chunks_tile_texts_and_follow_content():
    rng = random.Random(8)
    passage = prose(rng, 70)
    texts = [prose(rng, 90) + " " + passage, None, "", passage + " " + prose(rng, 9), "z" * 10_000, passage, "é" * 40]
    cuts = {}
    for of, span, digests in substring_dedup.chunked(pa.array(texts)):
        for o, a, b, d in zip(of.tolist(), *span.tolist(), digests[0].tolist()):
            cuts.setdefault(o, []).append((a, b, d))
    for o, spans in cuts.items():
        assert spans[0][0] == 0 and spans[-1][1] == len(texts[o].encode())
        assert all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    shared = {d for *_, d in cuts[0]} & {d for *_, d in cuts[3]}
    assert sum(b - a for a, b, d in cuts[3] if d in shared) > len(passage) - 150
    assert [d for of, _, ds in substring_dedup.chunked(pa.array([passage])) for d in ds[0].tolist()] == [
        d for *_, d in cuts[5]
    ]
    assert len(np.unique([d for *_, d in cuts[4]])) <= 4


def test_repeated_passages_are_found_and_cut(make, awkward, no_rows):
    rng = random.Random(9)
    passages = [prose(rng, 90) for _ in range(20)]
    rows = [(2 * k, prose(rng, 60) + " " + p + " " + prose(rng, 60)) for k, p in enumerate(passages)]
    rows += [(1001 + 2 * k, prose(rng, 30) + " " + p + " é" + prose(rng, 40)) for k, p in enumerate(passages)]
    rows += [(5000 + k, prose(rng, 150)) for k in range(30)] + [(6000, "again and again " * 200)]
    docs = make(rows)
    found = substring_dedup.repeats(docs)
    got = [(r["key"], r["first"]) for r in found.collect()]
    assert {a for a, _ in got} == {1001 + 2 * k for k in range(20)}
    assert all(b == a - 1001 for a, b in got)
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.cut_out(docs, found).collect()}
    for k, t in rows:
        assert cut[k] == t if not 1001 <= k < 2000 else len(cut[k]) < len(t) - 250 and cut[k].endswith(t[-20:])
    out = substring_dedup.cut_out(awkward, substring_dedup.repeats(awkward))
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert substring_dedup.repeats(no_rows).count() == 0
