"""Mixing, and the trained operators: counts against plain loops, answers against held-out rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duecourse.llm import language_id, licenses, mixing, quality_classifier, quality_rules, toxicity
from duecourse.llm.common import held_out, learnable
from duecourse.llm.lettering import logistic
from duecourse.llm.shingles import pieces

from .conftest import prose, word

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# Mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, limit=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= limit * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: limit * sizes[s] for s in over}
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def test_mix_meets_targets(make):
    rng = random.Random(1)
    docs = [(k, prose(rng, rng.choice((0, 1, 5, 30, 200, 900))), None, rng.choice(["a", "b", "é", "z", "B", None, "tiny"]))
            for k in range(500)]
    docs += [(1000 + k, "same words here", None, "hot") for k in range(400)] + [(2000, "one two", None, "lone")]
    sizes = Counter()
    for _, t, _, s in docs:
        sizes[s] += len(WORDS.findall(t))
    wanted = plain_targets(sizes)
    mix = mixing.mixed(make(docs))
    rows = mix.collect()
    assert len(rows) == len(docs)
    taken = Counter()
    for r in rows:
        assert 0 <= r["copies"] <= 2 and 0 <= r["rate"] <= 2
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - wanted[r["source"]]) < 1e-6 * (1 + r["target"])
        taken[r["source"]] += r["size"] * r["copies"]
    largest = {s: max(r["size"] for r in rows if r["source"] == s) for s in sizes}
    assert all(abs(taken[s] - wanted[s]) <= 0.6 * largest[s] + 1 for s in sizes)
    # the rates meet the targets before rounding, and rise or fall with size along one curve a source
    for s in sizes:
        of = [r for r in rows if r["source"] == s]
        assert abs(sum(r["rate"] * r["size"] for r in of) - wanted[s]) < 1e-6 * (1 + wanted[s])
        tilt = {r["size"]: np.log(r["rate"] / (2 - r["rate"])) / (1 + np.log1p(r["size"])) for r in of if 0 < r["rate"] < 2}
        assert not tilt or max(tilt.values()) - min(tilt.values()) < 1e-6
    key = [(r["doc_id"], r["th"], r["copies"]) for r in rows]
    assert sorted(key) == sorted((r["doc_id"], r["th"], r["copies"]) for r in mixing.mixed(make(docs)).collect())
    again = mixing.repeated(make(docs), mix).groupBy("doc_id").agg(F.max("copy").alias("n"), F.count("*").alias("m")).collect()
    copies = {r["doc_id"]: r["copies"] for r in rows if r["copies"]}
    assert {r["doc_id"]: r["n"] for r in again} == copies == {r["doc_id"]: r["m"] for r in again}


def test_mix_of_awkward_rows(awkward, no_rows):
    mix = mixing.mixed(awkward)
    assert mix.count() == awkward.count()
    out = mixing.repeated(awkward, mix)
    assert out.columns == [*awkward.columns, "copy"]
    assert out.count() == mix.agg(F.sum("copies")).first()[0]
    assert mixing.mixed(no_rows).count() == 0


# Language


def texts_of(rng, kind):
    parts = {"xx": "ala bel con dur est fin gra".split(), "yy": "ösk ük ßen tzw krü pfa".split()}[kind]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60)))


def test_language_of_held_out_texts(make, awkward):
    rng = random.Random(2)
    docs = make([(k, texts_of(rng, kind), kind) for k in range(300) for kind in ["xx" if k % 3 else "yy"]])
    model = language_id.fitted(docs, learnable(F.col("doc_id")), examples=80, landmarks=16)
    assert model.languages == ["xx", "yy"] and model.kernel.landmarks.shape[1] == 16
    out = language_id.identified(docs, model).join(docs.withColumnRenamed("doc_id", "key"), "key")
    assert out.filter(held_out(F.col("key")) & (F.col("lang") != F.col("lang_pred"))).count() == 0
    odd = {r["key"]: (r["lang_pred"], r["score"]) for r in language_id.identified(awkward, model).collect()}
    assert odd[1] == odd[2] == odd[3] == odd[7] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in odd.values())
    assert language_id.fitted(docs, F.lit(False)) is None
    assert {r["lang_pred"] for r in language_id.identified(docs, None).collect()} == {"und"}


def test_copies_of_a_text_are_one_example(spark, make):
    rng = random.Random(12)
    pool = spark.createDataFrame([(texts_of(rng, "xx"),) for _ in range(300)], "text string").distinct()
    # the text that any share of rows takes in first, some thousand times
    hot = pool.orderBy(F.pmod(F.xxhash64("text"), F.lit(2**20))).first()["text"]
    rows = [(k, r["text"], "xx") for k, r in enumerate(pool.limit(100).collect())]
    rows += [(1000 + k, hot, "xx") for k in range(3000)] + [(5000 + k, texts_of(rng, "yy"), "yy") for k in range(100)]
    model = language_id.fitted(make(rows), F.lit(True), examples=80, landmarks=16)
    assert model.kernel.landmarks.shape[1] == 16
    assert len(np.unique(model.kernel.landmarks, axis=1).T) == 16


def plain_grams(text):
    s = " " + re.sub(r"[^a-zà-ÿœ]+", " ", text.lower()).strip() + " "
    return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)} - {" "}


def test_spectrum_counts_common_grams():
    texts = ["The cat; the hat", "la été 12 là", "THE CAT", "xyz"]
    sets = list(language_id.present(pa.array(texts)))
    plain = [plain_grams(t) for t in texts]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    kernel = language_id.Kernel.of(sets).to(sets)
    for i, a in enumerate(plain):
        for j, b in enumerate(plain):
            assert kernel[i, j] == pytest.approx(len(a & b) / np.sqrt(len(a) * len(b)))


# Quality rules


def plain_base(text):
    w = WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    signs = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), signs, len(lines) - len(set(lines)), len(covered)


def test_base_counts_against_a_plain_loop(make, awkward):
    rng = random.Random(3)
    marks = ["", " ", "\n", "\t", " | ", "\r\n", "\x0b", "é", "$", "\xa0", " "]
    rows = []
    for k in range(200):
        pool = [word(rng) for _ in range(rng.randint(1, 12))]
        rows.append((k, "".join(rng.choice(pool) + rng.choice(marks) for _ in range(rng.randint(0, 120)))))
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, "a b c a b c"), (904, "x\nx\n x\nx")]
    chain = quality_rules.Chain(np.zeros(quality_rules.FEATURES), np.zeros((2, 2)))
    out = {r["key"]: r for r in quality_rules.judged(make(rows), chain).collect()}
    for k, t in rows:
        r = out[k]
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == plain_base(t), t
        assert r["base_failed"] == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.judged(awkward, chain).count() == awkward.count()


def test_paths_against_all_labellings():
    rng = np.random.default_rng(4)
    chain = quality_rules.Chain(rng.normal(size=3), rng.normal(size=(2, 2)))
    of = np.repeat([0, 1, 3, 4], [1, 5, 2, 7])
    x = rng.normal(size=(len(of), 3))
    labels = chain.labels(of, x)
    for text in np.unique(of):
        rows = np.flatnonzero(of == text)

        def score(path, rows=rows):
            emitted = sum((x[r] @ chain.state) * p for r, p in zip(rows, path))
            return emitted + sum(chain.follow[a, b] for a, b in zip(path, path[1:]))

        paths = [tuple(int(b) for b in format(k, f"0{len(rows)}b")) for k in range(2 ** len(rows))]
        assert score(tuple(labels[rows])) == pytest.approx(max(map(score, paths)))


def test_chain_learns_runs_of_junk(spark, make):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(120):
        good = k % 2 == 0
        line = (lambda: prose(rng, 12) + ".") if good else (lambda: " | ".join(word(rng) for _ in range(12)))
        rows.append((k, "\n".join(line() for _ in range(6))))
        labels.append((k, int(good), 0))
    docs, marks = make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = quality_rules.fitted(docs, marks, learnable(F.col("key")))
    out = quality_rules.judged(docs, chain).join(marks.withColumnRenamed("doc_id", "key"), "key")
    assert out.filter(F.col("kept") != (F.col("quality") == 1)).count() == 0
    free = quality_rules.fitted(docs, marks.limit(0), learnable(F.col("key")))
    assert quality_rules.judged(docs, free).filter("content_share < 1").count() == 0


# Quality classifier


def test_views_agree_on_held_out_pages(spark, make, awkward):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(300):
        good = rng.random() < 0.6
        text = prose(rng, 80) + "." if good else "WIN NOW!! " * 20 + " | ".join(word(rng) for _ in range(9))
        rows.append((k, text, "en", "site" if good else "ads"))
        if k % 3 == 0:
            labels.append((k, int(good), None))
    docs, marks = make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality_classifier.fitted(docs, marks, learnable(F.col("key")))
    got = {r["key"]: r["score"] for r in quality_classifier.scored(docs, model).collect()}
    wrong = [k for k, t, *_ in rows if (got[k] >= 0.5) != (not t.startswith("WIN"))]
    assert len(wrong) <= 3 and all(0 <= s <= 1 for s in got.values())
    odd = quality_classifier.scored(awkward, model)
    assert odd.count() == awkward.count() and odd.filter("score is null or isnan(score)").count() == 0
    assert quality_classifier.fitted(docs, marks.limit(0), learnable(F.col("key"))) == 0.5
    assert quality_classifier.scored(docs.select("doc_id", "text"), model).count() == len(rows)


def test_logistic_finds_the_stationary_point():
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(200, 4)), (rng.random(200) < 0.4).astype(float)
    w = logistic(x, y, ridge=1.0)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.abs(x.T @ (p - y) + w[:-1]).max() < 1e-5 and abs((p - y).sum()) < 1e-4


# Toxicity


def toxic_rows(rng):
    rows, labels = [], []
    for k in range(600):
        bad = k % 5 == 0
        w = prose(rng, rng.randint(5, 60)).split()
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "loser,", "Scum", "moron."]))
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(bad)))
    return rows, labels


def test_restored_words_and_scores(spark, make, awkward, no_rows):
    rng = random.Random(8)
    rows, labels = toxic_rows(rng)
    forms = ["1d10t", "i d i o t", "i.d.i.o.t", "iiidiooot", "l0ser", "L0$3R", "m0r0n", "ssscummm", "5cum", "m o r o n"]
    rows += [(1000 + k, prose(rng, 20) + f" {f} " + prose(rng, 20)) for k, f in enumerate(forms)]
    rows += [(2000 + k, prose(rng, 40) + t) for k, t in enumerate([" 10.0.0.1", " abc123", " !!!", " w h o a", " 2 4 6 8"])]
    docs, marks = make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fitted(docs, marks, learnable(F.col("key")))
    for written, meant in (("1d10t", "idiot"), ("i d i o t", "idiot"), ("l0ser", "loser"), ("m0r0n", "moron")):
        assert toxicity.restored_words(f"so {written} then", model.spelling, {}) == meant
    assert toxicity.restored_words("nothing tampered with here, 1234.", model.spelling, {}) == ""
    got = {r["key"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    assert [k for k, _, t in labels if (got[k] >= 0.5) != bool(t)] == []
    assert [f for k, f in enumerate(forms) if got[1000 + k] < 0.5] == []
    assert [k for k in range(5) if got[2000 + k] >= 0.5] == []
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k in got if got[k] < 0.5}
    assert toxicity.scored(awkward, model).filter("score between 0 and 1").count() == awkward.count()
    assert toxicity.without_toxic(awkward, model).columns == awkward.columns
    assert toxicity.scored(no_rows, model).count() == 0
    blank = toxicity.fitted(no_rows, marks.limit(0), learnable(F.col("key")))
    assert toxicity.scored(awkward, blank).filter("score >= 0.5").count() == 0


def test_toxicity_learns_from_every_label(spark):
    """Ten thousand labelled texts without a telling word: the constant is the log-odds of all of them."""
    keys = spark.range(12_500).select(F.col("id").alias("doc_id"))
    docs = keys.withColumn("text", F.lit("same words here")).unionAll(keys.limit(40).withColumn("text", F.lit("same words here")))
    marks = keys.withColumn("toxic", (F.xxhash64("doc_id") % 5 == 0).cast("int"))
    model = toxicity.fitted(docs, marks, learnable(F.col("key")))
    counts = marks.filter(learnable(F.col("doc_id"))).groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in counts}
    assert n[0] + n[1] > 9_500
    assert abs(model.constant - np.log(n[1] / n[0])) < 1e-9


def test_weighted_patterns_fit_as_single_rows_do(spark, make):
    """The distributed fit against Newton steps over a plain matrix of the same features."""
    rows, labels = toxic_rows(random.Random(18))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fitted(make(rows + rows[:90]), marks, F.lit(True))
    shown = pa.array([t for _, t in rows], pa.large_string())
    x = np.zeros((len(rows), len(model.features)))
    of, at = toxicity.Weights(model.features, model.weights).present(shown)
    x[of, at] = 1
    plain = logistic(x, np.array([bad for *_, bad in labels], dtype=float), ridge=toxicity.RIDGE)
    assert len(model.features) >= 4
    assert np.abs(np.append(model.weights, model.constant) - plain).max() < 1e-3


def test_spaced_words_beside_single_letters(spark, make):
    rng = random.Random(18)
    rows, labels = toxic_rows(rng)
    rows = [(k, f"{t} such a {prose(rng, 1)} and you see that I {prose(rng, 1)}") for k, t in rows]
    said = {"such a i d i o t man": "idiot", "and y o u i d i o t": "idiot", "that I i d i o t see": "idiot",
            "so a s c u m then": "scum", "and y-o-u-i-d-i-o-t": "idiot", "so y o u see": "you"}
    far = " ".join("andyouseethatsucha" * 12) + " i d i o t"
    docs, marks = make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fitted(docs, marks, learnable(F.col("key")))
    for written, meant in [*said.items(), (far, "idiot")]:
        assert meant in toxicity.restored_words(written, model.spelling, {}).split(), written
    bad = [(9000 + k, f"{prose(rng, 9)} {w} {prose(rng, 9)}") for k, w in enumerate(said) if w != "so y o u see"]
    assert [r["key"] for r in toxicity.scored(make(bad), model).collect() if r["score"] < 0.5] == []


def test_best_spelling_against_all_readings():
    rng = np.random.default_rng(9)
    spelling = toxicity.Spelling((-np.log(rng.random(toxicity.SYMBOLS**3))).tolist())

    def cost(out, channel):
        s = [0, 0, *(ord(c) - 96 for c in out), 0]
        at = [(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS + c for a, b, c in zip(s, s[1:], s[2:])]
        return channel + sum(spelling.costs[i] for i in at)

    for written in ("a1b", "1!0", "c@t", "b00k", "x-1"):
        readings = [("", 0.0)]
        for char in written:
            if char.isalpha():
                readings = [(o + char, c) for o, c in readings]
            else:
                looks = toxicity.LOOKS_LIKE.get(char, "")
                skip = toxicity.skip_cost(char)
                readings = [(o + x, c + toxicity.LOOK) for o, c in readings for x in looks] + [(o, c + skip) for o, c in readings]
        assert spelling.restored(written) == min(readings, key=lambda r: cost(*r))[0]


# Licences


def test_licence_paragraphs(make, awkward):
    rng = random.Random(10)
    lines = {
        "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache",
        "This work is licensed under the GNU General Public License, version 3.": "GPL",
        "ALL RIGHTS RESERVED": "Proprietary", "licensed under cc by-nc 4.0": "CC-BY-NC",
        "Copyright 2020. Released under the BSD License.": "BSD",
    }
    rows = [(k, "\n".join([prose(rng, 20), line, prose(rng, 20)])) for k, line in enumerate(lines)]
    rows += [(100 + k, "\n".join(prose(rng, 30) for _ in range(5))) for k in range(60)]
    rows += [(200, "we reserved a public table for the version of the work"), (201, None), (202, "")]
    wrapped = [
        "Permission is hereby granted, free of charge, to any person obtaining", "a copy of this software and associated",
        "documentation files, to deal in the Software without restriction.",
    ]
    rows += [(50, "\n".join([prose(rng, 20), *wrapped])), (51, "// SPDX-License-Identifier: MIT"), (52, "SPDX-License-Identifier: Apache-2.0")]
    strange = [
        "Licensed under the Eclipse Public License, version 2.0.", "Released under the Artistic License, version 2.0.",
        "This work is licensed under the Open Software License, version 3.", "SPDX-License-Identifier: ISC",
        "Released under the Boost Software License.", "Licensed under the zlib License.",
        "This work is licensed under the European Union Public License, version 1.2.",
        "Released under the Microsoft Public License.", "Licensed under the SIL Open Font License, Version 1.1.",
        "Licensed under the PostgreSQL License.",
    ]
    rows += [(300 + k, "\n".join([prose(rng, 20), line])) for k, line in enumerate(strange)]
    got = {(r["doc"]["key"], r["line_no"]): r["family"] for r in licenses.found(make(rows)).collect()}
    assert {k: v for k, v in got.items() if k[0] < 50} == {(k, 1): f for k, f in enumerate(lines.values())}
    assert {k: v for k, v in got.items() if 50 <= k[0] < 100} == {
        (50, 1): "MIT", (50, 2): "MIT", (50, 3): "MIT", (51, 0): "MIT", (52, 0): "Apache",
    }
    assert all(v == licenses.UNKNOWN for k, v in got.items() if k[0] >= 100)
    assert licenses.found(awkward).count() == 0


def test_licences_of_empty_tables(no_rows):
    assert licenses.found(no_rows).count() == 0


# Bytes of Arrow columns


def test_pieces_give_whole_texts():
    texts = ["a", None, "", "ö" * 50, "b" * 300, "c"]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["x", *texts])[1:]):
        out = []
        for data, offsets in pieces(column, limit=60):
            out += [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])]
        assert out == [t or "" for t in texts]


def test_only_letters_of_any_plane_count_for_a_language():
    import pyarrow as pa

    from duecourse.llm import language_id

    texts = ["\U0001f600 \U0001f680\U0001f680 12 !", "\U0001f600a\U0001f600", "a", "\U00010400b", "\U00010428B", "\U0001d7d8", None]
    found = [x.tolist() for x in language_id.present(pa.array(texts))]
    assert found[0] == found[5] == found[6] == []
    assert found[1] == found[2] != [] and found[3] == found[4] != []


def test_examples_are_bounded_by_rows(spark):
    from duecourse.llm.common import example_texts

    # one id holds most rows, with few texts; another one many texts
    rows = [(1, 0, f"t{k % 3}") for k in range(500)] + [(2, 1, f"u{k}") for k in range(400)] + [(3, 1, None)] * 5
    table = spark.createDataFrame(rows, "key long, y int, text string")
    assert example_texts(table, 1000).count() == 3 + 400 + 1
    some = example_texts(table, 100)
    assert 50 < some.count() < 150
    assert sorted(r["id"] for r in some.collect()) == sorted(r["id"] for r in example_texts(table.repartition(7), 100).collect())
    assert example_texts(table.limit(0), 10).count() == 0


def test_parts_of_long_strings_overlap(monkeypatch):
    spelling = toxicity.Spelling([0.0] * toxicity.SYMBOLS**3)
    parts = []
    monkeypatch.setattr(toxicity.Spelling, "restored", lambda self, p: parts.append(p) or p)
    for size in (1, 33, 63, 64, 65, 96, 97, 128, 200):
        parts.clear()
        written = "".join(chr(0x4E00 + k) for k in range(size))
        toxicity._read(written, spelling)
        assert all(any(written[a : a + 32] in p for p in parts) for a in range(max(1, size - 31)))
        assert max(map(len, parts)) <= 64
