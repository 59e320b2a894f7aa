"""The pipeline and the registered queries on a small folder of tables."""

import random
import re

import pytest

import corpus_pipeline
from duecourse import llm

from .conftest import DOCS, prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(11)
    item = prose(rng, 40)
    good = [(k, "\n".join(prose(rng, 30) + "." for _ in range(4)), "en", f"s{k % 4}") for k in range(120)]
    bad = [(200 + k, prose(rng, 60) + " idiot loser scum " + prose(rng, 60), "en", "s0") for k in range(30)]
    near = [(300 + k, good[k][1].replace(" ", "\t", 3).replace(".\n", ". so\n", 1), "en", "s1") for k in range(5)]
    leaks = [(400, prose(rng, 50) + " " + item + " " + prose(rng, 50), "en", "s2")]
    lines = [(500 + k, good[0][1].split("\n")[0] + "\n" + prose(rng, 50), "en", "s3") for k in range(6)]
    odd = [(600, None, None, None), (601, "", None, "s0"), (None, prose(rng, 60), None, None)]
    rows = [(*r, None if r[1] is None else len(r[1])) for r in (*good, *bad, *near, *leaks, *lines, *odd)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(r[0], 1, int(200 <= r[0] < 300)) for r in rows if r[0] is not None and r[0] < 300]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows


def test_stages_take_effect(spark, folder, tmp_path):
    path, rows = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen[name] = {(r["doc_id"], r["text"]) for r in docs.collect()}
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic, lines, near, clean, mixed = seen.values()
    ids = {r[0] for r in rows}
    assert {k for k, _ in toxic} == {k for k in ids if k is None or not 200 <= k < 300}
    assert {k for k, _ in lines} == {k for k, _ in toxic}
    first = rows[0][1].split("\n")[0]
    assert all("\n" not in t and first not in t for k, t in lines if k is not None and 500 <= k < 600)
    assert {k for k, _ in lines - near} <= {300 + k for k in range(5)}
    assert {k for k, _ in near - clean} == {400}
    words = sum(len(WORDS.findall(t or "")) for _, t in clean)
    copies = docs.collect()
    taken = sum(len(WORDS.findall(r["text"] or "")) for r in copies)
    assert abs(taken - 1.5 * words) < 0.1 * words and max(r["copy"] for r in copies) == 2
    assert mixed <= clean


def test_every_operator_is_registered():
    names = {re.match(r"op(\d+)_", n)[1] for n in llm.queries()}
    assert names == {str(n) for n in range(1, 11)}
    assert set(llm.oracles()) <= set(llm.queries())


def test_queries_answer_every_document(spark, folder):
    path, rows = folder
    for name in ("op1_language_id", "op4_mixing", "op5_quality_classifier", "op7_quality_rules", "op8_toxicity"):
        assert llm.queries()[name](spark, path).count() == len(rows), name


def test_registered_queries_run_and_keep_their_columns(spark, folder):
    path, rows = folder
    shared = "".join(f"passage number {k} is told once more here, " for k in range(12))
    more = [(9001, "first " + shared, "en", "s0", None), (9002, "second one " + shared, "en", "s0", None)]
    spark.createDataFrame(more, DOCS).write.mode("append").parquet(f"{path}/documents.parquet")
    wanted = {
        "op1_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op2_decontamination": ["doc_id", "item_id", "start_word", "n_words", "similarity"],
        "op3_line_dedup": ["doc_id", "text", "n_removed"],
        "op4_mixing": ["doc_id", "size", "source_size", "target", "taken", "copies", "rate"],
        "op5_quality_classifier": ["doc_id", "held_out", "score", "kept"],
        "op6_substring_dedup": ["doc_id", "start_byte", "end_byte", "first_doc_id"],
        "op7_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                              "base_failed", "kept", "content_share"],
        "op8_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op9_license_scan": ["doc_id", "line_no", "family", "probability", "similarity"],
        "op10_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    }
    assert wanted.keys() == llm.queries().keys()
    got = {}
    for name, columns in wanted.items():
        out = llm.queries()[name](spark, path)
        assert out.columns == columns, name
        got[name] = out.collect()
    assert {(r["doc_id"], r["item_id"]) for r in got["op2_decontamination"]} == {(400, 1)}
    assert (9002, 9001) in {(r["doc_id"], r["first_doc_id"]) for r in got["op6_substring_dedup"]}
    for name in ("op3_line_dedup", "op10_jaccard_join"):
        assert len(got[name]) == len(rows) + len(more), name
