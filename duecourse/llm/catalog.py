"""Registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duecourse.llm import (
    decontamination,
    jaccard_join,
    language_id,
    licenses,
    line_dedup,
    mixing,
    packing,
    periodic_runs,
    quality_classifier,
    quality_rules,
    substring_dedup,
    toxicity,
    vector_codes,
)
from duecourse.llm.common import held_out, learnable, table


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(table(spark, sf_dir, "documents"))
    return mix.select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate",
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = quality_rules.fitted(docs, table(spark, sf_dir, "labels"), learnable(F.col("key")))
    return quality_rules.judged(docs, chain).select(
        F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "content_share",
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"), learnable(F.col("key")))
    return toxicity.scored(docs, model).select(
        F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.found(table(spark, sf_dir, "documents")).select(
        F.when(~F.col("doc.unknown"), F.col("doc.key")).alias("doc_id"), F.col("line_no").cast("long").alias("line_no"),
        "family", "probability", "similarity",
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard_join.similar_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("key").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
        F.col("component").alias("component_id"),
    )


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS v FROM documents),
s AS (SELECT DISTINCT doc_id, shingle FROM (
  SELECT doc_id, unnest(CASE WHEN len(v) >= 5
           THEN list_transform(range(1, len(v) - 3), lambda i: array_to_string(v[i:i + 4], ' '))
           WHEN len(v) > 0 THEN [array_to_string(v, ' ')] ELSE [] END) AS shingle FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (shingle)
      WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
      WHERE 100 * k >= 75 * (a.n + b.n - k)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = d.doc_id"""


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fitted(docs, learnable(F.col("doc_id")))
    return language_id.identified(docs, model).select(
        F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "lang_pred", "score"
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fitted(docs, table(spark, sf_dir, "labels"), learnable(F.col("key")))
    return quality_classifier.scored(docs, model).select(
        F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "score",
        (F.col("score") >= 0.5).alias("kept"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeats(table(spark, sf_dir, "documents"))
    return found.select(
        F.when(F.col("key") < substring_dedup.NO_KEY, F.col("key")).alias("doc_id"),
        F.col("a").cast("long").alias("start_byte"), F.col("b").cast("long").alias("end_byte"),
        F.when(F.col("first") < substring_dedup.NO_KEY, F.col("first")).alias("first_doc_id"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.when(~F.col("doc.unknown"), F.col("doc.key")).alias("doc_id"), "item_id",
        F.col("start").cast("long").alias("start_word"), F.col("n_words").cast("long").alias("n_words"), "similarity",
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.deduplicated(docs, removed="n_removed")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = vector_codes.compressed(table(spark, sf_dir, "embeddings"))
    return rows.select(
        "vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256")
    )


def looped(doc_id: int | None, n: int) -> np.ndarray | None:
    """The tail of one document in ten is a passage over and over: the places of the words to take."""
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.with_strongest(periodic_runs.runs(table(spark, sf_dir, "documents"), looped))
    of = F.col("strongest")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    every = F.concat_ws("", F.transform(lines, lambda line: F.concat(line, F.lit("\n"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        of["start"].alias("start"), of["length"].alias("length"), of["period"].alias("period"),
        ((1000 * of["length"] - (1000 * of["length"]) % of["period"]) / of["period"]).cast("long").alias("exponent_milli"),
        F.sha2(every, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_FOLDED = """translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""
_WORDS = r"""'[^\x20\x09-\x0D]+'"""

OP2_SQL = f"""
WITH i AS (SELECT item_id, regexp_extract_all({_FOLDED}, {_WORDS}) AS w FROM benchmark),
ib AS (SELECT item_id, len(w) AS n, p, array_to_string(w[p + 1:p + 5], ' ') AS s
       FROM (SELECT *, unnest(range(len(w) - 4)) AS p FROM i WHERE len(w) >= 5)),
d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, {_WORDS}) AS w FROM documents),
ds AS (SELECT doc_id, len(w) AS words, p, array_to_string(w[p + 1:p + 5], ' ') AS s
       FROM (SELECT *, unnest(range(len(w) - 4)) AS p FROM d WHERE len(w) >= 5)),
ic AS (SELECT item_id, n, s, count(*) AS k FROM ib GROUP BY ALL),
h AS (SELECT doc_id, item_id, n, words, ds.p, s FROM ds JOIN ic USING (s)),
c AS (SELECT DISTINCT doc_id, item_id, n, words,
             unnest(range(greatest(0, p - n + 5), least(p, greatest(0, words - n)) + 1)) AS start FROM h),
wk AS (SELECT c.doc_id, c.item_id, c.n, c.words, c.start, h.s, count(*) AS k
       FROM c JOIN h ON c.doc_id = h.doc_id AND c.item_id = h.item_id AND c.n = h.n AND h.p BETWEEN c.start AND c.start + c.n - 5
       GROUP BY ALL),
m AS (SELECT doc_id, item_id, wk.n, words, start, sum(least(wk.k, ic.k)) AS common
      FROM wk JOIN ic USING (item_id, n, s) GROUP BY ALL),
r AS (SELECT doc_id, item_id, start, least(n, words) AS n_words,
             common, least(n, words) - 4 + n - 4 - common AS either FROM m)
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start_word, CAST(n_words AS BIGINT) AS n_words,
       CAST(common AS DOUBLE) / CAST(either AS DOUBLE) AS similarity
FROM r WHERE common * 100 >= either * 75
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY common::DOUBLE / either::DOUBLE DESC, start) = 1"""

OP3_SQL = f"""
WITH p AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS k,
                  unnest(string_split(text, chr(10))) AS line FROM documents),
o AS (SELECT doc_id, k, doc_id * 1000000 + k AS place, line, regexp_extract_all(line, {_WORDS}) AS w FROM p),
u AS (SELECT w, len(w) AS n, min(place) AS first FROM o WHERE len(w) > 0 GROUP BY w),
v AS (SELECT w, n, first, i, list_concat(w[1:i], w[i + 2:n]) AS rest
      FROM (SELECT *, unnest(range(n)) AS i FROM u WHERE n >= 8)),
g AS (SELECT n, i, rest, min(first) AS best FROM v GROUP BY ALL),
e AS (SELECT n, rest, min(first) AS best FROM v GROUP BY ALL),
near AS (SELECT w FROM v JOIN g USING (n, i, rest) WHERE best < first
   UNION SELECT v.w FROM v JOIN u ON v.rest = u.w WHERE u.n >= 8 AND u.first < v.first
   UNION SELECT u.w FROM u JOIN e ON e.rest = u.w WHERE u.n >= 8 AND e.best < u.first),
f AS (SELECT o.doc_id, o.k, o.line,
             len(o.w) > 0 AND (o.place <> u.first OR near.w IS NOT NULL) AS gone
      FROM o LEFT JOIN u ON o.w = u.w LEFT JOIN near ON o.w = near.w),
t AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS text,
             count(*) FILTER (WHERE gone) AS n_removed FROM f GROUP BY doc_id)
SELECT d.doc_id, t.text, coalesce(t.n_removed, 0) AS n_removed FROM documents d LEFT JOIN t USING (doc_id)"""

_WHOLE = "CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)"


def _lloyd(rounds: int = vector_codes.ROUNDS) -> str:
    """The rounds one after the other: parts nearest to an entry, entries from their parts."""
    nearest = """a{k} AS MATERIALIZED (SELECT r, p.pos, min(16 * list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(p.x, c.x)]) + c.k) AS m
  FROM p JOIN c{k} c ON p.pos = c.pos GROUP BY ALL)"""
    entries = """c{n} AS MATERIALIZED (SELECT c.pos, c.k, coalesce(u.x, c.x) AS x FROM c{k} c LEFT JOIN (
  SELECT pos, k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
    SELECT pos, k, i, sum(v) AS s, count(*) AS n FROM (
      SELECT a.pos, a.m % 16 AS k, unnest(p.x) AS v, unnest(range(len(p.x))) AS i FROM a{k} a JOIN p ON a.r = p.r AND a.pos = p.pos)
    GROUP BY ALL) GROUP BY ALL) u ON c.pos = u.pos AND c.k = u.k)"""
    steps = [part.format(k=k, n=k + 1) for k in range(rounds) for part in (nearest, entries)]
    return ",\n".join([*steps, nearest.format(k=rounds)])


OP12_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, [{_WHOLE} FOR x IN embedding] AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
p AS MATERIALIZED (SELECT r, pos, e[pos * len(e) // 8 + 1:(pos + 1) * len(e) // 8] AS x FROM v, range(8) t(pos)),
c0 AS MATERIALIZED (SELECT pos, r - 1 AS k, x FROM p WHERE r <= 16),
{_lloyd()},
o AS (SELECT r, string_agg(lpad(lower(hex(m % 16)), 2, '0'), '' ORDER BY pos) AS code, sum(m // 16) AS error
      FROM a{vector_codes.ROUNDS} GROUP BY r),
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY pos, k, i)) AS codebooks_sha256 FROM (
        SELECT pos, k, unnest(x) AS x, unnest(range(len(x))) AS i FROM c{vector_codes.ROUNDS}))
SELECT vec_id, code, CAST(error AS BIGINT) AS error,
       CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM o JOIN v USING (r), h"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_toxicity": op8_toxicity,
    "op9_license_scan": op9_license_scan,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_packing": op11_packing,
    "op12_vector_codes": op12_vector_codes,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {
    "op2_decontamination": OP2_SQL,
    "op3_line_dedup": OP3_SQL,
    "op10_jaccard_join": OP10_SQL,
    "op12_vector_codes": OP12_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
