"""Live tables, places of all rows, counters of drift bins."""

import random

import pytest
from pyspark.sql import functions as F

from duecourse.operators import drift, ordering
from duecourse.registry import LOANS
from duecourse.session import path_of, stored
from duecourse.streaming import live, scoring
from duecourse.streaming.live import LiveTable


def numbers(rows):
    return sorted(tuple(r) for r in rows.collect())


def test_live_table_shows_committed_batches_once(spark, tmp_path):
    table = LiveTable(str(tmp_path / "t"), "k string, n long", ("k",), ("n",)).create(spark)
    batch = lambda *rows: spark.createDataFrame(rows, "k string, n long")
    assert table.read(spark).count() == 0
    table.write(batch(("a", 1), ("b", 2)), 0)
    table.write(batch(("a", 10)), 1)
    table.write(batch(("a", 10)), 1)  # the same batch again
    assert numbers(table.read(spark)) == [("a", 11), ("b", 2)]
    # A batch that failed before its commit is not seen, and replaces what it left when it comes again.
    batch(("a", 500)).write.parquet(f"{table.path}/data/batch_id=2")
    assert numbers(table.read(spark)) == [("a", 11), ("b", 2)]
    table.write(batch(("c", 5)), 2)
    table.compact(spark)
    assert table.by_batch(spark).count() == 0
    # A compaction that failed before its commit is not seen either.
    batch(("a", 999)).write.parquet(f"{table.path}/compacted/upto=7")
    table.write(batch(("a", 100)), 3)
    assert numbers(table.create(spark).read(spark)) == [("a", 111), ("b", 2), ("c", 5)]
    assert numbers(table.by_batch(spark).select("batch_id", "k", "n")) == [(3, "a", 100)]


def test_places_with_a_value_that_half_the_rows_share(spark):
    rng = random.Random(3)
    rows = [("x" if i % 3 else "y", 0.5 if rng.random() < 0.5 else round(rng.random(), 2), i) for i in range(900)]
    rows += [("x", None, 2000), ("z", 1.0, 5), ("z", 1.0, 5)]
    df = spark.createDataFrame(rows, "key string, v double, id long")
    got = numbers(ordering.row_places(df, "v", "id", "key").select("key", "place", "v", "id"))
    expected = []
    for key in "xyz":
        own = sorted((v, i) for k, v, i in rows if k == key and v is not None)
        expected += [(key, place, v, i) for place, (v, i) in enumerate(own, 1)]
    assert got == expected


@pytest.mark.parametrize("counters", [3, 256])
def test_counters_count_what_unfolded_rows_do(spark, random_loans, monkeypatch, counters):
    monkeypatch.setattr(drift, "COUNTERS", counters)
    registry = LOANS
    base = drift.monitored(stored(random_loans(300, 1), "base").withColumn("pd", F.rand(1)), registry)
    now = random_loans(200, 2).withColumns({
        "pd": F.rand(2), "purpose": F.when(F.col("id") % 5 == 0, "it's \\ new").otherwise(F.col("purpose")),
        "dti": F.when(F.col("id") % 7 == 0, None).otherwise(F.col("dti")),
    })
    edges = stored(drift.reference_edges(base, registry), "edges")
    if counters == 3:  # many parts: a few features are enough
        edges = stored(edges.filter("feature IN ('purpose', 'dti', 'pd')"), "edges")
    rows = stored(drift.monitored(now, registry), "now")
    packed = drift.bin_counts(rows, edges, registry, [])
    assert numbers(packed.select("feature", F.coalesce("bin", F.lit("?")), "n")) == numbers(
        drift.sample_counts(rows, edges, registry).select("feature", F.coalesce("bin", F.lit("?")), "n"))
    assert packed.filter("bin LIKE 'it%new'").first()["n"] == 40


def test_ledger_tells_chunks_whatever_the_batches(spark, random_loans, tmp_path):
    loans = stored(random_loans(400, 9).filter("issue_d < '2013-06-01'"), "replayed")
    requests = str(tmp_path / "requests")
    scoring.write_requests_by_month(loans, LOANS, requests, chunk=3)
    sizes = loans.groupBy(F.date_format("issue_d", "yyyy-MM").alias("m")).count().orderBy("m").collect()
    expected, start = [], 0
    for month, n in sizes:
        chunks = -(-n // 3)
        expected.append((month, n, chunks, min(n, 3), start, start + chunks - 1))
        start += chunks
    assert start > 8
    for files in (4, 1000):
        table = live.ledger(str(tmp_path / f"ledger-{files}")).create(spark)
        lines = scoring.body_stream(spark, requests, files_per_batch=files)
        progress = str(tmp_path / f"progress-{files}")
        scoring.record_arrivals(lines, table, progress).awaitTermination()
        found = live.arrivals(spark, table).groupBy("month").agg(
            F.sum("n_rows"), F.count("*"), F.max("n_rows"), F.min("arrival"), F.max("arrival"))
        assert numbers(found) == expected
        assert table.by_batch(spark).select("batch_id").distinct().count() == -(-start // files)


def test_a_streamed_batch_is_parsed_once(spark, random_loans, tmp_path, monkeypatch):
    """The counters read a stored batch and stored edges, and count what the batch job does."""
    loans = stored(random_loans(60, 11).withColumns({"pd": F.lit(0.2), "decision": F.lit("approve")}), "logged")
    rows = drift.monitored(loans, LOANS)
    edges = stored(drift.reference_edges(rows, LOANS).filter("feature IN ('purpose', 'dti')"), "edges")
    count, read = drift.bin_counts, []

    def watched(rows, edges, registry, keep):
        read.append((path_of(rows), path_of(edges)))
        return count(rows, edges, registry, keep)

    monkeypatch.setattr(drift, "bin_counts", watched)
    stream = spark.readStream.schema(loans.schema).parquet(path_of(loans))
    counts = str(tmp_path / "counts")
    scoring.count_bins(stream, edges, LOANS, counts, str(tmp_path / "progress")).awaitTermination()
    assert len(read) == 1
    shown = ("month", "feature", F.coalesce("bin", F.lit("?")), "n")
    expected = count(stored(rows, "rows"), edges, LOANS, ["month"])
    assert numbers(scoring.counted_bins(spark, counts).select(*shown)) == numbers(expected.select(*shown))
