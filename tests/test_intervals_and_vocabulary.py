"""Interval joins and vocabularies against plain loops, with busy buckets and many values."""

import random

import pytest

from duecourse.operators import features as X
from duecourse.operators import intervals as I
from duecourse.operators import vocabulary as V


@pytest.mark.parametrize("width", [1, 4, 50])
def test_points_in_intervals(spark, width):
    draw = random.Random(width)
    # a third of the points at one place, one without a place
    points = [(k, 7 if k % 3 == 0 else draw.randrange(-40, 40)) for k in range(300)] + [(300, None)]
    spans = [(k, a, a + draw.randrange(-2, 30)) for k in range(40) for a in [draw.randrange(-45, 40)]]
    spans += [(40, None, 5), (41, 5, None)]
    got = I.points_in_intervals(
        spark.createDataFrame(points, "id int, at int"), spark.createDataFrame(spans, "no int, first int, last int"),
        "at", "first", "last", width, ["id"],
    )
    want = sorted((i, n) for i, at in points for n, a, b in spans
                  if None not in (at, a, b) and a <= at <= b)
    assert sorted((r["id"], r["no"]) for r in got.collect()) == want
    assert got.columns == ["id", "at", "no", "first", "last"]


@pytest.mark.parametrize("width", [1, 5, 60])
def test_overlapping(spark, width):
    draw = random.Random(width)

    def spans(n):
        return [(k, a, a + draw.randrange(-1, 25)) for k in range(n) for a in [draw.randrange(-50, 50)]]

    left, right = spans(60), [*spans(60), (99, None, 3), (98, -50, 80), (98, -50, 80)]
    got = I.overlapping(
        spark.createDataFrame(left, "l int, a int, b int"), spark.createDataFrame(right, "r int, c int, d int"),
        ("a", "b"), ("c", "d"), width,
    )
    want = sorted((x, y) for x, a, b in left for y, c, d in right
                  if None not in (c, d) and a <= b and c <= d and a <= d and c <= b)
    assert sorted((r["l"], r["r"]) for r in got.collect()) == want


def test_interval_joins_need_no_nested_loop(spark):
    points = spark.range(2000).selectExpr("id", "CAST(id % 100 AS INT) AS at")
    spans = spark.range(500).selectExpr("id AS no", "CAST(id % 90 AS INT) AS first", "CAST(id % 90 + 5 AS INT) AS last")
    plans = (
        I.points_in_intervals(points, spans, "at", "first", "last", 10, ["id"]),
        I.overlapping(spans, spans.toDF("r", "c", "d"), ("first", "last"), ("c", "d"), 10),
    )
    for frame in plans:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_intervals_of_empty_tables(spark):
    none = spark.createDataFrame([], "id int, at int")
    spans = spark.createDataFrame([(1, 2, 3)], "no int, first int, last int")
    assert I.points_in_intervals(none, spans, "at", "first", "last", 3, ["id"]).count() == 0
    assert I.points_in_intervals(spark.createDataFrame([(1, 2)], "id int, at int"), spans.limit(0), "at", "first", "last", 3, ["id"]).count() == 0


def cells(n):
    """A column with a value in a third of the rows, missing ones, and many rare ones."""
    return [None if k % 7 == 0 else "hot" if k % 3 == 0 else f"é{k % 900:04d}" if k % 2 else f"Z{k}" for k in range(n)]


@pytest.mark.parametrize("few", [0, 10_000])
def test_codes_by_ranges(spark, few):
    values = cells(3000)
    rows = spark.createDataFrame([(k, v, "x") for k, v in enumerate(values)], "id int, c string, d string").repartition(5)
    table = V.learned(rows, ["c", "d"])
    order = sorted({v for v in values if v is not None}, key=lambda v: v.encode())
    assert [(r["value"], r["n"]) for r in table.filter("column = 'c'").orderBy("code").collect()] == [
        (v, values.count(v)) for v in order
    ]
    assert sorted(r["code"] for r in table.filter("column = 'c'").collect()) == list(range(len(order)))
    probe = spark.createDataFrame([*enumerate([*values, "unseen"])], "id int, c string")
    got = {r["id"]: r["c_code"] for r in V.coded(probe, table, ["c"], few).collect()}
    places = {v: float(k) for k, v in enumerate(order)}
    assert got == {k: places.get(v) for k, v in enumerate([*values, "unseen"])}


def test_estimator_keeps_many_values_as_a_table(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(X, "LISTED", 2)
    train = spark.createDataFrame([("a", "u"), ("b", "v"), ("c", None)], "many string, few string")
    model = X.Vocabulary(columns=["many", "few"], folder=str(tmp_path / "codes")).fit(train)
    assert model.categories == {"few": ["u", "v"]}
    model.save(str(tmp_path / "model"))
    seen = spark.createDataFrame([("c", "v"), ("z", None)], "many string, few string")
    back = X.VocabularyModel.load(str(tmp_path / "model")).transform(seen)
    assert sorted(map(tuple, back.select("many", "many_code", "few_code").collect())) == [("c", 2.0, 1.0), ("z", None, None)]


def test_vocabulary_of_an_empty_table(spark):
    none = spark.createDataFrame([], "c string")
    assert V.learned(none, ["c"]).count() == 0
    assert [r["c_code"] for r in V.coded(spark.createDataFrame([("a",)], "c string"), V.learned(none, ["c"]), ["c"]).collect()] == [None]
