"""Row numbers and neighbours equal one sort, however rows are dealt."""

import random

import pytest
from pyspark.sql import functions as F

from lumensift.functions.ranks import asked_ranges, build_index, index_places, neighbours, numbered, placed
from lumensift.operators.graph import components
from lumensift.streaming import decisions


def test_numbers(spark):
    ids = random.Random(1).sample(range(-50, 500), 60)
    df = spark.createDataFrame([(i,) for i in ids], "k long").repartition(7)
    assert {r["k"]: r["n"] for r in numbered(df, "k", "n").collect()} == {k: n for n, k in enumerate(sorted(ids), 1)}
    assert numbered(df.limit(0), "k", "n").count() == 0


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_neighbours(spark, parts):
    rng = random.Random(2)
    rows = [(rng.randrange(5), i) for i in range(40)]
    got = {r["idx"]: (r["previous_idx"], r["next_idx"]) for r in neighbours(spark.createDataFrame(rows, "g int, idx long").repartition(4), ["g", "idx"], "idx", parts).collect()}
    order = [i for _, i in sorted(rows)]
    assert got == {i: (order[n - 1] if n else None, order[n + 1] if n + 1 < len(order) else None) for n, i in enumerate(order)}


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_places(spark, parts):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(rng.randrange(9), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, idx long").repartition(4)
    got = {r["idx"]: r["n"] for r in placed(df, [-F.col("g"), F.col("idx")], "n", parts).collect()}
    assert got == {i: n for n, (_, i) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1)}
    assert placed(df.limit(0), [F.col("idx")], "n", parts).count() == 0


def test_long_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, j) for j in range(10, 40)]
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[j] for j in range(10, 40)} == {5}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_latest_and_merge(spark):
    events = spark.createDataFrame([(1, "2024-01-01", 7, "a"), (2, "2024-01-02", 7, "b"), (3, "2024-01-02", 7, "c")], "event_id long, ts string, user_id long, event_type string")
    assert [tuple(r) for r in decisions.latest(events).select("user_id", "event_type").collect()] == [(7, "c")]
    state = spark.createDataFrame([("/a", "S", "人工已确认"), ("/b", "B", "AI已审")], "path string, quality_rating string, review_status string")
    new = spark.createDataFrame([("/a", "X", "AI已审"), ("/b", "A", "AI已审"), ("/c", "C", "AI已审")], "path string, quality_rating string, review_status string")
    assert {r["path"]: r["quality_rating"] for r in decisions.protected_merge(state, new).collect()} == {"/a": "S", "/b": "A", "/c": "C"}


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_places_from_an_index(spark, tmp_path, parts):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", "ü", None]), i) for i in rng.sample(range(10_000), 300)]
    df = spark.createDataFrame(rows, "name string, idx long").repartition(3)
    index = build_index(df, ["name", "idx"], str(tmp_path / "index"), parts)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    asked = rng.sample(rows, 12)
    frame = spark.createDataFrame([*asked, ("zz", 1), (None, -5)], "name string, idx long").withColumn("more", F.lit(1))
    got = {(r["name"], r["idx"]): (r["place"], r["previous"] and tuple(r["previous"]), r["next"] and tuple(r["next"])) for r in index_places(frame, index).collect()}
    at = {r: n for n, r in enumerate(order)}
    for r in asked:
        n = at[r]
        assert got[r] == (n + 1, order[n - 1] if n else None, order[n + 1] if n + 1 < len(order) else None)
    assert got["zz", 1] == got[None, -5] == (None, None, None) and len(got) == 14
    assert asked_ranges(frame, index).select("range_").distinct().count() <= min(parts, 14) + 1
