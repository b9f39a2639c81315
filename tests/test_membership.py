"""A filter by a table's keys holds all of them and few others, and its rows are told in the scan."""

from pyspark.sql import functions as F

from lumensift.functions import membership


def test_may_hold(spark, monkeypatch):
    rows = spark.range(40_000).select(F.when(F.col("id") % 97 > 0, F.col("id")).alias("a"), (F.col("id") % 5).cast("string").alias("b"), F.col("id").alias("n"))
    keys = rows.where("n % 13 = 0").select("a", F.col("b").alias("odd name"))
    for most in (1 << 28, 1 << 15):
        monkeypatch.setattr(membership, "MOST_BITS", most)
        hit = membership.may_hold(keys, [F.col("a"), F.col("b")])
        found = rows.where(hit)
        assert found.where("n % 13 = 0").count() == rows.where("n % 13 = 0").count()
        assert rows.where(~hit).count() == rows.count() - found.count()
        if most > 1 << 20:
            assert found.count() < keys.count() + rows.count() / 12
            assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert rows.where(membership.may_hold(keys.limit(0), [F.col("a"), F.col("b")])).count() == 0


def test_keys_are_counted_once(spark, monkeypatch):
    """Each doubling of the filter counted the keys anew; a bound that is known needs no count, and keys may repeat."""
    keys, counted = spark.range(20_000).where("id % 2 = 0"), []
    kind, real = type(keys), type(keys).count
    monkeypatch.setattr(kind, "count", lambda self: counted.append(1) or real(self))
    membership.may_hold(keys, [F.col("id")])
    assert len(counted) == 1
    hit = membership.may_hold(keys.unionByName(keys), [F.col("id")], 20_000)
    assert len(counted) == 1
    monkeypatch.undo()
    found = spark.range(40_000).where(hit)
    assert found.where("id < 20000 AND id % 2 = 0").count() == 10_000 and found.count() < 10_000 + 40_000 / 12
