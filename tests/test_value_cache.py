"""The content-keyed cache: what is read, what is a miss, what compaction keeps."""

import os
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from lumensift.sources import value_cache as C

DAY = datetime(2025, 1, 1)


def rows(spark, first, last, day=1):
    return spark.range(first, last).select(F.sha1(F.col("id").cast("string")).alias("key"), F.array(F.col("id").cast("float")).alias("value"), F.lit(datetime(2025, 1, day)).alias("made_at"), "id")


def asked(spark, first, last):
    return rows(spark, first, last).select("key", "id")


def slots(df):
    return {os.path.basename(os.path.dirname(urlparse(f).path)) for f in df.inputFiles()}


@pytest.fixture
def small_slots(monkeypatch):
    monkeypatch.setattr(C, "SLOT_KEYS", 50)


def test_empty_and_missing_cache(spark, tmp_path):
    at = f"{tmp_path}/c"
    assert C.put(rows(spark, 0, 0), at) is None
    hits, lacking = C.lookup(asked(spark, 0, 3), at)
    assert (hits.count(), lacking.count()) == (0, 3)
    assert C.last_uses(spark, at).count() == 0
    assert C.compacted(spark, at, f"{tmp_path}/d", 5) == 0


def test_only_slots_of_asked_keys_are_read(spark, tmp_path, small_slots):
    at = f"{tmp_path}/c"
    C.put(rows(spark, 0, 1000), at)
    own = C.candidates(asked(spark, 7, 8).select("key"), at).collect()
    assert len(own) == 1
    got = C.read_slots(spark, at, [(own[0]["log"], own[0]["slot"])])
    assert slots(got) == {f"slot={own[0]['slot']}"} and got.count() < 100
    hits, lacking = C.lookup(asked(spark, 7, 8), at)
    assert [tuple(r["value"]) for r in hits.collect()] == [(7.0,)] and not lacking.count()


def test_misses_read_no_value(spark, tmp_path, small_slots):
    at = f"{tmp_path}/c"
    C.put(rows(spark, 0, 1000), at)
    absent = C.candidates(asked(spark, 5000, 9000).select("key"), at)
    assert absent.count() < 40  # 50 keys in 2^20 bits: far less than one of 16
    lone = [r for r in asked(spark, 5000, 5040).collect() if not absent.where(F.col("key") == r["key"]).count()][:1]
    hits, lacking = C.lookup(spark.createDataFrame(lone), at)
    assert hits.count() == 0 and lacking.count() == 1
    assert not [f for f in hits.inputFiles() if "/values/" in f]


def test_unusable_values_keys_and_files_are_misses(spark, tmp_path, small_slots):
    at = f"{tmp_path}/c"
    odd = spark.createDataFrame([("a", [], DAY), ("b", None, DAY), (None, [1.0], DAY), ("c", [2.0], DAY), ("c", [3.0], datetime(2025, 2, 1))], "key string, value array<float>, made_at timestamp")
    C.put(odd, at)
    hits, lacking = C.lookup(spark.createDataFrame([("a",), ("b",), (None,), ("c",), ("c",)], "key string"), at)
    assert [tuple(r["value"]) for r in hits.collect()] == [(3.0,), (3.0,)]
    assert sorted(str(r["key"]) for r in lacking.collect()) == ["None", "a", "b"]

    at = f"{tmp_path}/d"
    log = C.put(rows(spark, 0, 500), at)
    broken = sorted(os.listdir(f"{at}/values/log={log}"))
    broken = next(f for f in broken if f.startswith("slot="))
    for f in os.listdir(f"{at}/values/log={log}/{broken}"):
        os.remove(f"{at}/values/log={log}/{broken}/{f}") if f.startswith(".") else open(f"{at}/values/log={log}/{broken}/{f}", "wb").write(b"no parquet at all")
    hits, lacking = C.lookup(asked(spark, 0, 500), at)
    gone = {r["key"] for r in lacking.collect()}
    assert gone == {r["key"] for r in C.candidates(asked(spark, 0, 500).select("key"), at).where(F.concat(F.lit("slot="), F.col("slot").cast("string")) == broken).collect()}
    assert 0 < len(gone) < 200 and hits.count() == 500 - len(gone)


def test_writers_at_once_and_unfinished_puts(spark, tmp_path):
    at = f"{tmp_path}/c"
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda n: C.put(rows(spark, n * 10, n * 10 + 15), at), range(3)))
    rows(spark, 90, 95).drop("id").withColumn("slot", F.lit(0)).write.partitionBy("slot").parquet(f"{at}/values/log=unfinished")
    hits, lacking = C.lookup(asked(spark, 0, 95), at)
    assert sorted(r["id"] for r in hits.collect()) == list(range(35))
    assert lacking.count() == 60 and C.last_uses(spark, at).count() == 35


def test_compaction_keeps_what_was_used_last(spark, tmp_path, small_slots):
    at, into = f"{tmp_path}/c", f"{tmp_path}/d"
    C.put(rows(spark, 0, 100, day=1), at)
    C.put(rows(spark, 90, 120, day=2), at)  # ten keys again
    C.note_use(asked(spark, 0, 5), at, datetime(2025, 1, 3))
    C.note_use(asked(spark, 0, 2), at, datetime(2025, 1, 2))  # an older use changes nothing
    assert C.compacted(spark, at, into, 30) == 30
    kept = {r["id"] for r in C.lookup(asked(spark, 0, 120), into)[0].collect()}
    assert set(range(5)) < kept and len(kept) == 30 and kept < set(range(5)) | set(range(90, 120))
    assert C.lookup(asked(spark, 0, 120), at)[0].count() == 120  # the old one stays
    assert C.compacted(spark, into, f"{tmp_path}/e", 5) == 5  # uses went along
    assert {r["id"] for r in C.lookup(asked(spark, 0, 120), f"{tmp_path}/e")[0].collect()} == set(range(5))
