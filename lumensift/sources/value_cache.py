"""A cache of values by the digest of what they were made from (a file's path, size and time, and a model), of bounded size.

Each ``put`` is a folder of its own, so that writers don't meet. Its values are dealt by the hash of their keys
to slots of about SLOT_KEYS keys, one folder a slot, and beside them lies a bitmap of each slot's keys. ``lookup`` asks the
bitmaps first: a key that none may hold is a miss without a look at any value, and only the slots that may hold
an asked key are read. What isn't asked for longest is left out by ``compacted``.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.durable import written
from ..functions.ranks import placed

#: Keys of a slot, about: with vectors of 512 floats, 128 MB.
SLOT_KEYS = 65_536

#: Bits of a slot's filter, 16 a key, in parts as ``bitmap_construct_agg`` makes them. About one absent key of 16 passes a full slot's filter.
SLOT_BITS, PART_BITS = 1 << 20, 1 << 15

#: The type of values, unless another is named.
VECTOR = "array<float>"


def _slot(slots: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(slots)).cast("int")


def _bit() -> Column:
    """Place from 1 (bitmap functions count so) of a key in its slot's filter."""
    return F.pmod(F.xxhash64("key", F.lit(0x5107)), F.lit(SLOT_BITS).cast("long")) + 1


def _schema(value: str) -> str:
    return f"key string, value {value}, made_at timestamp"


def put(rows: DataFrame, path: str) -> str | None:
    """Adds rows (key, value, made_at) as one log, which counts once its filters are written; returns its name. Rows without a key, and null or empty values, aren't kept, and of equal keys the newest is."""
    usable = F.col("key").isNotNull() & F.col("value").isNotNull()
    if isinstance(rows.schema["value"].dataType, ArrayType):
        usable &= F.size("value") > 0
    kept = written(rows.where(usable).groupBy("key").agg(F.max_by("value", "made_at").alias("value"), F.max("made_at").alias("made_at")))
    n = kept.count()
    if not n:
        return None
    log, slots = uuid.uuid4().hex, -(-n // SLOT_KEYS)
    kept.withColumn("slot", _slot(slots)).repartition("slot").write.partitionBy("slot").parquet(f"{path}/values/log={log}")
    bits = kept.select(_slot(slots).alias("slot"), _bit().alias("bit"))
    filters = bits.groupBy("slot", F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    filters.withColumn("slots", F.lit(slots)).write.parquet(f"{path}/filters/log={log}")
    return log


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _filters(spark: SparkSession, path: str) -> DataFrame | None:
    if not _exists(spark, f"{path}/filters"):
        return None
    return spark.read.schema("slot int, part long, bits binary, slots int, log string").parquet(f"{path}/filters")


def _logs(filters: DataFrame) -> list[tuple[str, int]]:
    """Name and number of slots of each log: as many as there were puts since the cache was compacted."""
    return sorted((r["log"], r["slots"]) for r in filters.select("log", "slots").distinct().collect())


def candidates(keys: DataFrame, path: str) -> DataFrame:
    """key, log and slot wherever a slot may hold one of keys (distinct); told from the filters alone."""
    spark = keys.sparkSession
    filters = _filters(spark, path)
    logs = _logs(filters) if filters is not None else []
    if not logs:
        return keys.select("key", F.lit("").alias("log"), F.lit(0).alias("slot")).limit(0)
    places = F.array(*(F.struct(F.lit(log).alias("log"), _slot(slots).alias("slot")) for log, slots in logs))
    probes = keys.select("key", F.inline(places)).withColumns({"part": F.bitmap_bucket_number(_bit()), "at": F.bitmap_bit_position(_bit())})
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return probes.join(filters.drop("slots"), ["log", "slot", "part"]).where(F.getbit(byte, (F.col("at") % 8).cast("int")) == 1).select("key", "log", "slot")


def read_slots(spark: SparkSession, path: str, slots: list[tuple[str, int]], value: str = VECTOR) -> DataFrame:
    """key, value and made_at of some slots (log, slot); a file that can't be read has no rows, so its keys are misses."""
    if not slots:
        return spark.createDataFrame([], _schema(value))
    folders = [f"{path}/values/log={log}/slot={slot}" for log, slot in slots]
    return spark.read.schema(_schema(value)).option("ignoreCorruptFiles", True).option("basePath", f"{path}/values").parquet(*folders).select("key", "value", "made_at")


def lookup(items: DataFrame, path: str, value: str = VECTOR) -> tuple[DataFrame, DataFrame]:
    """Items (with column key) whose value is in the cache, with value; and the others. A null key is a miss; items of equal keys get the same value."""
    spark = items.sparkSession
    may = written(candidates(items.select("key").where(F.col("key").isNotNull()).distinct(), path))
    wanted = sorted((r["log"], r["slot"]) for r in may.select("log", "slot").distinct().collect())  # as many as there are slots, at most
    own = read_slots(spark, path, wanted, value).join(may.select("key").distinct(), "key", "left_semi")
    newest = own.groupBy("key").agg(F.max_by("value", "made_at").alias("value"))
    both = items.join(newest, "key", "left")
    return both.where(F.col("value").isNotNull()), both.where(F.col("value").isNull()).drop("value")


def note_use(keys: DataFrame, path: str, at: datetime | Column) -> None:
    """Notes that keys (column key) were asked at a time; each once."""
    when = at if isinstance(at, Column) else F.lit(at)
    keys.where(F.col("key").isNotNull()).select("key", when.alias("at")).groupBy("key").agg(F.max("at").alias("at")).write.mode("append").parquet(f"{path}/uses")


def last_uses(spark: SparkSession, path: str) -> DataFrame:
    """key and last: when each key was last put or asked. Reads no values."""
    filters = _filters(spark, path)
    logs = _logs(filters) if filters is not None else []
    if not logs:
        return spark.createDataFrame([], "key string, last timestamp")
    puts = spark.read.schema("key string, made_at timestamp").option("ignoreCorruptFiles", True).option("basePath", f"{path}/values").parquet(*(f"{path}/values/log={log}" for log, _ in logs))
    last = puts.groupBy("key").agg(F.max("made_at").alias("last"))
    if not _exists(spark, f"{path}/uses"):
        return last
    uses = spark.read.schema("key string, at timestamp").parquet(f"{path}/uses").groupBy("key").agg(F.max("at").alias("at"))
    return last.join(uses, "key", "left").select("key", F.greatest("last", "at").alias("last"))


def compacted(spark: SparkSession, path: str, into: str, most: int, value: str = VECTOR) -> int:
    """Writes the most values that were used last (ties by key) as a cache of one log in another folder, with their times of use; returns how many. The old folder stays as it is, so its readers lose nothing."""
    kept = written(placed(last_uses(spark, path), [F.desc("last"), F.asc("key")], "place").where(F.col("place") <= most).select("key", "last"))
    filters = _filters(spark, path)
    slots = sorted((r["log"], r["slot"]) for r in filters.select("log", "slot").distinct().collect()) if filters is not None else []
    put(read_slots(spark, path, slots, value).join(kept.select("key"), "key", "left_semi"), into)
    note_use(kept, into, F.col("last"))
    return kept.count()
