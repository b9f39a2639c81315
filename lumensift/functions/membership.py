"""Which rows can have a key of another table, told in the scan, so that only these are shuffled to meet it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import written

#: Bits of one bitmap of ``bitmap_construct_agg``.
PART = 32_768

#: Bits of a filter, at most (32 MB). With more than 2^24 keys, more rows pass that have none of them; what passes is joined exactly.
MOST_BITS = 1 << 28


def _place(columns: list[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*columns, F.lit(0x5EED)), F.lit(bits).cast("long")) + 1  # bitmap functions count from 1


def may_hold(keys: DataFrame, own: list[Column], n: int | None = None) -> Column:
    """A condition on rows whose key columns are own: true wherever keys (the same columns, in order) have it, and for about one of 16 others.

    The filter is a bitmap with 16 bits a key, made by an aggregation and read by a
    scalar subquery; the condition stays in the JVM. Null columns hash like any value.
    Keys are counted once, unless n tells how many there are at most; keys that repeat cost nothing more.
    """
    n = keys.count() if n is None else n
    bits = PART
    while bits < min(MOST_BITS, 16 * n):
        bits *= 2
    p = keys.select(_place([F.col(f"`{c}`") for c in keys.columns], bits).alias("p"))
    made = p.groupBy(F.bitmap_bucket_number("p").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    parts = keys.sparkSession.range(1, bits // PART + 1).withColumnRenamed("id", "part").join(made, "part", "left")
    ordered = F.array_sort(F.collect_list(F.struct("part", F.coalesce("bits", F.lit(b"")).alias("bits"))))
    table = written(parts.agg(F.transform(ordered, lambda x: x["bits"]).alias("parts")))
    place = _place(own, bits)
    at = F.bitmap_bit_position(place)
    bitmap = F.element_at(table.scalar(), F.bitmap_bucket_number(place).cast("int"))
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
