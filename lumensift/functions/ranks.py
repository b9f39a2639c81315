"""Row numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import written

def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """Adds name, 1 for the smallest key (unique) and so on."""
    return placed(df, [F.col(key)], name)


def placed(df: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """Adds name, the place from 1 of every row in an order without ties. Rows are dealt by ranges, and only the counts of the ranges meet in one task."""
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *order).withColumn("range_", F.spark_partition_id()))
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("range_").agg(F.count(F.lit(1)).alias("n_")).select("range_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    own = F.row_number().over(Window.partitionBy("range_").orderBy(*order))
    return dealt.withColumn("own_", own).join(counts, "range_").withColumn(name, F.col("own_") + F.col("before_")).drop("range_", "own_", "before_")


def neighbours(df: DataFrame, order: list[str], value: str, partitions: int | None = None) -> DataFrame:
    """Adds previous_value and next_value in the order of the columns, by range partitions and their ends."""
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *order).withColumn("range_", F.spark_partition_id()))  # once, so that both readers see the same ranges
    near = Window.partitionBy("range_").orderBy(*order)
    inner = dealt.withColumns({"previous_": F.lag(value).over(near), "next_": F.lead(value).over(near)})
    ends = dealt.groupBy("range_").agg(F.min_by(value, F.struct(*order)).alias("first_"), F.max_by(value, F.struct(*order)).alias("last_"))
    ranges = Window.orderBy("range_")
    borders = ends.select("range_", F.lag("last_").over(ranges).alias("before_"), F.lead("first_").over(ranges).alias("after_"))
    return inner.join(borders, "range_").withColumns({f"previous_{value}": F.coalesce("previous_", "before_"), f"next_{value}": F.coalesce("next_", "after_")}).drop("range_", "previous_", "next_", "before_", "after_")


@dataclass(frozen=True)
class OrderIndex:
    """A table dealt by ranges of an order without ties, one folder a range, and beside it the number, first and last row of each range."""

    folder: str
    order: tuple[str, ...]


def build_index(df: DataFrame, order: list[str], folder: str, partitions: int | None = None) -> OrderIndex:
    """Writes the order columns of df as an index, once for any number of questions; nulls come first."""
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.select(*order).repartitionByRange(parts, *order).withColumn("range_", F.spark_partition_id()).write.mode("overwrite").partitionBy("range_").parquet(f"{folder}/rows")
    key = F.struct(*order)
    rows = df.sparkSession.read.parquet(f"{folder}/rows")
    counts = rows.groupBy("range_").agg(F.count(F.lit(1)).alias("n_"), F.min(key).alias("first_"), F.max(key).alias("last_"))
    by = Window.orderBy("range_")  # a row a range
    before = F.coalesce(F.sum("n_").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts.select("range_", "n_", "first_", "last_", before.alias("before_"), F.lag("last_").over(by).alias("left_"), F.lead("first_").over(by).alias("right_")).write.mode("overwrite").parquet(f"{folder}/ranges")
    return OrderIndex(folder, tuple(order))


def asked_ranges(asked: DataFrame, index: OrderIndex) -> DataFrame:
    """asked (with the order columns) and the range_ that each row falls in, told from the ranges alone."""
    ranges = asked.sparkSession.read.parquet(f"{index.folder}/ranges")
    listed = ranges.agg(F.sort_array(F.collect_list(F.struct("first_", "range_"))).alias("listed_"))  # a row a range
    own = F.struct(*index.order)
    below = F.filter("listed_", lambda r: r["first_"] <= own)
    return asked.crossJoin(F.broadcast(listed)).withColumn("range_", F.try_element_at(below, F.lit(-1))["range_"]).drop("listed_")  # one row against all


def index_places(asked: DataFrame, index: OrderIndex) -> DataFrame:
    """asked with place (from 1), previous and next (structs of the order columns); only the ranges that asked rows fall in are read. Rows that the index lacks have no place."""
    spark = asked.sparkSession
    own = written(asked_ranges(asked, index))
    wanted = [r["range_"] for r in own.select("range_").distinct().collect() if r["range_"] is not None]  # as many as there are ranges, at most
    rows = spark.read.parquet(f"{index.folder}/rows").where(F.col("range_").isin(wanted))
    ranges = spark.read.parquet(f"{index.folder}/ranges").select("range_", "before_", "left_", "right_")
    key, near = F.struct(*index.order), Window.partitionBy("range_").orderBy(*index.order)
    told = rows.select("range_", key.alias("key_"), F.row_number().over(near).alias("nth_"), F.lag(key).over(near).alias("previous"), F.lead(key).over(near).alias("next")).join(F.broadcast(ranges), "range_")
    told = told.select("key_", (F.col("before_") + F.col("nth_")).alias("place"), F.coalesce("previous", "left_").alias("previous"), F.coalesce("next", "right_").alias("next"))
    return own.drop("range_").withColumn("key_", F.struct(*index.order)).join(told, "key_", "left").drop("key_")
