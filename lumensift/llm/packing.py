"""Conflict-constrained best-fit packing.

Documents become pieces of at most ``capacity`` tokens (white-space words), in
order and without loss; pieces are put into bins of that capacity, longest first,
each into the compatible bin with the least room left. Bins lie in lists by
residual; a successor search starts at the piece's size and goes up until a bin
without a conflict is found, and if there is none a new bin is opened, so a piece
always has a place. A bin holds at most ``per_source`` pieces of one source and
one piece of a duplicate cluster; it carries both as bitmaps: bit planes over the
source numbers and bits over the cluster numbers of its shard.

Packing is sequential, so pieces are dealt by hash into shards of about
``SHARD_PIECES`` pieces, whose number follows the count of pieces; bins never
span shards. Repeated rows, which would all have one hash, are counted and dealt by
their number among equals, so a row that stands often fills no shard. Only ids, sources, cluster hashes and sizes are shuffled, not texts.

Ids are whole numbers, or text that reads as one.

Defined results: null, blank and empty texts have no token and no piece; a null
source is a source of its own; a null id is packed like any other; documents with
equal texts are a cluster (unless a cluster column is given, whose nulls conflict
with nothing); repeated rows have equal texts and so never share a bin; ties are
broken by id, then by text hash, then piece; an empty table gives no rows. Input
columns other than those named are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durable import written

CAPACITY = 2048
PER_SOURCE = 4
SHARD_PIECES = 4096

SCHEMA = "shard long, bin long, doc_id long, piece int, first_word long, n_tokens long"


def token_count(text: Column) -> Column:
    """White-space words ([^ \\t\\n\\x0b\\f\\r]+) of a text."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(plain, " "), "")).cast("long")


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[int]:
    """The bin of each piece, given in packing order. Clusters below 0 conflict with nothing."""
    by_room: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]  # room: bins as (number, source planes, clusters)
    rooms: list[int] = []  # with bins, in order
    out, opened = [], 0
    for size, source, cluster in zip(sizes, sources, clusters):
        planes = ((1 << per_source) - 1) << (source * per_source)
        full = 1 << (source * per_source + per_source - 1)
        bit = 1 << cluster if cluster >= 0 else 0
        at = bisect_left(rooms, size)
        found = None
        while at < len(rooms) and found is None:
            bins = by_room[rooms[at]]
            for j, (_, held, taken) in enumerate(bins):
                if not held & full and not taken & bit:
                    found = (rooms[at], bins.pop(j))
                    if not bins:
                        rooms.pop(at)
                    break
            else:
                at += 1
        room, (number, held, taken) = found or (capacity, (opened, 0, 0))
        opened += found is None
        out.append(number)
        room -= size
        if room:  # the planes of a source fill from below: one more bit each
            grown = held & planes
            held |= (grown << 1 | 1 << (source * per_source)) & planes
            if not by_room[room]:
                insort(rooms, room)
            insort(by_room[room], (number, held, taken | bit))
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None) -> DataFrame:
    """doc_id, h (text hash), source, cluster, piece, first_word and n_tokens of every piece."""
    mark = F.xxhash64(F.col(text)) if cluster is None else F.col(cluster).cast("long")
    sized = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.coalesce(F.xxhash64(F.when(F.col(source).isNotNull(), F.col(source))), F.lit(0)).alias("source"), mark.alias("cluster"), token_count(F.col(text)).alias("n"))
    cut = sized.where("n > 0").select("doc_id", "h", "source", "cluster", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity))).alias("piece"))
    first = F.col("piece") * capacity
    return cut.select("doc_id", "h", "source", "cluster", F.col("piece").cast("int").alias("piece"), first.alias("first_word"), F.least(F.lit(capacity).cast("long"), F.col("n") - first).alias("n_tokens"))


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, key: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None) -> DataFrame:
    """shard, bin (in its shard), doc_id, piece, first_word and n_tokens of every piece."""
    each = pieces(docs, capacity, key, text, source, cluster)
    cut = written(each.groupBy(*each.columns).agg(F.count(F.lit(1)).alias("times")))
    shards = max(1, -(-(cut.agg(F.sum("times")).first()[0] or 0) // SHARD_PIECES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(shard)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)]):
                if a == b:
                    continue
                if held and shard[a] != now:
                    yield _packed(held, capacity, per_source)
                    held = []
                now = shard[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield _packed(held, capacity, per_source)

    every = cut.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    dealt = every.withColumn("shard", F.pmod(F.xxhash64("doc_id", "h", "piece", "nth"), F.lit(shards)))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["shard", F.desc("n_tokens"), "doc_id", "h", "piece"]
    rows = dealt.select("shard", "doc_id", "h", "source", "cluster", "piece", "first_word", "n_tokens").repartition(min(parts, shards), "shard").sortWithinPartitions(*order)
    return rows.mapInArrow(run, SCHEMA)


def _packed(held: list[pa.RecordBatch], capacity: int, per_source: int) -> pa.RecordBatch:
    t = pa.Table.from_batches(held).combine_chunks()
    _, source = np.unique(t["source"].to_numpy(), return_inverse=True)
    mark = t["cluster"].combine_chunks()
    values, number = np.unique(mark.fill_null(0).to_numpy(), return_inverse=True)
    number = np.where(mark.is_null().to_numpy(zero_copy_only=False), -1, number)
    # only clusters with two pieces in the shard can conflict, so only they need a bit
    several = np.bincount(number[number >= 0], minlength=len(values)) > 1
    bit = np.cumsum(several) - 1
    number = np.where((number >= 0) & several[number], bit[number], -1)
    bins = best_fit(t["n_tokens"].to_pylist(), source.tolist(), number.tolist(), capacity, per_source)
    columns = {"shard": t["shard"], "bin": pa.array(bins, pa.int64()), **{c: t[c] for c in ("doc_id", "piece", "first_word", "n_tokens")}}
    return pa.Table.from_pydict(columns).combine_chunks().to_batches()[0]


def bins(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row a bin: shard, bin, n_pieces, n_tokens and room."""
    return packed.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("n_tokens")).withColumn("room", capacity - F.col("n_tokens"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
