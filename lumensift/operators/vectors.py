"""Exact best matches of vectors with any number of labels.

Labels are numbered in the order of their names, dealt into blocks of equal size by norm, and
taken in passes of as many blocks as ``PASS_BYTES`` hold. A pass broadcasts its blocks and
reads the items once, without a shuffle: products of blocks are matrix products, a block whose
norms put it farther away than what an item has found already isn't multiplied
(the distance is at least the difference of the norms), and what comes close is measured again
as a difference, so that ties are exact. A pass emits the best ``k`` of an item and, for
probabilities, a logarithm of a sum of exponentials as a maximum and a sum beside it; both merge by item.

Defined results: items and labels without a vector, with another length than the first label's, or with a
component that is null or no number have no match; equal distances (or cosines) are ordered by label; equal
labels count each; vectors of length 0 have cosine 0; without labels there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durable import written
from ..functions.ranks import placed

#: Labels of a block, and bytes of the blocks of a pass.
BLOCK = 512
PASS_BYTES = 32 << 20

#: Items compared at once.
ROWS = 2048


@dataclass
class Block:
    vectors: np.ndarray
    places: np.ndarray  # in the order of labels
    least: float  # of the norms
    most: float


def _usable(vector: Column, size: int) -> Column:
    return F.coalesce((F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))), F.lit(False))


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least values of each row (rows, values, places), by value, then place."""
    row, value, place = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((place, value, row))
    row, value, place = row[order], value[order], place[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    keep = nth < k
    return row[keep], value[keep], place[keep]


def nearest_in(x: np.ndarray, blocks: list[Block], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, squared distance and place of the k nearest vectors of each row of x."""
    norms = np.sqrt(np.einsum("ij,ij->i", x, x))
    found = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    worst = np.full(len(x), np.inf)  # of the k best so far
    middle = float(np.median(norms)) if len(norms) else 0.0
    for b in sorted(blocks, key=lambda b: max(b.least - middle, middle - b.most, 0.0)):
        slack = 1e-9 * (norms * norms + b.most * b.most + 1)
        bound = np.maximum(np.maximum(b.least - norms, norms - b.most), 0)
        open_ = np.flatnonzero(bound * bound <= worst + slack)
        if not len(open_):
            continue
        own = x[open_]
        about = norms[open_, None] ** 2 + np.einsum("ij,ij->i", b.vectors, b.vectors) - 2 * own @ b.vectors.T
        limit = np.minimum(worst[open_], np.partition(about, min(k, about.shape[1]) - 1, 1)[:, min(k, about.shape[1]) - 1] if about.shape[1] >= k else np.inf)
        r, c = np.nonzero(about <= (limit + 2 * slack[open_])[:, None])
        d = own[r] - b.vectors[c]
        found = _best([found, (open_[r], np.einsum("ij,ij->i", d, d), b.places[c])], k)
        count = np.bincount(found[0], minlength=len(x))
        last = np.searchsorted(found[0], np.arange(len(x)), "right") - 1
        worst = np.where(count >= k, found[1][np.maximum(last, 0)], np.inf)
    return found


def likeliest_in(x: np.ndarray, blocks: list[Block], k: int, scale: float) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """Row, negative scaled cosine and place of the k likeliest of each row, and the maximum and sum of exponentials of all."""
    norms = np.sqrt(np.einsum("ij,ij->i", x, x))
    unit = x / np.where(norms > 0, norms, 1)[:, None]
    found, top, total = [], np.full(len(x), -np.inf), np.zeros(len(x))
    for b in blocks:
        own = np.sqrt(np.einsum("ij,ij->i", b.vectors, b.vectors))
        z = scale * (unit @ (b.vectors / np.where(own > 0, own, 1)[:, None]).T)
        high = np.maximum(top, z.max(1))
        total = total * np.exp(top - high) + np.exp(z - high[:, None]).sum(1)
        top = high
        least = np.partition(z, max(0, z.shape[1] - k), 1)[:, max(0, z.shape[1] - k)]
        r, c = np.nonzero(z >= least[:, None])
        found.append((r, -z[r, c], b.places[c]))
        if len(found) > 1:
            found = [_best(found, k)]
    return _best(found, k), top, total


def matches(items: DataFrame, labels: DataFrame, k: int, key: str = "idx", vector: str = "vector", label: str = "label", scale: float | None = None) -> DataFrame:
    """key, place, label and distance of the k nearest labels of each item; with a scale: and probability, the softmax of scaled cosines, of the k likeliest, instead of distance."""
    first = labels.where(F.size(vector) > 0).select(F.size(vector).alias("n")).first()
    size = first["n"] if first else 0
    x = F.col(vector).cast("array<double>")
    known = labels.where(_usable(F.col(vector), size)).select(F.col(label).alias("label"), x.alias("v"), F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, c: s + c * c)).alias("norm"))
    named = written(placed(known.withColumn("row", F.monotonically_increasing_id()), [F.col("label"), F.col("row")], "place"))
    a_pass = max(1, PASS_BYTES // (8 * max(1, size)) // BLOCK) * BLOCK
    dealt = written(placed(named, [F.col("norm"), F.col("place")], "nth").withColumn("pass", F.floor((F.col("nth") - 1) / a_pass)))
    passes = dealt.agg(F.coalesce(F.max("pass") + 1, F.lit(0))).first()[0]
    own = items.where(_usable(F.col(vector), size)).select(F.col(key).alias("key"), x.alias("v"))
    kind = own.schema["key"].dataType.simpleString()
    schema = f"key {kind}, at array<struct<value:double,place:long>>, top double, total double"
    parts = None
    for n in range(passes):
        found = _pass(own, dealt.where(F.col("pass") == n), k, scale, schema)
        found = written(found) if passes > 1 else found
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        return items.sparkSession.createDataFrame([], f"key {kind}, place int, label {labels.schema[label].dataType.simpleString()}, {'distance' if scale is None else 'probability'} double").withColumnRenamed("key", key)
    if passes > 1:  # as many rows of an item as there are passes
        listed = parts.groupBy("key").agg(F.flatten(F.collect_list("at")).alias("at"), F.collect_list(F.struct("top", "total")).alias("sums"))
        high = F.array_max(F.transform("sums", lambda s: s["top"]))
        parts = listed.select("key", F.slice(F.array_sort("at"), 1, k).alias("at"), high.alias("top"), F.aggregate("sums", F.lit(0.0), lambda a, s: a + s["total"] * F.exp(s["top"] - high)).alias("total"))
    each = parts.select("key", "top", "total", F.posexplode("at").alias("pos", "m")).select("key", (F.col("pos") + 1).alias("place"), F.col("m.value").alias("value"), F.col("m.place").alias("of"), "top", "total")
    value = F.sqrt("value").alias("distance") if scale is None else (F.exp(-F.col("value") - F.col("top")) / F.col("total")).alias("probability")
    return each.join(named.select(F.col("place").alias("of"), "label"), "of").select(F.col("key").alias(key), "place", F.col("label").alias(label), value)


def _pass(own: DataFrame, chosen: DataFrame, k: int, scale: float | None, schema: str) -> DataFrame:
    rows = chosen.select("nth", "place", "norm", "v").orderBy("nth").toPandas()  # PASS_BYTES of vectors at most
    blocks = []
    for a in range(0, len(rows), BLOCK):
        part = rows.iloc[a : a + BLOCK]
        blocks.append(Block(np.stack(part["v"].to_numpy()).astype(float), part["place"].to_numpy(), float(part["norm"].min()) * (1 - 1e-12), float(part["norm"].max()) * (1 + 1e-12)))
    shared = own.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.iloc[a : a + ROWS]
                x = np.stack(part["v"].to_numpy()).astype(float)
                if scale is None:
                    found, top, total = nearest_in(x, shared.value, k), np.zeros(len(x)), np.zeros(len(x))
                else:
                    found, top, total = likeliest_in(x, shared.value, k, scale)
                cuts = np.searchsorted(found[0], np.arange(len(x) + 1))
                at = [[{"value": v, "place": p} for v, p in zip(found[1][i:j].tolist(), found[2][i:j].tolist())] for i, j in zip(cuts, cuts[1:])]
                yield pd.DataFrame({"key": part["key"].to_numpy(), "at": at, "top": top, "total": total})

    return own.mapInPandas(run, schema)

