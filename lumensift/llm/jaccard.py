"""Exact n-gram Jaccard join in a metric space.

The Jaccard distance d = 1 - J of shingle sets is a metric; documents link when
d <= 1 - threshold. Distances between unrelated texts are all close to 1, so
Voronoi cells around pivots drawn from all documents would put nearly every
document at every border. The join therefore finds the documents around a pivot
first, and draws the cells of all further levels by distance:

1. Shingles are dealt into r classes by hash, and documents with the same content
   of a class share a region. A linked pair with at most D shingles of difference
   agrees in at least r - D classes, so it shares a region; r follows D, which follows from
   the size, and documents close to the border of a size band are replicated to
   the next lower band. The pivot of a region is the document with the least hash,
   a random one; the cell of a pivot holds the members of all its regions.
2. A cell above ``LIMIT`` is split as a metric space. With w the largest possible
   distance of a link, members go to the nearest of about ``PIVOTS`` random members, and
   to every other one that is no more than 2 w farther away: by the triangle
   inequality, a linked pair meets in the cell that is nearest to one of the two.
   Members farther than a radius from all pivots would be at every border; they form
   an outer cell of their own, to which those up to w below that radius are replicated.
   Cells that are still too large are split again. Where distances don't separate
   (the largest cell keeps over ``SHRINK`` of its parent, or all cells hold over
   ``GROWTH`` of it, as among near copies of one text that all lie within a window), the parent is
   cut into blocks by hash, and each two blocks meet in a cell, so nothing is left out
   and no cell is larger than the limit.
3. A cell is joined in one task, without listing its pairs: size and a lower bound of the
   symmetric difference rule out pairs, members without a candidate leave, and only for
   those that stay are sets made from the texts. A pair is compared when its members aren't
   connected in the cell yet, so a cell returns fewer links than it has members.

The bound, and the distance of step 2, is the Hamming distance of sketches: bit strings in
which each shingle flips the bit of its hash. It is a metric too and never more than
the symmetric difference, whatever the length they are folded to.

Classes with too few shingles (none, or one where the threshold is high) would be
met by chance; they are no regions. r has room for ``s`` of them. A document with
more also uses a next family of classes, up to the last one, of which all classes
count. Two documents that both have more than s share the next family, and
otherwise agree in a class that counts, so exactness stays.

A vertex is a set, named by a 64-bit hash of it, so copies are one vertex from the
first shuffle on; shingles are 64-bit hashes too.

Ids are whole numbers, or text that reads as one.

Defined results: texts without words have an empty set, which links with nothing;
texts with fewer words than a shingle have one, the whole sequence; a null id comes
after all others, so only a component of null ids alone has a null id; rows with
equal ids are linked by their own texts; an empty table gives no rows; other
columns are not read, and ``distinct_documents`` keeps them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durable import temporary, written
from ..functions.membership import may_hold
from ..operators.graph import components
from .vector import LOWER, NO_ID, chunks, gram_hashes, mix, small_batches, whole_grams, word_hashes, words_of

WORDS = 3
THRESHOLD = Fraction(90, 100)

#: Sizes in one band: up to this times the smallest.
BAND = 1.5

#: Ways of dealing shingles into classes; in the last, weak classes count too.
FAMILIES = 4

#: Bits of the filter that keeps most documents without a partner out of the second scan (at most 32 MB).
FILTER_BITS = 1 << 28

#: Shingles in a cell that is joined in one task; a set counts as FLOOR at least.
LIMIT = 1 << 19
FLOOR = 256

#: Pivots of a cell that is split, how far a pivot reaches as a share of the largest set, and the shares of the cell that its largest part and all parts may have.
PIVOTS = 16
RADIUS = 0.6
SHRINK = 0.7
GROWTH = 2

#: Rows of a side that is broadcast, at most (24 bytes each); beyond, it is joined by shuffle.
BROADCAST_ROWS = 100_000

#: Rows from which a key (copies of one text, or a component) is met by broadcast, if there are few such keys.
LARGE_KEY = 1000

#: Stands for the outer cell among the pivots' keys.
OUTER = -1

#: Bits of a sketch, at most.
SKETCH_BITS = 1 << 20


class Bands:
    """Size bands, and for each the number of classes and of weak classes that it has room for."""

    def __init__(self, threshold: Fraction):
        self.t = threshold
        #: Classes with fewer shingles are weak. Lower thresholds have smaller classes, of which only empty ones are.
        self.least = 2 if threshold >= Fraction(88, 100) else 1
        self.high: list[int] = []  # the largest size of each band
        self.r: list[int] = []
        self.s: list[int] = []

    def difference(self, size: int) -> int:
        """The largest symmetric difference of a linked pair whose smaller set has this size."""
        return int(size * (1 - self.t) / self.t)

    def cover(self, size: int) -> None:
        while not self.high or self.high[-1] < size:
            low = self.high[-1] + 1 if self.high else 1
            top = low
            if self.difference(low):
                top = max(low, int(low * max(BAND, float(1 / self.t) + 0.01)))
            else:
                while not self.difference(top + 1):
                    top += 1
            d = self.difference(top)
            room = 1 + int((d + 1) * (0.05 if self.least > 1 else 0.2)) if d else 0
            self.high.append(top), self.r.append(d + 1 + room), self.s.append(room)


def _distinct(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, sorted in each text, the text of each, and where each text's begin."""
    w = words_of([t.translate(LOWER) for t in texts])
    h = word_hashes(w)
    at = whole_grams(w, n)
    text = w.text_of_word()[at]
    g = gram_hashes(h, n)[at] if len(at) else np.zeros(0, np.uint64)
    counts = w.counts()
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = [int(gram_hashes(h[w.offsets[i] : w.offsets[i + 1]], int(counts[i]), 1000 + int(counts[i]))[0]) for i in short.tolist()]
        g, text = np.concatenate([g, np.array(whole, np.uint64)]), np.concatenate([text, short])
    order = np.argsort(g)
    order = order[np.argsort(text[order].astype(np.uint16 if len(texts) < 65536 else np.int64), kind="stable")]
    g, text = g[order], text[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
    g, text = g[new], text[new]
    return g, text, np.searchsorted(text, np.arange(len(texts) + 1))


def _signatures(g: np.ndarray, text: np.ndarray, begin: np.ndarray, docs: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Region keys of the documents in docs, and the document of each."""
    sizes = np.diff(begin)
    high = np.array(bands.high)
    own = np.searchsorted(high, sizes[docs])
    t = float(bands.t)
    lower = docs[(own > 0) & (sizes[docs] * t <= high[np.maximum(own - 1, 0)] + 1e-6)]
    todo = np.concatenate([docs, lower])
    band = np.concatenate([own, np.searchsorted(high, sizes[lower]) - 1])
    out_key, out_doc = [], []
    for family in range(FAMILIES):
        if not len(todo):
            break
        r, s = np.array(bands.r)[band], np.array(bands.s)[band]
        n = sizes[todo]
        total = int(n.sum())
        item = np.repeat(np.arange(len(todo)), n)
        shingle = g[np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[todo], n)]
        spread = mix(shingle ^ np.uint64(0xABCD0000 + family)) >> np.uint64(32)
        kind = ((spread * r[item].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        base = np.cumsum(r) - r
        slot = base[item] + kind
        content = np.zeros(int(r.sum()), np.uint64)
        np.add.at(content, slot, mix(shingle + np.uint64(0x1234567)))
        held = np.bincount(slot, minlength=len(content))
        of = np.repeat(np.arange(len(todo)), r)
        within = np.arange(len(of)) - base[of]
        weak = (held < bands.least) & (r[of] > 1)
        n_weak = np.bincount(of[weak], minlength=len(todo))
        use = ~weak if family < FAMILIES - 1 else np.ones(len(of), bool)
        label = (band[of].astype(np.uint64) << np.uint64(40)) + (within.astype(np.uint64) << np.uint64(2)) + np.uint64(family)
        out_key.append(mix(content + mix(label))[use])
        out_doc.append(todo[of[use]])
        again = n_weak > s
        todo, band = todo[again], band[again]
    return (np.concatenate(out_key), np.concatenate(out_doc)) if out_key else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _marks(g: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A hash of each set, which is its vertex."""
    sizes = np.diff(begin)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(g ^ np.uint64(0x51)), dtype=np.uint64)])
    return mix(sums[begin[1:]] - sums[begin[:-1]] + sizes.astype(np.uint64)).view(np.int64)


def _sketches(g: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """A bit string for each set, 4 to 8 bits a shingle: a bit is odd where an odd number of shingles fall. Folding halves by XOR gives the shorter sketch."""
    n = np.diff(begin)
    bits = np.minimum(SKETCH_BITS, np.int64(1) << np.ceil(np.log2(np.maximum(4 * n, 256))).astype(np.int64))
    at = np.cumsum(bits) - bits
    place = np.repeat(at, n) + (mix(g ^ np.uint64(0xF01D)) & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(place, minlength=int(bits.sum())) & 1
    packed = np.packbits(odd.astype(bool), bitorder="little").tobytes()
    return [packed[a : a + b] for a, b in zip((at // 8).tolist(), (bits // 8).tolist())]


def _folded(sketches: list[bytes], size: int) -> np.ndarray:
    """The sketches, folded to size bytes, as rows of uint64."""
    return np.array([np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, size // 8), axis=0) for b in sketches]).reshape(len(sketches), size // 8)


def _profiles(docs: DataFrame, n: int) -> DataFrame:
    """id, tag (if docs have it), n_shingles, key (the set's vertex) and sketch."""
    tags = [c for c in docs.columns if c == "tag"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            g, _, begin = _distinct([t or b"" for t in texts], n)
            made = [pa.array(np.diff(begin).astype(np.int64)), pa.array(_marks(g, begin)), pa.array(_sketches(g, begin), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(1) for _ in tags), *made], ["id", *tags, "n_shingles", "key", "sketch"])

    return docs.mapInArrow(run, "id long, " + "tag long, " * len(tags) + "n_shingles long, key long, sketch binary")


def _regions(docs: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """region and key; a set that a slice of texts has twice is dealt once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(threshold)
        for _, texts in chunks(batches):
            g, text, begin = _distinct([t or b"" for t in texts], n)
            sizes, marks = np.diff(begin), _marks(g, begin)
            bands.cover(int(sizes.max(initial=1)))
            first = np.unique(marks, return_index=True)[1]
            key, doc = _signatures(g, text, begin, np.sort(first[sizes[first] > 0]), bands)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(marks[doc])], ["region", "key"])

    return docs.mapInArrow(run, "region long, key long")


def _members(regions: DataFrame) -> DataFrame:
    """region, key and pivot (the least key) of the regions with two different members or more.

    Rows arrive sorted, so a region of any size passes through without being held, and equal rows are neighbours.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region = last = pivot = None  # of the last row so far
        told = False  # whether the pivot itself has been returned
        for batch in batches:
            r, k = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fresh = np.ones(len(r), bool)
            fresh[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
            if len(r):
                fresh[0] = region is None or r[0] != region or k[0] != last
            r, k = r[fresh], k[fresh]
            if not len(r):
                continue
            new = np.ones(len(r), bool)
            new[1:] = r[1:] != r[:-1]
            new[0] = region is None or r[0] != region
            start = np.flatnonzero(new)
            group = np.cumsum(new) - 1  # -1: goes on from the last batch
            pivots = k[start][group] if len(start) else np.zeros(len(r), np.int64)
            if not new[0]:
                pivots[group < 0] = pivot
            size = np.bincount(group + 1, minlength=len(start) + 1)
            take = np.where(group < 0, True, size[group + 1] > 1)
            out_r, out_k, out_p = r[take], k[take], pivots[take]
            if not new[0] and not told:
                out_r, out_k, out_p = np.append(out_r, region), np.append(out_k, pivot), np.append(out_p, pivot)
                told = True
            if len(start):
                told = size[-1] > 1
            region, last, pivot = r[-1], k[-1], pivots[-1]
            yield pa.RecordBatch.from_arrays([pa.array(out_r), pa.array(out_k), pa.array(out_p)], ["region", "key", "pivot"])

    parts = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return regions.repartition(parts, "region").sortWithinPartitions("region", "key").mapInArrow(run, "region long, key long, pivot long")


def _bitmap(keys: DataFrame) -> tuple[int, np.ndarray]:
    """A filter of the keys with about 16 bits a key, FILTER_BITS at most; made on the executors, bit by bit."""
    bits = 1 << 16
    while bits < min(FILTER_BITS, 16 * keys.count()):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array((mix(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64) + 1)], ["p"])  # buckets count from 1

    places = keys.mapInArrow(run, "p long")
    rows = places.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        at = (r["b"] - 1) * 4096
        m = np.frombuffer(bytes(r["m"]), np.uint8)[: len(out) - at]
        out[at : at + len(m)] = m
    return bits, out


def _sets(docs: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """key and shingles (sorted) of the sets named by keys, and a few others, as the filter is no exact one."""
    bits, bitmap = _bitmap(keys)
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches):
            g, _, begin = _distinct([t or b"" for t in texts], n)
            marks, sizes = _marks(g, begin), np.diff(begin)
            p = mix(marks.view(np.uint64)) & np.uint64(bits - 1)
            first = np.sort(np.unique(marks, return_index=True)[1])
            on = first[((held.value[(p[first] >> np.uint64(3)).astype(np.int64)] >> (p[first] & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]
            if not len(on):
                continue
            counts = sizes[on]
            own = np.repeat(np.arange(len(on)), counts)
            values = g[np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin[on], counts)]
            cuts = np.searchsorted(own, np.arange(len(on) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(marks[on]), pa.ListArray.from_arrays(pa.array(cuts), pa.array(values.view(np.int64)))], ["key", "shingles"])

    return docs.mapInArrow(run, "key long, shingles array<long>").dropDuplicates(["key"])


def _near(n: np.ndarray, sketches: list[bytes], threshold: Fraction) -> Iterator[tuple[int, np.ndarray]]:
    """Each member (sizes n, ascending) with the later ones that size and sketch don't rule out."""
    num, den = threshold.numerator, threshold.denominator
    lengths = np.fromiter(map(len, sketches), np.int64, len(sketches))
    last = np.searchsorted(n * num, n * den, "right")  # members up to 1 / threshold times the size
    for length in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == length)
        lo, hi = int(own[0]), int(last[own[-1]])
        bits = _folded(sketches[lo:hi], length)
        rows = max(1, (1 << 20) // max(1, (hi - lo) * length // 8))
        for begin in range(lo, int(own[-1]) + 1, rows):
            block = np.arange(begin, min(begin + rows, int(own[-1]) + 1))
            to = int(last[block[-1]])
            apart = np.bitwise_count(bits[block - lo, None] ^ bits[None, begin - lo : to - lo]).sum(2, dtype=np.int64)
            j = np.arange(begin, to)
            near = (apart * (den + num) <= (den - num) * (n[block, None] + n[None, j])) & (j[None] > block[:, None]) & (j[None] < last[block, None])
            for i, row in zip(block.tolist(), near):
                yield i, j[row]


def _forest(keys: np.ndarray, sets: list[np.ndarray], threshold: Fraction) -> list[tuple[int, int]]:
    """Links that connect all members of a cell that links connect; fewer than it has members."""
    num, den = threshold.numerator, threshold.denominator
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(n, kind="stable")
    sets, n = [sets[i] for i in order.tolist()], n[order]
    root, out = np.arange(len(n)), []
    sketches = _sketches(np.concatenate(sets).view(np.uint64), np.concatenate([[0], np.cumsum(n)]))
    for i, js in _near(n, sketches, threshold):
        js = js[root[js] != root[i]]
        while len(js):
            j = int(js[0])
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if den * common >= num * (n[i] + n[j] - common):
                out.append((int(keys[order[i]]), int(keys[order[j]])))
                root[root == root[j]] = root[i]
                js = js[root[js] != root[i]]
            else:
                js = js[1:]
    return out


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell (column 0, sorted)."""
    now, held = None, []
    for batch in batches:
        cell = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                if held and cell[a] != now:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
                now = cell[a]
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _in_cells(rows: DataFrame) -> DataFrame:
    return rows.repartition("cell").sortWithinPartitions("cell")  # no number, so that small partitions are put together at run time


def _alive(cells: DataFrame, sketches: DataFrame, threshold: Fraction) -> DataFrame:
    """cell and key of the members (cell, key) that have a candidate in their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_cell(batches):
            n, sketch = t["n"].to_numpy(), t["sketch"].to_pylist()
            order = np.argsort(n, kind="stable")
            some = np.zeros(len(n), bool)
            for i, js in _near(n[order], [sketch[i] for i in order.tolist()], threshold):
                if len(js):
                    some[i] = some[js] = True
            if some.any():
                yield t.select(["cell", "key"]).take(pa.array(np.sort(order[some]))).combine_chunks().to_batches()[0]

    return _in_cells(cells.select("cell", "key").join(sketches, "key").select("cell", "key", "n", "sketch")).mapInArrow(run, "cell long, key long")


def _links(alive: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """u and v: links that connect what links connect in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_cell(batches):
            values = t["shingles"].combine_chunks()
            cuts, flat = values.offsets.to_numpy(), values.values.to_numpy()
            found = _forest(t["key"].to_numpy(), [flat[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())], threshold)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    return _in_cells(alive.join(sets, "key").select("cell", "key", "shingles")).mapInArrow(run, "u long, v long")


def _few(rows: DataFrame) -> DataFrame:
    """A table, marked for broadcast if it is counted as small enough, so that a hot key of the other side meets it without a shuffle."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _named(rows: DataFrame, names: DataFrame, on: str) -> DataFrame:
    """rows with what names (one row a key) says of their key, or nulls; keys that many rows share don't meet in one task."""
    large = rows.groupBy(on).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= LARGE_KEY).select(on)
    known = _few(large.join(names, on, "left"))
    return rows.join(known, on).unionByName(rows.join(known.select(on), on, "left_anti").join(names, on, "left"))


def _nearest(large: DataFrame, sketches: DataFrame, threshold: Fraction, level: int) -> DataFrame:
    """cell, child, key and n of the members of large cells (cell, key, n, weight): a member is in the cell of its nearest pivot and of those within the window."""
    share = F.xxhash64("key", F.lit(level)) / F.lit(2.0**64) + 0.5
    one = F.struct("key", "sketch")
    met = written(large.join(sketches.select("key", "sketch"), "key"))
    drawn = met.withColumn("drawn", share < F.lit(PIVOTS) / F.col("members"))
    pivots = drawn.groupBy("cell").agg(F.collect_list(F.when(F.col("drawn"), one)).alias("some"), F.min_by(one, share).alias("least"), F.min(F.octet_length("sketch")).alias("size"), F.max("n").alias("largest"))
    pivots = pivots.select("cell", F.array_distinct(F.array_append("some", F.col("least"))).alias("pivots"), "size", "largest")
    reach = float((1 - threshold) / threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            cell, key, n = (t[c].to_numpy() for c in ("cell", "key", "n"))
            sketch, pivot, size, largest = (t[c].to_pylist() for c in ("sketch", "pivots", "size", "largest"))
            out, child = [], []
            held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for i, c in enumerate(cell.tolist()):
                if c not in held:
                    held[c] = np.array([p["key"] for p in pivot[i]], np.int64), _folded([p["sketch"] for p in pivot[i]], size[i])
                names, bits = held[c]
                far = np.bitwise_count(bits ^ _folded([sketch[i]], size[i])).sum(1, dtype=np.int64)
                link, radius = n[i] * reach + 1e-6, RADIUS * largest[i]
                own = names[far <= far.min() + 2 * link] if far.min() < radius else names[:0]
                if far.min() >= radius - link:
                    own = np.append(own, np.int64(OUTER))
                out += [i] * len(own)
                child.append(mix(own.view(np.uint64) ^ mix(np.array([c], np.int64).view(np.uint64))).view(np.int64))
            at = pa.array(out, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.concatenate(child) if child else np.zeros(0, np.int64)), pa.array(key).take(at), pa.array(n).take(at)], ["cell", "child", "key", "n"])

    # skewed cells are split by the join, as nothing after it needs their rows together
    dealt = met.join(pivots, "cell").select("cell", "key", "n", "sketch", "pivots", "size", "largest")
    return written(dealt.mapInArrow(run, "cell long, child long, key long, n long"))


def _bounded(cells: DataFrame, sketches: DataFrame, threshold: Fraction) -> DataFrame:
    """cell and key: the cells (cell, key, n), with those above LIMIT split until none is."""
    weight = F.sum(F.greatest("n", F.lit(FLOOR))).alias("weight")
    sized = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("members"), weight).where(F.col("weight") > LIMIT)
    if not sized.limit(1).count():
        return cells.select("cell", "key")
    sized = _few(sized)
    large = written(cells.join(sized, "cell"))
    done = [cells.join(sized, "cell", "left_anti").select("cell", "key")]
    level = 0
    while large.limit(1).count():
        level += 1
        parts = _nearest(large, sketches, threshold, level)
        sizes = written(parts.groupBy("cell", "child").agg(F.count(F.lit(1)).alias("members"), weight))
        whole = large.select("cell", F.col("weight").alias("all")).distinct()
        fate = written(sizes.groupBy("cell").agg(F.max("weight").alias("most"), F.sum("weight").alias("sum")).join(whole, "cell").select("cell", ((F.col("most") <= SHRINK * F.col("all")) & (F.col("sum") <= GROWTH * F.col("all"))).alias("shrinks")))
        # blocks of less than half the limit; each two of them are a cell
        stuck = large.join(fate.where("NOT shrinks").select("cell"), "cell", "left_semi")
        blocks = F.ceil(2.5 * F.col("weight") / F.lit(LIMIT)).cast("long")
        mine = F.pmod(F.xxhash64("key", F.lit(-1)), F.col("blocks"))
        pairs = stuck.withColumn("blocks", F.greatest(blocks, F.lit(2))).withColumn("mine", mine).select("cell", "key", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")).where("mine <> other")
        done.append(pairs.select(F.xxhash64("cell", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "key"))
        next_ = parts.join(fate.where("shrinks").select("cell"), "cell", "left_semi").select(F.col("child").alias("cell"), "key", "n")
        sized = sizes.join(fate.where("shrinks").select("cell"), "cell", "left_semi").select(F.col("child").alias("cell"), "members", "weight")
        kept = next_.join(sized, "cell")
        done.append(kept.where(F.col("weight") <= LIMIT).select("cell", "key"))
        large = written(kept.where(F.col("weight") > LIMIT))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _plain(docs: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    return small_batches(docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("key"), *more, F.col(text).alias("text")))


def vertices(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, threshold: Fraction = THRESHOLD) -> DataFrame:
    """id (NO_ID for null), n_shingles and root, the least id of the component, of every row of docs."""
    plain = _plain(docs, key, text)
    with temporary(docs.sparkSession):
        placed = written(_placed(plain, plain, n, threshold), keep=True)
    worded = placed.where("n_shingles > 0")
    least = worded.groupBy("root").agg(F.min("id").alias("least"))
    return _named(worded, least, "root").select("id", "n_shingles", F.col("least").alias("root")).unionByName(placed.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("root")))


def _placed(plain: DataFrame, rows: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """id, tag (if rows have it), n_shingles and root (the component's name) of every row of plain (key, text); rows are the same with their tags."""
    profiles = written(_profiles(rows, n))
    # the cell of a pivot: the members of all its regions
    around = written(_members(_regions(plain, n, threshold)).select(F.col("pivot").alias("cell"), "key").distinct())
    # copies are put together before they meet
    named = profiles.groupBy("key").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    sketches = written(named.join(around.select("key").distinct(), "key", "left_semi"))
    cells = _bounded(written(around.join(sketches.select("key", "n"), "key")), sketches, threshold)
    alive = written(_alive(cells, sketches, threshold))
    sets = _sets(plain, alive.select("key").distinct(), n)
    roots = components(_links(alive, sets, threshold)).withColumnRenamed("v", "key")
    return _named(profiles.drop("sketch"), roots, "key").select(*(c for c in profiles.columns if c not in ("key", "sketch")), F.coalesce("root", "key").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, threshold: Fraction = THRESHOLD) -> DataFrame:
    """key, n_shingles and component_id of every row of docs."""
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return vertices(docs, key, text, n, threshold).select(back("id").alias(key), "n_shingles", back("root").alias("component_id"))


def distinct_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: Fraction = Fraction(8, 10)) -> DataFrame:
    """One row of each component with all columns, that with the least id, then text hash, then other columns; rows without words stay."""
    tag = F.xxhash64(F.col(text))
    with temporary(docs.sparkSession):
        placed = written(_placed(_plain(docs, key, text), _plain(docs, key, text, tag.alias("tag")), n, threshold), keep=True)
    worded = placed.where("n_shingles > 0")
    stays = worded.groupBy("root").agg(F.min(F.struct("id", "tag")).alias("least")).select("least.id", "least.tag")
    # rows of equal id and text are in one component, and only of these, one is chosen by its columns
    known = worded.groupBy("id", "tag").agg(F.count(F.lit(1)).alias("rows")).join(stays.withColumn("stays", F.lit(True)), ["id", "tag"], "left")
    marked = written(known.where("stays IS NULL OR rows > 1").select(F.col("id").alias("jaccard:key"), F.col("tag").alias("jaccard:tag"), F.col("stays").isNull().alias("gone")))
    own = lambda d: (F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)) == d["jaccard:key"]) & (tag == d["jaccard:tag"])
    # only rows that may be marked are shuffled to meet their mark
    listed = may_hold(marked.select("`jaccard:key`", "`jaccard:tag`"), [F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)), tag])
    again = marked.where("NOT gone")
    near = docs.where(listed)
    rest = docs.where(~listed).unionByName(near.join(marked, own(marked), "left_anti"))
    if not again.limit(1).count():
        return rest
    copies = near.join(again, own(again), "left_semi")
    one = copies.groupBy(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)), tag).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("jaccard:row"))
    return rest.unionByName(one.select("`jaccard:row`.*"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 90 * (nx.n + ny.n - i)
), both_ AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (SELECT doc_id AS v, doc_id AS r FROM d UNION SELECT reach.v, both_.y FROM reach JOIN both_ ON both_.x = reach.r
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT v AS doc_id, min(r) AS component_id FROM reach GROUP BY v) USING (doc_id)
"""
