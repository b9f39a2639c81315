"""Substring dedup by super-k-mer partitioning.

A window is ``k`` consecutive words of one document. Its minimiser is the
smallest hash of its runs of ``m`` words. Consecutive windows that share a
minimiser (a super-k-mer) travel as one packed string to the minimiser's
bucket, so equal windows always meet; there, sorting finds the first place of
each window, and windows that also start earlier are reported as spans.

Layout. Map tasks pack the super-k-mers of a slice of texts by bucket into
one compressed block a bucket, so a shuffle row is a block. Super-k-mers that
occur twice in a slice are sent once, with their first place; the later places
are all removed and only their spans travel. Copies of a document, however many,
thus weigh on a bucket once a slice. The number of buckets follows the bytes of the
texts, counted over all rows, and no set of keys ever reaches the driver. A
minimiser that many windows share makes its bucket larger: a bucket above
``HOT_BYTES`` isn't sorted but dealt again, block by block, by the next minimiser of its windows
(in another order of the runs of ``m`` words), over ``SPREAD`` buckets of their own, up to ``LEVELS``
times. What is still together then has the same minimiser in every order.

Exactness: windows are compared by 128 bits, 64 over the hashes of their words and
64 over their bytes, which have nothing in common; windows are judged on the input.
No window is dropped or sampled.

Ids are whole numbers, or text that reads as one.

Defined results: null, blank and short texts have no window and lose nothing;
places come in the order of id (null after all others), then of the text's hash,
then of start; a row is known by its id and its text's hash, so rows that share an
id (null too) but not a text lose only what repeats in their own text; rows of
equal id and text (repeated rows) are the same place, so neither is removed
because of the other; an empty table gives an empty result; only the id and the text are read, and
``dedup_documents`` keeps all other columns as they are.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durable import written
from ..functions.membership import may_hold
from .vector import NO_ID, Words, chunks, gram_hashes, mix, small_batches, whole_grams, word_hashes, words_of

K = 20
M = 2

#: Packed bytes after which a map task sends its blocks.
SLICE_BYTES = 32 << 20

#: Bytes of text for each bucket.
BUCKET_BYTES = 16 << 20

#: Packed bytes above which a bucket is dealt again, over how many buckets, and how often.
HOT_BYTES = 8 << 20
SPREAD = 64
LEVELS = 4

_HEAD = struct.Struct("<Bq")  # kind, number of entries
_PACKED, _SPANS = 0, 1


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w neighbours."""
    out, have = a, 1
    while 2 * have <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: len(a) - w + 1], out[w - have : w - have + len(a) - w + 1])
    return out


def _block(kind: int, arrays: list[np.ndarray], packed: bytes = b"") -> bytes:
    """The arrays (ids, tags, starts, numbers of windows, and sizes of what is packed), ids as differences."""
    arrays = [np.diff(arrays[0], prepend=np.int64(0)), *arrays[1:]]
    return zstandard.ZstdCompressor(level=5).compress(_HEAD.pack(kind, len(arrays[0])) + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays) + packed)


def _unblock(blob: bytes) -> tuple[int, list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    kind, n = _HEAD.unpack_from(raw)
    at, arrays = _HEAD.size, []
    for kindof in (np.int64, np.int64, np.int32, np.int32) + ((np.int32,) if kind == _PACKED else ()):
        arrays.append(np.frombuffer(raw, kindof, n, at))
        at += n * np.dtype(kindof).itemsize
    arrays[0] = np.cumsum(arrays[0])
    return kind, arrays, raw[at:]


def super_kmers(w: Words, hashes: np.ndarray, k: int, m: int, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimiser (in the order of a level) of each super-k-mer."""
    at = whole_grams(w, k)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    low = _sliding_min(gram_hashes(hashes, m, 77 + level), k - m + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), low[first]


class _Packer:
    """The super-k-mers of a slice, until they are sent."""

    def __init__(self, k: int, m: int, buckets: int, level: int = 0):
        self.k, self.m, self.buckets, self.level = k, m, buckets, level
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, ids: np.ndarray, tags: np.ndarray, texts: list[bytes], begin: np.ndarray | None = None) -> None:
        """begin: the number of each text's first word, where it is a part of a document."""
        texts = [b" ".join(t.split()) for t in texts]
        w = words_of(texts)
        h = word_hashes(w)
        start, n, low = super_kmers(w, h, self.k, self.m, self.level)
        if not len(start):
            return
        # what a super-k-mer holds, as 128 bits: the sum over its windows, and its ends
        whole = gram_hashes(h, self.k)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(whole), dtype=np.uint64)])
        mark = (sums[start + n] - sums[start]) ^ mix(n.astype(np.uint64))
        ends = mix(whole[start] + np.uint64(1)) + whole[start + n - 1]
        text = np.searchsorted(w.offsets, start, "right") - 1
        lo, hi = w.starts[start], w.ends[start + n + self.k - 2]
        buf = w.data.tobytes()
        place = start - w.offsets[text] + (0 if begin is None else begin[text])
        self.parts.append((ids[text], tags[text], place.astype(np.int32), n.astype(np.int32), low, mark, ends, [buf[a:b] for a, b in zip(lo.tolist(), hi.tolist())]))
        self.size += int((hi - lo).sum())

    def send(self) -> tuple[list[int], list[bytes]]:
        ids, tags, start, n, low, mark, ends = (np.concatenate([p[i] for p in self.parts]) for i in range(7))
        packed = [s for p in self.parts for s in p[7]]
        self.parts, self.size = [], 0
        order = np.lexsort((start, tags, ids, ends, mark))
        new = np.ones(len(order), bool)
        new[1:] = (mark[order][1:] != mark[order][:-1]) | (ends[order][1:] != ends[order][:-1])
        lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        again = order[(ids[order] != ids[lead]) | (tags[order] != tags[lead]) | (start[order] != start[lead])]
        once = order[new]
        keys, blobs = [], []
        bucket = (low % np.uint64(self.buckets)).astype(np.int64)
        once = once[np.lexsort((start[once], tags[once], ids[once], bucket[once]))]
        cuts = np.flatnonzero(np.diff(bucket[once])) + 1
        for part in np.split(once, cuts) if len(once) else []:
            own = [packed[i] for i in part.tolist()]
            size = np.fromiter(map(len, own), np.int32, len(own))
            keys.append(int(bucket[part[0]]))
            blobs.append(_block(_PACKED, [ids[part], tags[part], start[part], n[part], size], b"".join(own)))
        if len(again):
            keys.append(int(bucket[again[0]]))
            blobs.append(_block(_SPANS, [ids[again], tags[again], start[again], n[again]]))
        return keys, blobs


_BYTE = np.random.default_rng(0xB17E5).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def byte_hashes(w: Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes from the first word to the last one of each run of words (first ascending), from sums over all bytes."""
    out = np.empty(len(first), np.uint64)
    for a in range(0, len(first), 1 << 17):
        lo, hi = w.starts[first[a : a + (1 << 17)]], w.ends[last[a : a + (1 << 17)]]
        begin, end = int(lo[0]), int(hi.max())
        power = np.full(end - begin + 1, _STEP)
        back = np.full(end - begin + 1, _BACK)
        power[0] = back[0] = 1
        np.multiply.accumulate(power, out=power), np.multiply.accumulate(back, out=back)
        sums = np.zeros(end - begin + 1, np.uint64)
        np.cumsum(_BYTE[w.data[begin:end]] * power[:-1], out=sums[1:])
        out[a : a + (1 << 17)] = (sums[hi - begin] - sums[lo - begin]) * back[lo - begin]
    return mix(out)


def _bucket_spans(blobs: list[bytes], k: int) -> tuple[np.ndarray, ...]:
    """id, tag, first window and number of windows of the runs of later windows in a bucket."""
    spans: list[tuple] = []
    ids, tags, start, n, texts = [], [], [], [], []
    for blob in blobs:
        kind, arrays, packed = _unblock(blob)
        if kind == _SPANS:
            spans.append(tuple(arrays))
            continue
        ids.append(arrays[0]), tags.append(arrays[1]), start.append(arrays[2]), n.append(arrays[3])
        ends = np.cumsum(arrays[4])
        texts += [packed[b - s : b] for s, b in zip(arrays[4].tolist(), ends.tolist())]
    if texts:
        i, g, s, c = np.concatenate(ids), np.concatenate(tags), np.concatenate(start), np.concatenate(n)
        order = np.lexsort((s, g, i))
        w = words_of([texts[j] for j in order.tolist()])
        del texts
        i, g, s, c = i[order], g[order], s[order].astype(np.int64), c[order].astype(np.int64)
        h = word_hashes(w)
        at = whole_grams(w, k)  # c windows of each super-k-mer, in order
        one, two = gram_hashes(h, k)[at], byte_hashes(w, at, at + k - 1)
        which = np.repeat(np.arange(len(c)), c)
        place = s[which] + np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c)
        by = np.argsort(one, kind="stable")
        if ((one[by][1:] == one[by][:-1]) & (two[by][1:] != two[by][:-1])).any():
            by = np.lexsort((two, one))
        new = np.ones(len(by), bool)
        new[1:] = (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1])
        lead = by[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = np.zeros(len(by), bool)
        later[by] = (i[which[by]] != i[which[lead]]) | (g[which[by]] != g[which[lead]]) | (place[by] != place[lead])
        hit = np.flatnonzero(later)
        if len(hit):
            cut = np.ones(len(hit), bool)
            cut[1:] = (hit[1:] != hit[:-1] + 1) | (which[hit[1:]] != which[hit[:-1]])
            first = np.flatnonzero(cut)
            spans.append((i[which[hit[first]]], g[which[hit[first]]], place[hit[first]], np.diff(np.append(first, len(hit)))))
    if not spans:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate([x[j] for x in spans]).astype(np.int64) for j in range(4))


def bucket_count(texts: DataFrame) -> int:
    """As many buckets as the bytes of all texts (column text) ask for, and eight a shuffle partition at least."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(8 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES + 1)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, m: int = M) -> DataFrame:
    """key (NO_ID for null), tag (the text's hash), first (word) and n (windows) of runs of windows that also start earlier."""
    buckets = bucket_count(docs.select(F.col(text).alias("text")))
    plain = small_batches(docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(F.col(text)).alias("tag"), F.col(text).alias("text")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(k, m, buckets)

        def sent() -> pa.RecordBatch:
            keys, blobs = packer.send()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "block"])

        for batch, texts in chunks(batches):
            packer.add(batch.column(0).to_numpy(), batch.column(1).to_numpy(), [t or b"" for t in texts])
            if packer.size >= SLICE_BYTES:
                yield sent()
        if packer.parts:
            yield sent()

    blocks, level, out = plain.mapInArrow(pack, "bucket long, block binary"), 1, None
    while True:
        found = written(_found(blocks, k, m, level))
        spans = found.where("block IS NULL").select("key", "tag", "first", "n")
        out = spans if out is None else out.unionByName(spans)
        blocks = found.where("block IS NOT NULL").select("bucket", "block")
        if level > LEVELS or not blocks.limit(1).count():
            return out
        level += 1


def _found(blocks: DataFrame, k: int, m: int, level: int) -> DataFrame:
    """key, tag, first and n of the spans in each bucket; for buckets above HOT_BYTES, up to the last level, bucket and block of what is dealt again instead."""
    names = ["key", "tag", "first", "n", "bucket", "block"]
    kinds = [pa.int64()] * 5 + [pa.binary()]

    def spans(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        size = len(columns[0])
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary())], names)

    def dealt(packer: _Packer, bucket: int) -> pa.RecordBatch:
        keys, blobs = packer.send()
        own = (mix(np.array(keys, np.uint64) + mix(np.array([bucket], np.int64).view(np.uint64))) >> np.uint64(1)).astype(np.int64)
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(blobs), t) for t in kinds[:4]), pa.array(own), pa.array(blobs, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, packer = None, [], 0, None

        def end() -> Iterator[pa.RecordBatch]:
            if packer is not None and packer.parts:
                yield dealt(packer, now)
            if held:
                yield spans(_bucket_spans(held, k))

        for batch in batches:
            for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != now:
                    yield from end()
                    now, held, size, packer = bucket, [], 0, None
                held.append(block)
                size += zstandard.frame_content_size(block)
                if size > HOT_BYTES and level <= LEVELS:
                    packer = packer or _Packer(k, m, SPREAD, level)
                    for b in held:
                        kind, arrays, packed = _unblock(b)
                        if kind == _SPANS:
                            yield spans(tuple(a.astype(np.int64) for a in arrays))
                            continue
                        ends = np.cumsum(arrays[4])
                        packer.add(arrays[0], arrays[1], [packed[e - s : e] for s, e in zip(arrays[4].tolist(), ends.tolist())], arrays[2])
                        if packer.size >= SLICE_BYTES:
                            yield dealt(packer, now)
                    held = []
        yield from end()

    shuffle = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(shuffle, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "key long, tag long, first long, n long, bucket long, block binary")


def _with_spans(docs: DataFrame, key: str, text: str, k: int, m: int) -> DataFrame:
    """docs with substring:starts and substring:ends, the word ranges to remove (null: none)."""
    found = repeated_spans(docs, key, text, k, m)
    spans = found.groupBy(F.col("key").alias("substring:key"), F.col("tag").alias("substring:tag")).agg(F.collect_set(F.struct("first", "n")).alias("substring:spans"))  # repeated rows report the same spans
    own, tag = F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)), F.xxhash64(F.col(text))
    # only rows that may have spans are shuffled to meet them
    hit = may_hold(found.select("key", "tag").distinct(), [own, tag])
    met = docs.where(hit).join(spans, (own == spans["substring:key"]) & (tag == spans["substring:tag"]), "left").drop("substring:key", "substring:tag")
    ranges = F.col("`substring:spans`")
    marked = met.withColumn("substring:starts", ranges["first"]).withColumn("substring:ends", F.transform(ranges, lambda s: s["first"] + s["n"] + (k - 1))).drop("substring:spans")
    none = F.lit(None).cast("array<bigint>")
    return marked.unionByName(docs.where(~hit).withColumn("substring:starts", none).withColumn("substring:ends", none))


def _kept_mask(n: int, starts: list[int], ends: list[int]) -> np.ndarray:
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, np.minimum(starts, n), 1)
    np.add.at(d, np.minimum(ends, n), -1)
    return np.cumsum(d[:n]) == 0


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, m: int = M) -> DataFrame:
    """key, n_words, n_removed and the SHA-256 of the kept words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            total, removed, sums = [], [], []
            for t, s, e in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                own = (t or b"").split()
                total.append(len(own))
                if s:
                    own = [own[i] for i in np.flatnonzero(_kept_mask(len(own), s, e)).tolist()]
                removed.append(total[-1] - len(own))
                sums.append(hashlib.sha256(b" ".join(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums)], ["key", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    marked = _with_spans(docs.select(key, text), key, text, k, m).select(F.col(key).alias("key"), F.col(text).alias("text"), "`substring:starts`", "`substring:ends`")
    return marked.mapInArrow(run, f"key {kind}, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("key", key)


def dedup_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, m: int = M, length: str | None = None) -> DataFrame:
    """docs with later repeats cut out of the text; kept words keep the white space after them. Texts that lose nothing stay as they are; length names a column to hold the code points of changed texts."""
    names = [f.name for f in docs.schema.fields]
    where = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, text):
            out: list[bytes | None] = []
            for t, s, e in zip(texts, batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
                if t and s:
                    w = words_of([t])
                    keep = _kept_mask(len(w.starts), s, e)
                    ends = np.append(w.starts[1:], len(t) + 1)
                    t = b"".join(t[a - 1 : b - 1] for a, b in zip(w.starts[keep].tolist(), ends[keep].tolist())).strip()
                out.append(t)
            columns = [batch.column(i) for i in range(len(names))]
            columns[where] = pa.array(out, pa.binary()).cast(pa.string())
            marked = [] if length is None else [batch.column(len(names)).is_valid()]
            yield pa.RecordBatch.from_arrays(columns + marked, names + ["substring:changed"] * len(marked))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = _with_spans(docs, key, text, k, m)
    if length is None:
        return out.mapInArrow(run, fields)
    cut = out.mapInArrow(run, fields + ", `substring:changed` boolean")
    return cut.withColumn(length, F.when(F.col("`substring:changed`"), F.length(text)).otherwise(F.col(length)).cast(docs.schema[length].dataType)).drop("substring:changed")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20
), g AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS nth FROM p
), gone AS (
  SELECT doc_id, list(DISTINCT x) AS xs FROM (SELECT doc_id, unnest(range(i, i + 20)) AS x FROM g WHERE nth > 1) GROUP BY doc_id
), marked AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS x, unnest(w) AS word FROM d
), left_over AS (
  SELECT m.doc_id, string_agg(word, ' ' ORDER BY m.x) AS t, count(*) AS n
  FROM marked m LEFT JOIN (SELECT doc_id, unnest(xs) AS x FROM gone) r ON m.doc_id = r.doc_id AND m.x = r.x WHERE r.x IS NULL GROUP BY m.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""
