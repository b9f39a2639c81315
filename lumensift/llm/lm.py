"""Language-model scoring: prediction by partial matching over bytes, and a word unigram.

The model is a context trie of order 3 over 257 symbols: the end mark and all
256 bytes, each by itself. In a context, a symbol seen there has its count over
(total + distinct); the escape has distinct over (total + distinct), or nothing where
no symbol is left to escape to, and leads to the next shorter context, where the symbols of the longer one are excluded
from all counts; below order 0, what remains is equally likely. The trie is
trained on every training text, and is as large as what these hold: a gram is a
context of 3 symbols with the symbol after it, and grams are counted, kept and
resolved by Spark. A gram's log-probability depends on the grams that share the
last two symbols of its context (at most 257**2, dealt out by these) and on the
counts of pairs of symbols (at most 257**2, broadcast). All grams of all
texts, held out or not, are resolved. The most frequent (at most CACHE) are looked
up in the scan; those beyond meet their log-probabilities in a join, as rare
tokens do. ``adaptive_code_length`` is the adaptive form, which learns from the
text as it goes.

The unigram lower-cases A-Z and counts tokens exactly by 64-bit hash over all
training texts. The
most frequent tokens (at most HEAD, by counts of counts, without a sort) are looked up in the scan; all other
tokens of a document meet their counts in a join by token, where none is hot,
since a hot token would be among the first.

Defined results: a null or empty text is its end alone; repeated rows are scored
alike; null ids have a null held_out key, are treated as not held out and learn
along; without training texts every count is 0 and the model is the uniform one;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durable import written
from .vector import LOWER, chunks, small_batches, word_hashes, words_of

ORDER = 3
END = 0

#: Symbols of the whole alphabet: END, and each byte + 1.
WHOLE = 257

#: Grams whose log-probabilities are looked up in the scan (16 bytes each).
CACHE = 1 << 20

#: Contexts resolved at once (WHOLE numbers each, in a few arrays).
CONTEXTS = 2048

#: Tokens whose counts are looked up in the scan (16 bytes each).
HEAD = 1 << 17

#: The end token's key among the hashes.
END_TOKEN = 0


def held_out(key: Column, of: int = 10, is_: int = 0) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % of == is_, F.lit(False))


def _token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word, A-Z lower-cased; no word hashes to END_TOKEN."""
    w = words_of([t.translate(LOWER) for t in texts])
    h = word_hashes(w)
    h[h == END_TOKEN] = 1
    return h, w.text_of_word()


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(inverse, np.concatenate(counts), len(k)).astype(np.int64)


def token_counts(train: DataFrame) -> DataFrame:
    """k and n: counts of tokens (by hash) over all texts of train (column text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, ends = [], [], 0, 0

        def sent(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["k", "n"])

        for _, texts in chunks(batches):
            texts = [t or b"" for t in texts]
            ends += len(texts)
            k, n = np.unique(_token_hashes(texts)[0], return_counts=True)
            keys.append(k), counts.append(n)
            held += len(k)
            if held > 2_000_000:
                merged = _merge(keys, counts)
                keys, counts, held = [merged[0]], [merged[1]], len(merged[0])
                if held > 1_500_000:
                    yield sent(*merged)
                    keys, counts, held = [], [], 0
        if keys:
            yield sent(*_merge(keys, counts))
        if ends:
            yield sent(np.array([END_TOKEN], np.uint64), np.array([ends], np.int64))

    return train.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram at every place of every text, its end included, and the text of each."""
    gap = b"\0" * ORDER
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = ORDER + np.cumsum(lens + ORDER) - (lens + ORDER)
    s = data.astype(np.int64) + 1
    s[:ORDER] = END
    for j in range(ORDER):
        s[begin + lens + j] = END
    gram = s.copy()
    for j in range(1, ORDER + 1):
        gram[ORDER:] += s[ORDER - j : len(s) - j] * WHOLE**j
    of = np.repeat(np.arange(len(texts)), lens + 1)
    return gram[np.arange(len(of)) + ORDER + of * (ORDER - 1)], of


def gram_counts(plain: DataFrame) -> DataFrame:
    """k and n: all grams of plain (held_out, text), and how often they stand in texts that aren't held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch, texts in chunks(batches):
            gram, of = _grams([t or b"" for t in texts])
            out = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)[of]
            for g, times in ((gram[~out], 1), (gram[out], 0)):
                k, n = np.unique(g, return_counts=True)
                keys.append(k), counts.append(n * times)
                held += len(k)
            if held > 2_000_000:
                merged = _merge(keys, counts)
                keys, counts, held = [merged[0]], [merged[1]], len(merged[0])
                if held > 1_500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(merged[0]), pa.array(merged[1])], ["k", "n"])
                    keys, counts, held = [], [], 0
        if keys:
            k, n = _merge(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["k", "n"])

    return plain.select("held_out", "text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


def resolve(k: np.ndarray, n: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 of the probability of each gram; k and n are all grams of some middles (the last two symbols of a context), pairs the counts of two symbols."""
    middle = k // WHOLE % WHOLE**2
    own, at = np.unique(middle, return_inverse=True)
    two = np.zeros((len(own), WHOLE), np.int64)
    np.add.at(two, (at, k % WHOLE), n)
    context, first, row = np.unique(k // WHOLE, return_index=True, return_inverse=True)
    out = np.empty(len(k))
    by = np.argsort(row, kind="stable")
    starts = np.searchsorted(row[by], np.arange(0, len(context) + CONTEXTS, CONTEXTS))
    for c, a, b in zip(range(0, len(context), CONTEXTS), starts.tolist(), starts[1:].tolist()):
        mine = by[a:b]
        r, x = row[mine] - c, k[mine] % WHOLE
        size = min(CONTEXTS, len(context) - c)
        three = np.zeros((size, WHOLE), np.int64)
        three[r, x] = n[mine]
        levels = (three, two[at[first[c : c + size]]], pairs[context[c : c + size] % WHOLE], np.broadcast_to(pairs.sum(0), (size, WHOLE)))
        log, done, reach = np.zeros((size, WHOLE)), np.zeros((size, WHOLE), bool), np.zeros((size, 1))
        for level in levels:
            seen = (level > 0) & ~done
            total, distinct = np.where(seen, level, 0).sum(1, keepdims=True), seen.sum(1, keepdims=True)
            done |= seen
            escape = np.where(done.all(1, keepdims=True), 0, distinct)
            below = np.maximum(total + escape, 1)
            log = np.where(seen, reach + np.log10(np.where(seen, level, 1) / below), log)
            reach = reach + np.where(escape > 0, np.log10(np.maximum(escape, 1) / below), 0)
        rest = np.maximum((~done).sum(1, keepdims=True), 1)
        out[mine] = np.where(done, log, reach - np.log10(rest))[r, x]
    return out


def resolved(grams: DataFrame, pairs: np.ndarray) -> DataFrame:
    """k, n and log, the log10 of its probability, of every gram of grams (k, n)."""
    shared = grams.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        def found(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n), pa.array(resolve(k, n, shared.value))], ["k", "n", "log"])

        for batch in batches:
            keys.append(batch.column(0).to_numpy()), counts.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held > 200_000:  # up to the last middle, which may go on
                k, n = np.concatenate(keys), np.concatenate(counts)
                middle = k // WHOLE % WHOLE**2
                cut = int(np.searchsorted(middle, middle[-1]))
                if cut:
                    yield found(k[:cut], n[:cut])
                keys, counts, held = [k[cut:]], [n[cut:]], len(k) - cut
        if held:
            yield found(np.concatenate(keys), np.concatenate(counts))

    middle = F.floor(F.col("k") / WHOLE) % WHOLE**2
    parts = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return grams.withColumn("middle", middle).repartition(parts, "middle").sortWithinPartitions("middle").select("k", "n").mapInArrow(run, "k long, n long, log double")


def most_frequent(grams: DataFrame, limit: int) -> DataFrame:
    """The grams (or tokens) with at least a count that no more than limit have: no sort, only the number of grams for each size of count meets."""
    size = F.when(F.col("n") < 1024, F.col("n")).otherwise(1013 + F.ceil(F.log2(F.col("n") + 1)).cast("long"))
    sizes = grams.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("c")).collect()
    least, total = 1 << 20, 0
    for r in sorted(sizes, key=lambda r: -r["size"]):
        total += r["c"]
        if total > limit:
            break
        least = r["size"]
    return grams.where(size >= least)


def adaptive_code_length(text: bytes, order: int = ORDER) -> float:
    """Bits for a text and its end by the same model, starting empty and learning byte by byte (one text, in memory of its distinct contexts)."""
    trie: dict[tuple, dict[int, int]] = {}
    bits, past = 0.0, ()
    for s in [*text, 256]:
        excluded: set[int] = set()
        for o in range(min(order, len(past)), -1, -1):
            seen = {x: c for x, c in trie.get(past[len(past) - o :], {}).items() if x not in excluded}
            if not seen:
                continue
            total = sum(seen.values()) + (len(seen) if len(seen) + len(excluded) < WHOLE else 0)
            if s in seen:
                bits -= float(np.log2(seen[s] / total))
                break
            bits -= float(np.log2(len(seen) / total))
            excluded |= seen.keys()
        else:
            bits += float(np.log2(WHOLE - len(excluded)))
        for o in range(min(order, len(past)) + 1):
            node = trie.setdefault(past[len(past) - o :], {})
            node[s] = node.get(s, 0) + 1
        past = (past + (s,))[-order:] if order else ()
    return bits


def score(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs; held marks the rows not learnt from."""
    spark = docs.sparkSession
    plain = small_batches(docs.select(F.col(key).alias("key"), held.alias("held_out"), F.col(text).alias("text")))
    train = plain.where(~F.col("held_out")).select("text")
    tokens = written(token_counts(train))
    totals = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    train_tokens, distinct = int(totals["n"]), int(totals["v"])
    counted = written(gram_counts(plain))
    pairs = np.zeros(WHOLE**2, np.int64)
    for r in counted.groupBy((F.col("k") % WHOLE**2).alias("pair")).agg(F.sum("n").alias("n")).collect():
        pairs[r["pair"]] = r["n"]
    grams = written(resolved(counted, pairs.reshape(WHOLE, WHOLE)))
    cached = most_frequent(grams, CACHE).select("k", "log").toArrow()
    gk = cached.column("k").to_numpy()
    g_order = np.argsort(gk)
    head = most_frequent(tokens, HEAD).toArrow()
    end = tokens.where(F.col("k") == END_TOKEN).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hk = head.column("k").to_numpy().view(np.uint64)
    order = np.argsort(hk)
    model = spark.sparkContext.broadcast((gk[g_order], cached.column("log").to_numpy()[g_order], hk[order], head.column("n").to_numpy()[order], int(end)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, logs, keys, ns, ends = model.value
        for batch, texts in chunks(batches):
            texts = [t or b"" for t in texts]
            n = len(texts)
            h, of = _token_hashes(texts)
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            found = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            total = np.bincount(of, minlength=n) + 1
            known = np.bincount(of[found], minlength=n) + (ends > 0)
            base = np.bincount(of[found], np.log10(ns[at[found]] + 0.1), n) + np.log10(ends + 0.1)
            tail, tail_of = h[~found], of[~found]
            cuts = np.concatenate([[0], np.cumsum(np.bincount(tail_of, minlength=n))]).astype(np.int32)
            gram, gram_of = _grams(texts)
            own, inverse = np.unique(gram, return_inverse=True)
            at = np.minimum(np.searchsorted(grams, own), max(len(grams) - 1, 0))
            found = grams[at] == own if len(grams) else np.zeros(len(own), bool)
            log = np.where(found, logs[at], 0.0) if len(grams) else np.zeros(len(own))
            trie = np.bincount(gram_of, log[inverse], n)
            missed = ~found[inverse]
            gram_cuts = np.concatenate([[0], np.cumsum(np.bincount(gram_of[missed], minlength=n))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(3), pa.array(total.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(trie),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(tail.view(np.int64))), pa.ListArray.from_arrays(pa.array(gram_cuts), pa.array(gram[missed])),
                ],
                ["key", "held_out", "row", "n_tokens", "n_known", "base", "score", "tail", "rare_grams"],
            )

    kind = plain.schema["key"].dataType.simpleString()
    scored = written(plain.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, f"key {kind}, held_out boolean, row long, n_tokens long, n_known long, base double, score double, tail array<long>, rare_grams array<long>"))
    tail = scored.select("row", F.explode("tail").alias("k")).join(tokens, "k", "left")
    rare = tail.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("more"), F.count("n").alias("more_known"))
    far = scored.select("row", F.explode("rare_grams").alias("k")).join(grams.select("k", "log"), "k").groupBy("row").agg(F.sum("log").alias("more_score"))
    below = float(np.log10(train_tokens + 0.1 * (distinct + 1)))
    return scored.drop("tail", "rare_grams").join(rare, "row", "left").join(far, "row", "left").select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * below).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, held_out(F.col("doc_id")))
