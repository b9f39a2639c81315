"""Rule bitmask ledger.

``measure`` reads every whole text once and returns its measurements.
``ledger`` turns them into one failure bit a rule. ``apply_policy`` decides with
a versioned policy, a mask of enforced rules, without looking at the texts
again, and ``ablation`` counts what each rule of a policy decides alone, by
bitwise expressions in one aggregation over the ledger.

Defined results: a null or blank text has no words and fails ``too_short``; a
row is measured by itself, so repeated rows, null ids and ties change nothing;
an empty table gives an empty ledger; columns of the input other than the id
and the text never clash, since none of them is carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .vector import chunks, covered, gram_hashes, mix, small_batches, whole_grams, word_hashes, words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper", "n_bangs")

SYMBOLS = b"#*$%&|<>"

#: Rule n has bit n. New rules go to the end, so stored bits keep their meaning.
RULES: tuple[tuple[str, str], ...] = (
    ("too_short", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 4 * n_lines"),
    ("shouting", "10 * n_upper > 4 * word_chars"),
    ("exclamations", "2 * n_bangs > n_words"),
    ("word_length", "word_chars > 20 * n_words"),
)
BIT = {name: 1 << n for n, (name, _) in enumerate(RULES)}

#: Version: rules that reject. ``base`` has the two fixed rules only.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_short", "repeated_words"),
    "v1": tuple(name for name, _ in RULES),
}


def policy_mask(version: str) -> int:
    return sum(BIT[name] for name in POLICIES[version])


def _measure_texts(texts: list[bytes]) -> dict[str, np.ndarray]:
    w = words_of(texts)
    n, counts = len(texts), w.counts()
    out = {"n_words": counts}
    starts = (w.data & 0xC0) != 0x80  # first byte of each code point
    before = np.concatenate([[0], np.cumsum(starts)])
    chars = before[w.ends] - before[w.starts]
    sums = np.concatenate([[0], np.cumsum(chars)])
    out["word_chars"] = sums[w.offsets[1:]] - sums[w.offsets[:-1]]
    out["n_symbols"] = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64)
    out["n_upper"] = np.array([len(t) - len(t.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) for t in texts], np.int64)
    out["n_bangs"] = np.array([t.count(b"!") for t in texts], np.int64)
    dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        worded = [x for x in t.split(b"\n") if x.strip()]
        lines[i], dup[i] = len(worded), len(worded) - len(set(worded))
    out["n_dup_lines"], out["n_lines"] = dup, lines
    at = whole_grams(w, 3)
    repeats = np.zeros(n, np.int64)
    if len(at):
        text = w.text_of_word()
        key = gram_hashes(word_hashes(w), 3)[at] + mix(text[at].astype(np.uint64))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = covered(len(w.starts), at[twice], 3)
        repeats += np.bincount(text[hit], minlength=n)
    out["n_repeat_words"] = repeats
    return out


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and MEASURES of every row of docs, by rows alone (no shuffle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            m = _measure_texts([t or b"" for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[c], pa.int64()) for c in MEASURES)], ["key", *MEASURES])

    plain = small_batches(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    kind = plain.schema["key"].dataType.simpleString()
    out = plain.mapInArrow(run, f"key {kind}, " + ", ".join(f"{c} long" for c in MEASURES))
    return out.withColumnRenamed("key", key)


def failure_bits() -> Column:
    bits = F.lit(0).cast("long")
    for name, rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, MEASURES and failed_bits; store it and apply policies to it later."""
    return measure(docs, key, text).withColumn("failed_bits", failure_bits())


def failed(version: str) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(policy_mask(version)).cast("long")) != 0


def apply_policy(entries: DataFrame, version: str = "v1") -> DataFrame:
    """The ledger with kept, the verdict of a policy, and policy, its version."""
    return entries.withColumn("kept", ~failed(version)).withColumn("policy", F.lit(version))


def ablation(entries: DataFrame, version: str = "v1") -> DataFrame:
    """For each rule of a policy: rule, n_failed (rows that fail it) and n_alone (rows that only it rejects), with n_docs and n_kept."""
    mask = F.lit(policy_mask(version)).cast("long")
    enforced = F.col("failed_bits").bitwiseAND(mask)
    total = entries.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(enforced == 0).alias("n_kept"),
        F.array(*(F.struct(F.lit(n).alias("rule"), F.count_if(enforced.bitwiseAND(F.lit(BIT[n]).cast("long")) != 0).alias("n_failed"), F.count_if(enforced == BIT[n]).alias("n_alone")) for n in POLICIES[version])).alias("rules"),
    )
    return total.select("n_docs", "n_kept", F.inline("rules"))


def judged(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """docs with their ledger entry (MEASURES and failed_bits) in one more column, and its name, which no column of docs has; one pass, no shuffle."""
    names = docs.columns
    entry = "ledger"
    while entry in names:
        entry += "_"
    places = [f"c{i}" for i in range(len(names))]  # measures can't clash with these
    plain, at = docs.toDF(*places), places[names.index(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, at):
            m = _measure_texts([t or b"" for t in texts])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(m[c], pa.int64()) for c in MEASURES)], [*places, *MEASURES])

    fields = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields), *(f"{c} long" for c in MEASURES)])
    entries = small_batches(plain).mapInArrow(run, fields).withColumn("failed_bits", failure_bits())
    return entries.select(*places, F.struct(*MEASURES, "failed_bits").alias("entry")).toDF(*names, entry), entry


def filter_documents(docs: DataFrame, version: str = "v1", text: str = "text") -> DataFrame:
    """The rows of docs that a policy keeps by their ledger entry, unchanged; decided row by row, so repeated rows and null ids stay as they are."""
    entries, entry = judged(docs, text)
    return entries.where(F.col(entry)["failed_bits"].bitwiseAND(F.lit(policy_mask(version)).cast("long")) == 0).drop(entry)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    entries = apply_policy(ledger(docs), "v1")
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed("base").alias("base_failed"), "kept", "failed_bits", "policy")


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS words FROM documents
), pos AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3
), tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS c FROM pos
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE c > 1) GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w
), dup AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '[^ \t\n\x0B\f\r]') GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(dup.n_lines, 0)::BIGINT AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_bangs
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)
), f AS (
  SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
    + 8 * (10 * n_dup_lines > 4 * n_lines)::INT + 16 * (10 * n_upper > 4 * word_chars)::INT + 32 * (2 * n_bangs > n_words)::INT
    + 64 * (word_chars > 20 * n_words)::INT)::BIGINT AS failed_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed,
  failed_bits = 0 AS kept, failed_bits, 'v1' AS policy FROM f
"""
