"""Benchmark decontamination with a broadcast set of normalised n-grams.

Only DataFrame functions: texts are normalised and cut into token windows on the
JVM, the windows are looked up in a hash set of the benchmark's windows, and
what is found is already equal as text, so no hash can mislead. The set is
broadcast when its counted size is under ``BROADCAST_NGRAMS`` windows and
``BROADCAST_BYTES`` with the ids of their items; a larger one
is joined by shuffle, which gives the same rows.

Normal form: A-Z becomes a-z, words are runs of characters that are ASCII
letters, ASCII digits or not ASCII. An item with fewer words than the window, but
not none, is one window of all its words.

Defined results: a null or blank text has no words, no hits and isn't
contaminated; a null or blank item has no windows; equal items share a window
and each of them counts; repeated document rows are scored by themselves (a
row number that never leaves the operator tells them apart, null ids included);
empty tables give no hits or no rows; other columns are not carried except by
``drop_contaminated`` and ``remove_spans``, which keep all columns of docs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.durable import written
from ..functions.membership import may_hold

WINDOW = 13

#: Distinct windows, and bytes of windows and item ids, up to which the set is broadcast.
BROADCAST_NGRAMS = 200_000
BROADCAST_BYTES = 32 << 20

#: A document is contaminated when SHARE * hit words >= words.
SHARE = 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SEPARATORS = "".join(map(chr, [*range(1, 48), *range(58, 65), *range(91, 97), *range(123, 128)]))


def words(text: Column) -> Column:
    # translate can't name U+0000, so it is replaced by itself
    plain = F.translate(F.replace(F.coalesce(text, F.lit("")), F.lit("\0"), F.lit(" ")), _UPPER + _SEPARATORS, _UPPER.lower() + " " * len(_SEPARATORS))
    return F.array_remove(F.split(plain, " "), "")


def windows(tokens: Column, n: int) -> Column:
    """Every run of n words as one string; none if there are fewer."""
    last = F.size(tokens) - n
    return F.when(last < 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(tokens, i + 1, F.lit(n)), " ")))


def ngram_set(bench: DataFrame, n: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """ngram, its number of words, and the ids of the items that have it."""
    cut = bench.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    grams = F.when(F.size("w") < n, F.array(F.array_join("w", " "))).otherwise(windows(F.col("w"), n))
    return cut.select("item", size.alias("n"), F.explode(grams).alias("ngram")).groupBy("ngram", "n").agg(F.collect_set("item").alias("items"))


def _held(grams: DataFrame) -> DataFrame:
    """The set, marked for broadcast if it is counted as small enough."""
    size = F.octet_length("ngram") + F.aggregate("items", F.lit(0), lambda s, x: s + F.octet_length(x) + 16)
    told = grams.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return F.broadcast(grams) if told["n"] <= BROADCAST_NGRAMS and told["bytes"] <= BROADCAST_BYTES else grams


def _anchored(cut: DataFrame, grams: DataFrame, n: int, held: DataFrame) -> DataFrame:
    """key, pos, n, items of the hits among windows of n words, found without building every window.

    A window of n words holds a run of ``g`` words that starts at a multiple of
    ``n - g + 1``, and exactly one. So documents are probed at those places alone
    with runs of g words, and only where the benchmark has the run are the windows
    around it built and looked up. No hit can be missed or found twice.
    """
    g = max(1, n // 2 + 2)
    step = n - g + 1
    runs = grams.where(F.col("n") == n).select(F.explode(windows(F.split("ngram", " "), g)).alias("run")).distinct()
    count = runs.limit(BROADCAST_NGRAMS + 1).count()
    last = F.size("w") - g
    from_ = lambda p: F.greatest(p - (step - 1), F.lit(0))
    probes = F.when(last < 0, F.array()).otherwise(
        F.transform(
            F.sequence(F.lit(0), last, F.lit(step)),
            lambda p: F.struct(from_(p).alias("at"), F.array_join(F.slice("w", p + 1, F.lit(g)), " ").alias("run"), F.array_join(F.slice("w", from_(p) + 1, p + n - from_(p)), " ").alias("around")),
        )
    )
    near = cut.select("key", F.inline(probes)).join(F.broadcast(runs) if count <= BROADCAST_NGRAMS else runs, "run", "left_semi")
    cuts = near.select("key", "at", F.posexplode(windows(F.split("around", " "), n)).alias("j", "ngram"))
    return cuts.join(held.where(F.col("n") == n).drop("n"), "ngram").select("key", (F.col("at") + F.col("j")).alias("pos"), F.lit(n).alias("n"), "items")


def hits(docs: DataFrame, bench: DataFrame, n: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, n, items for every window of docs that is in the benchmark's set."""
    grams = ngram_set(bench, n)
    sizes = sorted(r[0] for r in grams.select("n").distinct().collect())  # at most n values
    if not sizes:
        return docs.select(F.col(key).alias("key"), F.lit(0).alias("pos"), F.lit(n).alias("n"), F.array().cast("array<string>").alias("items")).limit(0)
    cut = docs.select(F.col(key).alias("key"), words(F.col(text)).alias("w"))
    held = _held(grams)
    found = []
    for size in sizes:
        if size == n:
            found.append(_anchored(cut, grams, n, held))
        else:  # short items are windows of their own size
            exploded = cut.select("key", F.posexplode(windows(F.col("w"), size)).alias("pos", "ngram"))
            found.append(exploded.join(held.where(F.col("n") == size).drop("n"), "ngram").select("key", "pos", F.lit(size).alias("n"), "items"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def hit_counts(found: DataFrame) -> DataFrame:
    """key, n_hit (words in any window found) and the items found, sorted as strings."""
    by_start = Window.partitionBy("key").orderBy("pos", "n")
    before = F.max(F.col("pos") + F.col("n")).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("pos") + F.col("n")
    new = F.greatest(F.lit(0), end - F.greatest(F.col("pos"), F.coalesce(before, F.lit(0))))
    spans = found.withColumn("new", new)
    return spans.groupBy("key").agg(F.sum("new").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def score(docs: DataFrame, bench: DataFrame, n: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs.

    Rows with equal keys (nulls too) are told apart by the text's digest, so that repeated rows get equal results.
    """
    tagged = docs.select(F.col(key).alias("id"), F.struct(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("h")).alias("key"), F.col(text).alias("text"))
    counts = hit_counts(hits(tagged, bench, n, "key", "text").distinct())
    base = tagged.select("id", "key", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = base.join(counts, base["key"].eqNullSafe(counts["key"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        F.col("id").alias(key), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, n: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the contaminated rows, all columns unchanged.

    Only documents with a hit are judged again, and only those that may be contaminated are shuffled to meet the verdict.
    """
    tag = F.struct(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("h"))
    tagged = docs.select(tag.alias("key"), F.col(text).alias("text"))
    counts = hit_counts(hits(tagged, bench, n, "key", "text").distinct()).select("key", "n_hit")
    sized = tagged.select("key", F.size(words(F.col("text"))).alias("n_words")).distinct()
    bad = sized.join(counts, "key").where(SHARE * F.col("n_hit") >= F.col("n_words")).select(F.col("key").alias("decontaminate:key"))
    bad = written(bad)
    listed = may_hold(bad.select("`decontaminate:key`.id", "`decontaminate:key`.h"), [F.col(key), F.xxhash64(F.col(text))])
    return docs.where(~listed).unionByName(docs.where(listed).join(bad, tag.eqNullSafe(bad["decontaminate:key"]), "left_anti"))


def remove_spans(docs: DataFrame, bench: DataFrame, n: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every hit word cut out of the normalised words; texts without a hit stay as they are."""
    tag = F.struct(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("h"))
    tagged = docs.select(tag.alias("key"), F.col(text).alias("text"))
    spans = hits(tagged, bench, n, "key", "text").distinct().groupBy("key").agg(F.collect_list(F.struct("pos", "n")).alias("decontaminate:spans")).withColumnRenamed("key", "decontaminate:key")
    joined = docs.join(spans, tag.eqNullSafe(spans["decontaminate:key"]), "left")
    w = words(F.col(text))
    kept = F.filter(w, lambda x, i: ~F.exists(F.col("`decontaminate:spans`"), lambda s: (s["pos"] <= i) & (i < s["pos"] + s["n"])))
    return joined.withColumn(text, F.when(F.col("`decontaminate:spans`").isNull(), F.col(text)).otherwise(F.array_join(kept, " "))).drop("decontaminate:key", "decontaminate:spans")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return score(docs, bench)


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM g),
p AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hit AS (SELECT p.doc_id, p.i, p.n, g.item_id FROM p JOIN g ON p.gram = g.gram AND p.n = g.n
), covered AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
