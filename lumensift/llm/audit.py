"""Filter interaction audit: what each order of filters removes, from one Walsh-Hadamard transform.

Every document becomes a mask, one bit for each filter that it fails. Masks aren't
counted by cell: for each part and label the 2^n *parity sums* are aggregated,
the number of documents with an even less that with an odd number of failures
among a set of filters. This transform is its own inverse up to the factor 2^n, so the cells are
exact whole numbers. Whatever an order removes, keeps or finds failed already,
and the Shapley value of a filter (a document that fails k filters is removed by
each of them in n!/k orders), are sums over cells.

The one filter that looks beyond its row, a copy of an earlier document, is
decided by hashes: rows are counted by text hash and id, then by text hash, part and
label with the smallest id, so a group of copies arrives at its hash as at most
one row for each task, part and label, and its texts are never shuffled.

Defined results: a null text is empty; a null part is the empty string; null ids
come after all others, have no labels, and aren't earlier than each other;
repeated rows are counted each, with the same id none is earlier; repeated labels count once, null labels as 0; texts are compared by
a 128-bit hash; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .packing import token_count

#: The filters in the order of their bits. COPY is decided over the table, the others by the text.
FILTERS = "ABCDE"
COPY = "E"

SUMS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def text_mask(text: Column) -> Column:
    """The bits of the filters that a text fails by itself."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(F.translate(t, "\t\n\x0b\x0c\r", "     "), " "), "")
    n = token_count(text)
    capitals = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    marked = F.length(t) != F.length(F.translate(t, "#$%&*|", ""))
    fails = {"A": n < 100, "B": 100 * F.size(F.array_distinct(words)) < 80 * n, "C": 100 * capitals > 10 * F.length(t), "D": marked}
    out = F.lit(0)
    for letter, failed in fails.items():
        out = out.bitwiseOR(F.when(failed, F.lit(_bit(letter))).otherwise(F.lit(0)))
    return out


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """part, good, toxic, mask and n: counts of documents, in as many rows as the grouping by text needs."""
    t = F.coalesce(F.col(text), F.lit(""))
    plain = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_mask(F.col(text)).alias("own"), F.md5(t).alias("h"))
    by_id = plain.groupBy("h", "id", "part", "own").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"), F.lit("").alias("spread")
    )
    # null ids meet no label; their hash spreads them over the tasks
    spread = F.when(F.col("id").isNull(), F.col("h")).otherwise(F.lit(""))
    told = by_id.withColumn("of", spread).join(marks, (F.col("id") == F.col("label_id")) & (F.col("of") == F.col("spread")), "left")
    good, toxic = (F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"))
    groups = told.groupBy("h", "own", "part", good, toxic).agg(F.sum("n").alias("n"), F.min(F.struct(order.alias("order"), F.col("n").alias("first"))).alias("least"))
    smallest = F.min("least.order").over(Window.partitionBy("h"))
    first = F.when(F.col("least.order") == smallest, F.col("least.first")).otherwise(F.lit(0))
    counted = groups.withColumn("at_first", first)
    copies = F.struct((F.col("own").bitwiseOR(F.lit(_bit(COPY)))).alias("mask"), (F.col("n") - F.col("at_first")).alias("n"))
    return counted.select("part", "good", "toxic", F.inline(F.array(F.struct(F.col("own").alias("mask"), F.col("at_first").alias("n")), copies))).where("n > 0")


def parity_sums(counted: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """part, good, toxic and sums: for each set of filters, the rows of counted with an even number of failures in it less those with an odd one."""
    each = [F.expr(f"sum(n * (1 - 2 * (bit_count(mask & {s}) % 2)))").alias(f"s{s}") for s in range(1 << filters)]
    return counted.groupBy("part", "good", "toxic").agg(*each).select("part", "good", "toxic", F.array(*(f"s{s}" for s in range(1 << filters))).alias("sums"))


def cells(sums: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """part and three arrays by mask, inverted from the parity sums: all, good and toxic documents that fail exactly these filters."""
    size = 1 << filters
    inverted = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda m: F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0).cast("long"), lambda a, s: a + F.get("sums", s) * (1 - 2 * (F.bit_count(m.bitwiseAND(s)) % 2)), lambda a: F.shiftright(a, filters)),
    )
    by_label = sums.select("part", "good", "toxic", inverted.alias("c"))
    total = lambda name, only: F.expr("array(" + ", ".join(f"sum(if({only}, c[{m}], 0L))" for m in range(size)) + ")").alias(name)
    return by_label.groupBy("part").agg(total("all", "true"), total("good", "good"), total("toxic", "toxic"))


def orders(table: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and SUMS of every order of the filters, from the cells of each part."""
    n, size = len(filters), 1 << len(filters)
    every = F.sequence(F.lit(0), F.lit(size - 1))
    listed = table.withColumn("filter_order", F.explode(F.split(F.lit(" ".join(map("".join, permutations(filters)))), " ")))
    steps = listed.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    bits = lambda letters: sum((F.when(F.contains(letters, F.lit(x)), F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(filters)), F.lit(0))
    placed = steps.withColumn("before", bits(F.substring("filter_order", F.lit(1), F.col("step") - 1))).withColumn("own", bits(F.substring("filter_order", F.col("step"), F.lit(1))))

    def total(name: str, chosen, weight=lambda m: F.lit(1)) -> Column:
        return F.aggregate(every, F.lit(0).cast("long"), lambda a, m: a + F.when(chosen(m), F.get(name, m) * weight(m)).otherwise(F.lit(0).cast("long")))

    before, own = F.col("before"), F.col("own")
    hit = lambda m, bits: m.bitwiseAND(bits) != 0
    here = lambda m: hit(m, own) & ~hit(m, before)
    made = {
        "kept": total("all", lambda m: ~hit(m, own.bitwiseOR(before))),
        "removed": total("all", here),
        "redundant": total("all", lambda m: hit(m, own) & hit(m, before)),
        "unique_fails": F.get("all", own),
        "good_lost": total("good", here),
        "toxic_lost": total("toxic", here),
        "shapley": total("all", lambda m: hit(m, own), lambda m: (F.lit(factorial(n)) / F.bit_count(m)).cast("long")),
    }
    return placed.select("part", "filter_order", "step", *(c.alias(name) for name, c in made.items()))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """part, filter_order, step and SUMS: every step of every order of FILTERS in every part of docs."""
    return orders(cells(parity_sums(masks(docs, labels, part, key, text))))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS words FROM documents
), f AS (
  SELECT w.doc_id, part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    doc_id > min(doc_id) OVER (PARTITION BY t) AS e, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
  FROM w LEFT JOIN labels l USING (doc_id)
), n AS (
  SELECT *, a::INT + b::INT + c::INT + d::INT + e::INT AS fails, {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS failed FROM f
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT [p.x, q.x, r.x, s.x, u.x] AS o FROM letters p, letters q, letters r, letters s, letters u
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5
), steps AS (
  SELECT o, unnest(range(1, 6)) AS step FROM orders
), judged AS (
  SELECT part, o, step, good, toxic, fails, list_transform(o, lambda x: CASE x WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS hit FROM n, steps
), placed AS (
  SELECT *, coalesce(list_position(hit, true), 6) AS place, hit[step] AS own FROM judged
), counts AS (
  SELECT part, array_to_string(o, '') AS filter_order, o[step] AS letter, step::INT AS step, count_if(place > step)::BIGINT AS kept, count_if(place = step)::BIGINT AS removed,
    count_if(own AND place < step)::BIGINT AS redundant, count_if(own AND fails = 1)::BIGINT AS unique_fails, count_if(place = step AND good)::BIGINT AS good_lost,
    count_if(place = step AND toxic)::BIGINT AS toxic_lost
  FROM placed GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM counts
"""
