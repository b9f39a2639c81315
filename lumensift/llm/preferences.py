"""Preference formatting of chosen and rejected conversations.

Only DataFrame functions. The longest common turn prefix of a pair is rendered
once as prompt; what follows in each conversation is a completion, rendered with
the spans of characters that count for the loss (the assistant's contents; all
else is masked). ``pair_by_prompt`` makes pairs of a table of conversations:
those with an equal first turn answer the same prompt; in order of their ids, the
first of each two is taken as chosen and the second as rejected. What has no
partner is returned with an empty rejected side, so no conversation is lost.

A first turn that a third of all conversations share is no hot group: conversations are
dealt by ranges of (first turn, id), whatever the ids are, and ranks come from the counts of the ranges.

Defined results: turns are ordered by turn number, then role and text (repeated
rows stay, null numbers first); ``<|`` in a role or a text is rendered with a backslash between, so no text can forge the mark of a turn; a null role renders as ``none`` and a null text as
empty; turns are equal when role and text are (null equals null); ids may be numbers or
text; a turn without an id is a conversation of its own (these come first), so they are no group without bound; a missing side has no turn, so its common prefix is empty; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.durable import written

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def _shown(text: Column, default: str) -> Column:
    return F.replace(F.coalesce(text, F.lit(default)), F.lit(OPEN), F.lit("<\\|"))


def rendered_turn(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _shown(turn["role"], "none"), F.lit(MIDDLE), _shown(turn["text"], ""), F.lit(CLOSE))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered_turn), "")


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]), F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def loss_spans(turns: Column) -> Column:
    """start and end (code points in the rendered turns) of each assistant content that isn't empty."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(acc: Column, turn: Column) -> Column:
        head = F.length(_shown(turn["role"], "none")) + len(OPEN) + len(MIDDLE)
        size = F.length(_shown(turn["text"], ""))
        start = acc["at"] + head
        span = F.struct(start.alias("start"), (start + size).alias("end"))
        own = F.coalesce(turn["role"] == "assistant", F.lit(False)) & (size > 0)
        return F.struct((start + size + len(CLOSE)).alias("at"), F.when(own, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, add, lambda acc: acc["spans"])


def conversations(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key and turns, an ordered array of (role, text), and own, which tells conversations without a key apart."""
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(turn).cast("long"), F.lit(-(1 << 63))).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(role).alias("role"), F.col(text).alias("text"))))
    own = F.when(F.col(key).isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1).cast("long"))
    return turns.withColumn("own", own).groupBy(F.col(key).alias("key"), "own").agg(ordered.alias("turns")).select("key", "own", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def pair_by_prompt(convs: DataFrame) -> DataFrame:
    """chosen_id, chosen, rejected_id and rejected (arrays of turns) of conversations with equal first turns."""
    first = F.col("turns")[0]
    # two hashes of the first turn, as a key of fixed size
    asked = F.struct(F.xxhash64(first["role"], first["text"]).alias("a"), F.hash(first["text"], first["role"]).alias("b"))
    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["asked", F.asc_nulls_first("key"), "own"]
    dealt = written(convs.withColumn("asked", asked).repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy("asked").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("asked", "range").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("asked", "range").orderBy(F.asc_nulls_first("key"), "own")) - 1
    ranked = dealt.withColumn("rank", rank).join(counts.select("asked", "range", "before"), ["asked", "range"]).withColumn("rank", F.col("rank") + F.col("before"))
    side = lambda s, c: F.max(F.when(F.col("rank") % 2 == s, F.struct(F.col("key"), F.col("turns"), F.lit(1).alias("there"))))[c]
    paired = ranked.groupBy("asked", F.floor(F.col("rank") / 2).alias("pair")).agg(side(0, "key").alias("chosen_id"), side(0, "turns").alias("chosen"), side(1, "key").alias("rejected_id"), side(1, "turns").alias("rejected"))
    return paired.select("chosen_id", "chosen", "rejected_id", "rejected")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """The ids, n_prompt_turns, prompt, and for each side the completion, its loss spans and their text length."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    full = pairs.select("chosen_id", "rejected_id", F.coalesce("chosen", none).alias("chosen"), F.coalesce("rejected", none).alias("rejected"))
    cut = full.withColumn("n_prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.greatest(F.size(c), F.lit(1)))
    parts = cut.select("chosen_id", "rejected_id", "n_prompt_turns", F.slice("chosen", F.lit(1), F.col("n_prompt_turns")).alias("shared"), rest("chosen").alias("chosen"), rest("rejected").alias("rejected"))
    return parts.select(
        "chosen_id", "rejected_id", "n_prompt_turns", rendered(F.col("shared")).alias("prompt"),
        rendered(F.col("chosen")).alias("chosen_completion"), loss_spans(F.col("chosen")).alias("chosen_spans"),
        rendered(F.col("rejected")).alias("rejected_completion"), loss_spans(F.col("rejected")).alias("rejected_spans"),
    )


def _spans_text(c: str) -> Column:
    return F.array_join(F.transform(F.col(c), lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    formatted = format_pairs(pair_by_prompt(conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    return formatted.withColumn("chosen_spans", _spans_text("chosen_spans")).withColumn("rejected_spans", _spans_text("rejected_spans"))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations
), c AS (
  SELECT conv_id, max(CASE WHEN i = 1 THEN {'r': role, 't': text} END) AS asked, list({'role': role, 'text': text} ORDER BY i) AS turns FROM t GROUP BY conv_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY asked ORDER BY conv_id) - 1 AS rank FROM c
), p AS (
  SELECT a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.turns AS chosen, coalesce(b.turns, []) AS rejected
  FROM r a LEFT JOIN r b ON a.asked IS NOT DISTINCT FROM b.asked AND b.rank = a.rank + 1 WHERE a.rank % 2 = 0
), same AS (
  SELECT *, coalesce((SELECT min(i) FROM range(1, len(chosen) + 1) g(i) WHERE i > len(rejected) OR chosen[i] IS DISTINCT FROM rejected[i]) - 1, len(chosen))::INT AS n FROM p
), side AS (
  SELECT chosen_id, rejected_id, n, 'p' AS s, unnest(chosen[:n]) AS x, unnest(range(1, n + 1)) AS i FROM same WHERE n > 0
  UNION ALL SELECT chosen_id, rejected_id, n, 'c', unnest(chosen[n + 1:]), unnest(range(n + 1, len(chosen) + 1)) FROM same
  UNION ALL SELECT chosen_id, rejected_id, n, 'r', unnest(rejected[n + 1:]), unnest(range(n + 1, len(rejected) + 1)) FROM same
), shown AS (
  SELECT chosen_id, s, i, x.role AS role, '<|' || replace(coalesce(x.role, 'none'), '<|', '<\|') || '|>' || chr(10) AS head, replace(coalesce(x.text, ''), '<|', '<\|') AS body FROM side
), placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 8) OVER (PARTITION BY chosen_id, s ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS from_ FROM shown
), made AS (
  SELECT chosen_id, s, string_agg(head || body || '<|end|>' || chr(10), '' ORDER BY i) AS txt,
    string_agg(CAST(from_ AS BIGINT) || '-' || CAST(from_ + length(body) AS BIGINT), ',' ORDER BY i) FILTER (role = 'assistant' AND body <> '') AS spans FROM placed GROUP BY chosen_id, s
)
SELECT same.chosen_id, rejected_id, n AS n_prompt_turns, coalesce(p.txt, '') AS prompt, coalesce(c.txt, '') AS chosen_completion, coalesce(c.spans, '') AS chosen_spans,
  coalesce(r.txt, '') AS rejected_completion, coalesce(r.spans, '') AS rejected_spans
FROM same LEFT JOIN made p ON p.chosen_id = same.chosen_id AND p.s = 'p' LEFT JOIN made c ON c.chosen_id = same.chosen_id AND c.s = 'c'
LEFT JOIN made r ON r.chosen_id = same.chosen_id AND r.s = 'r'
"""
