"""Photo catalogs made from the test tables, so that every operator runs on data of any size.

The SQL below runs in Spark and in DuckDB alike: whole numbers, doubles written with an
exponent, and text only, so both start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab as V
from ..operators import similarity


def _pick(expression: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {n} THEN '{v}'" for n, v in enumerate(values))
    return f"CASE {expression} WHEN {len(values)} THEN '' {whens} ELSE '' END"


_K = "CAST(floor(o_totalprice * 100e0 + 0.5e0) AS BIGINT)"

PHOTOS = f"""
SELECT idx, '/photos/' || lower(seg) || '/IMG_' || lpad(CAST(idx AS STRING), 9, '0') || '.jpg' AS path, 'IMG_' || lpad(CAST(idx % 997 AS STRING), 4, '0') || '.jpg' AS filename,
  CASE WHEN idx % 7 = 0 THEN '' ELSE substr(CAST(ts AS STRING), 1, 10) END AS taken_at, CAST(1200 + idx % 41 * 100 AS INT) AS width, CAST(900 + cust % 37 * 100 AS INT) AS height, (k % 2500) / 100e0 AS file_size_mb,
  CASE WHEN k % 11 = 0 THEN NULL ELSE (k % 10007) / 100.07e0 END AS basic_score, CASE WHEN k % 13 = 0 THEN NULL ELSE (k % 9973) / 99.73e0 END AS face_score, CASE WHEN k % 17 = 0 THEN NULL ELSE (k % 977) / 9.77e0 END AS pose_score,
  CASE WHEN k % 19 = 0 THEN NULL ELSE (k % 8999) / 89.99e0 END AS expression_score, CASE WHEN k % 23 = 0 THEN NULL ELSE (k % 7919) / 79.19e0 END AS composition_score, (k % 101) / 101e0 AS business_confidence,
  {_pick("k % 5", ["虚焦", "曝光问题", "未知问题"])} AS p_basic, {_pick("k % 7", ["闭眼", "裁切风险"])} AS p_face, {_pick("k % 9", ["表情弱", "表情崩", "闭眼"])} AS p_expression, {_pick("k % 8", ["背景杂乱", "构图普通"])} AS p_composition,
  {_pick("k % 14", V.PHOTO_TYPES)} AS photo_type, CASE WHEN k % 3 = 0 THEN '' ELSE '全身' END AS subtype, {_pick("k % 6", list(V.RATINGS))} AS quality_rating,
  {_pick("k % 10", V.MANUAL_CATEGORIES + ["精选"])} AS manual_category, k % 4 = 0 AS manual_override, {_pick("k % 16", V.PRIMARY_CATEGORIES)} AS ai_primary_category, CASE WHEN k % 2 = 0 THEN '' ELSE '其他单人' END AS ai_secondary_category,
  (k % 1009) / 1009e0 AS ai_confidence, CASE WHEN k % 3 = 1 THEN '组' || lpad(CAST(cust % 499 AS STRING), 3, '0') ELSE '' END AS similar_group_id, {_pick("k % 12", V.GROUP_STATUSES)} AS similar_group_status, k % 21 = 0 AS best_in_group, k % 15 = 0 AS ai_recommended_best,
  {_pick("k % 5", V.REVIEW_STATUSES)} AS review_status, {_pick("k % 10", V.DELIVERY_USES)} AS u1, {_pick("k % 29", V.DELIVERY_USES)} AS u2, {_pick("k % 31", V.ISSUE_TAGS)} AS t1, {_pick("k % 37", V.ISSUE_TAGS)} AS t2,
  CASE WHEN k % 4 = 1 THEN 0e0 ELSE (k % 1003) / 10.03e0 END AS absolute_quality_score, CASE WHEN k % 5 = 1 THEN 0e0 ELSE (k % 1013) / 10.13e0 END AS commercial_score, (k % 1019) / 10.19e0 AS portfolio_score, (k % 1021) / 10.21e0 AS semantic_score,
  (k % 1031) / 10.31e0 AS relative_quality_score, CASE WHEN k % 2 = 0 THEN 0e0 ELSE (k % 1033) / 10.33e0 END AS final_pick_score, (k % 103) / 103e0 AS preference, {_pick("k % 5", list(V.PICK_WEIGHTS))} AS strategy,
  CAST(k % 8 AS INT) AS people, (k % 907) * 1e0 AS lap, (k % 256) * 1e0 AS mean, (k % 53) / 100e0 AS bright, (k % 59) / 100e0 AS dark, (k % 61) / 100e0 AS edge, (k % 67) / 67e0 AS centre, CAST(k % 3 AS INT) AS eyes, (k % 71) * 1e0 AS contrast,
  '' AS final_category, '' AS final_recommendation, CASE WHEN k % 6 = 0 THEN '备注' ELSE '' END AS review_note, k, seg, cust, ts
FROM (SELECT o_orderkey AS idx, {_K} AS k, c_mktsegment AS seg, c_custkey AS cust, o_orderdate AS ts FROM orders JOIN customer ON o_custkey = c_custkey) base
"""

#: For DuckDB: the same rows with their lists.
PHOTOS_SQL = f"photos AS (SELECT *, list_filter([u1, u2], lambda x: x <> '') AS delivery_use, list_filter([t1, t2], lambda x: x <> '') AS issue_tags FROM ({PHOTOS}) p)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of one photo an order, with every column that the rules read."""
    flat = spark.sql(PHOTOS.replace("FROM orders JOIN customer", "FROM {orders} JOIN {customer}"), orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))
    filled = lambda *c: F.filter(F.array(*c), lambda x: x != "")
    return flat.withColumns({"delivery_use": filled("u1", "u2"), "issue_tags": filled("t1", "t2")})


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, hash, filename, area, score and label of photos made from embedding vectors (an 8 x 8 grid each)."""
    grid = F.col("embedding").cast("array<double>")
    v = table(spark, sf_dir, "embeddings")
    return v.select(
        F.col("vec_id").alias("idx"), similarity.average_hash(grid).alias("hash"), F.concat(F.lit("VEC_"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("filename"), (F.pmod(F.col("vec_id") * 7919, F.lit(5000)) + 1).alias("area"),
        F.pmod(F.col("vec_id") * 104729, F.lit(1009)).cast("double").alias("score"), F.col("label").cast("string").alias("label"), grid.alias("vector"),
    )


#: For DuckDB: idx, bits (as text), area, score, label and vector.
VECTORS_SQL = """vectors AS (
  SELECT vec_id AS idx, array_to_string(list_transform(e, lambda x: CASE WHEN x >= list_sum(e) / len(e) THEN '1' ELSE '0' END), '') AS bits,
    'VEC_' || vec_id || '.jpg' AS filename, vec_id * 7919 % 5000 + 1 AS area, (vec_id * 104729 % 1009)::DOUBLE AS score, label::VARCHAR AS label, e AS vector
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) x
)"""


def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The photos of ``vectors`` as bursts of four: hashes of a burst are that of its first vector with some bits flipped, 0, 1, 6 and 11 of them, or in every third burst 0, 1, 20 and 33. First vectors are merged with theirs: they are too many to be gathered in the driver, however small their files look."""
    v = vectors(spark, sf_dir)
    base = F.col("idx") - F.pmod("idx", F.lit(4))
    flips = F.get(F.when(F.pmod(base / 4, F.lit(3)) == 0, F.array(*map(F.lit, (0, 1, 20, 33)))).otherwise(F.array(*map(F.lit, (0, 1, 6, 11)))), F.pmod("idx", F.lit(4)).cast("int"))
    bits = F.transform(F.slice(F.sequence(F.lit(0), F.lit(63)), F.lit(1), flips), lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), (63 - F.pmod(base * 7 + j * 5, F.lit(64))).cast("int")))
    mask = F.aggregate(bits, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
    first = v.select(F.col("idx").alias("base_"), F.col("hash").alias("of_"))
    return v.withColumns({"base_": base, "mask_": mask}).join(first.hint("merge"), "base_").withColumn("hash", F.col("of_").bitwiseXOR(F.col("mask_"))).drop("base_", "mask_", "of_")


#: For DuckDB, after VECTORS_SQL: the rows of ``bursts`` as vectors.
BURSTS_SQL = f"""{VECTORS_SQL.replace("vectors AS", "plain AS", 1)}, flipped AS (
  SELECT p.* EXCLUDE (bits), b.bits AS base_bits, b.idx AS base, (CASE WHEN b.idx // 4 % 3 = 0 THEN [0, 1, 20, 33] ELSE [0, 1, 6, 11] END)[p.idx % 4 + 1] AS n FROM plain p JOIN plain b ON b.idx = p.idx - p.idx % 4
), vectors AS (
  SELECT * EXCLUDE (base_bits, base, n),
    array_to_string(list_transform(range(0, 64), lambda i: CASE WHEN list_contains(list_transform(range(0, n), lambda j: (base * 7 + j * 5) % 64), i) THEN (1 - base_bits[i + 1]::INT)::VARCHAR ELSE base_bits[i + 1] END), '') AS bits
  FROM flipped
)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference samples made from documents and their labels."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    label = F.when(F.col("toxic") == 1, "废片").when(F.col("quality") == 1, "精选").when(F.col("quality") == 0, "可用待修").otherwise("")
    vector = F.array(F.col("n_chars") / 10000.0, F.length("lang") / 10.0, F.pmod("doc_id", F.lit(97)) / 97.0)
    return d.select("doc_id", "lang", "source", "n_chars").join(l, "doc_id", "left").select(F.col("doc_id").alias("idx"), label.alias("user_label"), F.lit("").alias("manual_category"), vector.alias("features"), "lang", "source", "n_chars")


DOCUMENTS_SQL = """samples AS (
  SELECT d.doc_id AS idx, CASE WHEN toxic = 1 THEN '废片' WHEN quality = 1 THEN '精选' WHEN quality = 0 THEN '可用待修' ELSE '待定' END AS label,
    [n_chars / 10000e0, length(lang) / 10e0, (d.doc_id % 97) / 97e0] AS features, lang, source, n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""
