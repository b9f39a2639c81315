"""Queries of what grows: streams with state, any number of labels, folders; registered beside those of ``catalog_queries``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.durable import written
from ..functions.ranks import build_index, index_places
from ..operators import export, preference, vectors
from ..sources import adapters as A
from ..sources import photo_source, value_cache
from ..streaming import protection
from .catalog_queries import _with, query
from .review_queries import _folder

_KEYED = "SELECT '/u/' || user_id AS key, ts AS happened, event_id, event_type = 'purchase' AS human, event_type AS status, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'v' || event_id END AS note, 1 AS n FROM events"


@query(
    "q_protected_stream",
    f"""WITH e AS ({_KEYED}) SELECT key, human, epoch_us(happened)::BIGINT AS at_us, event_id, status, note, (SELECT count(*) FROM e x WHERE x.key = e.key) AS n_events
    FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY human DESC, happened DESC, event_id DESC) = 1""",
)
def protected_stream(spark, d):
    """Events in files of a million or so, four sets of them; each set is a micro-batch and the third has every tenth event again; the stream stops after two files and is started anew."""
    e = A.table(spark, d, "events").select(
        F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("at"), "event_id", (F.col("event_type") == "purchase").alias("human"), F.col("event_type").alias("status"),
        F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("v"), F.col("event_id").cast("string"))).alias("note"),
    )
    source, out, mark = _folder(spark), _folder(spark), _folder(spark)
    files = e.count() // 4_000_000 + 1
    part = lambda n: e.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == n)
    for own, then_run in ((part(0), False), (part(1), True), (part(2).unionByName(e.where("event_id % 10 = 0")), False), (part(3), True)):
        (own.repartition(files) if files > 1 else own.coalesce(1)).write.mode("append").parquet(source)
        if then_run:
            stream = spark.readStream.schema(protection.EVENT).option("maxFilesPerTrigger", files).parquet(source)
            protection.run(stream, out, mark, late="3650 days", keep_ms=3650 * 86_400_000)
    return protection.standing(spark, out).select("key", "human", F.unix_micros("at").alias("at_us"), "event_id", "status", "note", "n_events")


_VECTORS = "WITH v AS (SELECT vec_id AS idx, 'l' || vec_id AS label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE idx % 20 = 0)"


def _named_vectors(spark, d):
    v = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.concat(F.lit("l"), F.col("vec_id").cast("string")).alias("label"), F.col("embedding").alias("vector"))
    return v.where("idx % 20 = 0").select("idx", "vector"), v.select("label", "vector")


@query(
    "q_nearest_vectors",
    _VECTORS + """, d AS (SELECT q.idx, v.label, sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance FROM q, v)
    SELECT idx, row_number() OVER (PARTITION BY idx ORDER BY distance, label)::INT AS place, label, round(distance, 6)::DOUBLE AS distance FROM d QUALIFY place <= 10""",
)
def nearest_vectors(spark, d):
    """The ten nearest of all vectors to each twentieth one."""
    q, v = _named_vectors(spark, d)
    return vectors.matches(q, v, 10).withColumn("distance", F.round("distance", 6))


@query(
    "q_likeliest_vectors",
    _VECTORS + """, z AS (SELECT q.idx, v.label, 100 * list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)) AS z FROM q, v),
    p AS (SELECT idx, label, exp(z - max(z) OVER w) / sum(exp(z - 100)) OVER w * exp(max(z) OVER w - 100) AS p, row_number() OVER (PARTITION BY idx ORDER BY z DESC, label)::INT AS place FROM z WINDOW w AS (PARTITION BY idx))
    SELECT idx, place, label, round(p, 6)::DOUBLE AS probability FROM p WHERE place <= 3""",
)
def likeliest_vectors(spark, d):
    """Labels as many as there are vectors, by the softmax of cosines."""
    q, v = _named_vectors(spark, d)
    return vectors.matches(q, v, 3, scale=100.0).withColumn("probability", F.round("probability", 6))


@query("q_view_places", _with("""SELECT idx, row_number() OVER w AS place, lag(idx) OVER w AS previous, lead(idx) OVER w AS next FROM photos WINDOW w AS (ORDER BY lower(filename), idx) QUALIFY idx % 20 = 0"""))
def view_places(spark, d):
    """Place, previous and next photo of each twentieth one in the order of names, from an index of the order that is read by ranges."""
    p = A.photos(spark, d).select(F.lower("filename").alias("name"), "idx")
    index = build_index(p, ["name", "idx"], _folder(spark))
    return index_places(p.where("idx % 20 = 0"), index).select("idx", F.col("place").cast("long").alias("place"), F.col("previous.idx").alias("previous"), F.col("next.idx").alias("next"))


@query(
    "q_incremental_centroids",
    f"""WITH {A.DOCUMENTS_SQL}, u AS (SELECT label, unnest(features) AS x, unnest(range(len(features))) AS pos FROM samples),
    m AS (SELECT label, pos, count(*) AS n, avg(x) AS c, stddev_pop(x) AS s FROM u GROUP BY 1, 2)
    SELECT label, max(n) AS n, round(max(c) FILTER (pos = 0), 6) AS c0, round(max(c) FILTER (pos = 1), 6) AS c1, round(max(c) FILTER (pos = 2), 6) AS c2, round(max(s) FILTER (pos = 0), 5) AS s0, round(max(s) FILTER (pos = 2), 5) AS s2 FROM m GROUP BY label""",
)
def incremental_centroids(spark, d):
    """A model store that learns samples in three parts; each part is read once."""
    at, samples = _folder(spark), A.documents(spark, d)
    for n in range(3):
        preference.learn(samples.where(F.pmod("idx", F.lit(3)) == n), at)
    c = preference.centroids_of(preference.learnt(spark, at))
    one = lambda name, n, places: F.round(F.get(name, F.lit(n)), places)
    return c.select("label", "n", *(one("centroid", n, 6).alias(f"c{n}") for n in range(3)), one("deviation", 0, 5).alias("s0"), one("deviation", 2, 5).alias("s2"))


def _made_files(files: DataFrame, at: str, of: Callable[[str], bytes]) -> None:
    """Writes a file for each row of files (name, content) below a folder, by executors."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = export.store_of(at)
        for batch in batches:
            for own, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store.create_dir(f"{top}/{own}".rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{top}/{own}") as f:
                    f.write(of(content))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    export.dealt(files).mapInArrow(write, "n long").agg(F.sum("n")).collect()


_EXTENSIONS = ["jpg", "JPEG", "png", "webp", "cr2", "NEF", "txt", "tar.jpg"]
_HEADS = {"jpg": b"\xff\xd8\xff\xe0 rest", "jpeg": b"\xff\xd8\xff\xe0 rest", "png": b"\x89PNG\r\n\x1a\n rest", "webp": b"RIFF0000WEBP rest"}


@query(
    "q_scan",
    f"""WITH f AS (SELECT c_custkey AS k, lower(c_mktsegment) AS branch, {_EXTENSIONS}[c_custkey % 8 + 1] AS ext FROM customer),
    n AS (SELECT k, branch, CASE WHEN k % 9 = 0 THEN '/skip/' WHEN k % 3 = 0 THEN '/deep/er/' ELSE '/' END AS mid, 'IMG_' || k || '.' || ext AS filename, lower(regexp_extract(ext, '[^.]*$')) AS extension FROM f),
    e AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'empty' WHEN k % 13 = 0 AND extension IN ('jpg', 'jpeg', 'png', 'webp') THEN 'no picture' END AS error FROM n)
    SELECT 'photos' AS kind, branch, filename, extension, error FROM e WHERE extension IN ('jpg', 'jpeg', 'png', 'webp') AND mid <> '/skip/'
    UNION ALL SELECT 'pngs', branch, filename, extension, error FROM e WHERE extension = 'png' AND branch = 'building'
    UNION ALL SELECT 'raw', branch, filename, extension, error FROM e WHERE extension IN ('cr2', 'nef')""",
)
def scan(spark, d):
    """A tree with a file for each customer, some empty and some no pictures, read as a source: photos without excluded folders, by pushed filters, and raw files."""
    photo_source.register(spark)
    at = _folder(spark)
    k = F.col("c_custkey")
    ext = F.get(F.array(*map(F.lit, _EXTENSIONS)), (k % 8).cast("int"))
    middle = F.when(k % 9 == 0, "/skip/").when(k % 3 == 0, "/deep/er/").otherwise("/")
    name = F.concat(F.lower("c_mktsegment"), middle, F.lit("IMG_"), k.cast("string"), F.lit("."), ext)
    files = A.table(spark, d, "customer").select(name.alias("name"), F.when(k % 11 == 0, "empty").when(k % 13 == 0, "bad").otherwise(F.lower(F.regexp_extract(ext, "[^.]*$", 0))).alias("content"))

    _made_files(files, at, lambda content: b"" if content == "empty" else _HEADS.get(content, b"any content"))
    read = lambda **o: spark.read.format("photo_folder").options(path=at, **o).load()
    kind = lambda df, name: df.select(F.lit(name).alias("kind"), "branch", "filename", "extension", "error")
    pngs = read().where("extension = 'png' AND branch = 'building'")
    return kind(read(excluded="skip", branches="7"), "photos").unionByName(kind(pngs, "pngs")).unionByName(kind(read(extensions="cr2,NEF"), "raw"))


_KEYS = "SELECT vec_id AS idx, sha1('/v/' || vec_id || ':' || (vec_id * 7) || ':' || (vec_id % 1000) || ':openclip') AS key, embedding[1]::DOUBLE AS x, make_timestamp(1735689600000000 + (vec_id % 28) * 86400000000) AS made_at FROM embeddings"


def _keyed_vectors(spark, d):
    """Vectors by the digest of path, size, time and model, each made on one of 28 days."""
    n = F.col("vec_id")
    made = F.timestamp_micros(F.lit(1_735_689_600_000_000) + (n % 28) * 86_400_000_000)
    return A.table(spark, d, "embeddings").select(n.alias("idx"), S.cache_key(F.concat(F.lit("/v/"), n.cast("string")), n * 7, n % 1000, F.lit("openclip")).alias("key"), F.col("embedding").cast("array<float>").alias("value"), made.alias("made_at"))


@query(
    "q_keyed_cache",
    f"WITH v AS ({_KEYS}) SELECT idx, key, CASE WHEN idx % 5 > 0 AND (idx % 3 > 0 AND idx % 7 > 0 OR idx % 6 = 0) THEN 'cached' ELSE 'made' END AS origin, round(x, 5) AS x FROM v",
)
def keyed_cache(spark, d):
    """Vectors found by content in a cache of two puts, of which some are empty and some were made from another file, and the others made; then all are found."""
    v, at = _keyed_vectors(spark, d), _folder(spark)
    other = F.when(F.col("idx") % 5 > 0, F.col("key")).otherwise(F.sha1(F.concat("key", F.lit("old"))))
    broken = F.when(F.col("idx") % 7 > 0, F.col("value")).otherwise(F.array().cast("array<float>"))
    value_cache.put(v.where("idx % 3 > 0").withColumns({"key": other, "value": broken}), at)
    value_cache.put(v.where("idx % 6 = 0").withColumn("key", other), at)
    asked = v.select("idx", "key")
    hits, lacking = value_cache.lookup(asked, at)
    value_cache.put(lacking.join(v.drop("key"), "idx"), at)
    origins = hits.select("idx", F.lit("cached").alias("origin")).unionByName(lacking.select("idx", F.lit("made").alias("origin")))
    return value_cache.lookup(asked, at)[0].join(origins, "idx").select("idx", "key", "origin", F.round(F.get("value", F.lit(0)).cast("double"), 5).alias("x"))


@query(
    "q_cache_compacted",
    f"""WITH v AS ({_KEYS}), u AS (SELECT idx, key, x, greatest(made_at, CASE WHEN idx % 4 = 0 THEN make_timestamp(1735689600000000 + (20 + idx % 20) * 86400000000) END) AS last FROM v)
    SELECT idx, epoch_us(last)::BIGINT AS last_us, round(x, 5) AS x FROM u QUALIFY row_number() OVER (ORDER BY last DESC, key) <= (SELECT count(*) // 3 FROM v)""",
)
def cache_compacted(spark, d):
    """What is left of a cache once it's cut to a third by last use."""
    v, at, into = _keyed_vectors(spark, d), _folder(spark), _folder(spark)
    for n in range(2):
        value_cache.put(v.where(F.col("idx") % 2 == n), at)
    day = F.timestamp_micros(F.lit(1_735_689_600_000_000) + (20 + F.col("idx") % 20) * 86_400_000_000)
    value_cache.note_use(v.where("idx % 4 = 0"), at, day)
    value_cache.compacted(spark, at, into, v.count() // 3)
    hits, _ = value_cache.lookup(v.select("idx", "key"), into)
    return hits.join(value_cache.last_uses(spark, into), "key").select("idx", F.unix_micros("last").alias("last_us"), F.round(F.get("value", F.lit(0)).cast("double"), 5).alias("x"))


@query(
    "q_export_copies",
    """WITH c AS (SELECT c_custkey AS k, 'IMG_' || (c_custkey % 50) || '.jpg' AS filename, 'photo ' || c_custkey || repeat('x', (c_custkey % 7)::INT) AS content, c_custkey % 5 = 0 AS reject, c_custkey % 11 = 0 AS gone FROM customer),
    d AS (SELECT *, unnest(CASE WHEN reject THEN []::VARCHAR[] WHEN k % 3 = 0 THEN ['01_客户可选', '03_作品集候选'] WHEN k % 3 = 1 THEN ['01_客户可选'] ELSE ['02_精修候选'] END
      || CASE WHEN reject THEN []::VARCHAR[] ELSE ['10_按类型整理/未分类/未细分/' || CASE WHEN k % 2 = 0 THEN 'A_可交付' ELSE '未评级' END] END) AS folder FROM c),
    p AS (SELECT *, row_number() OVER (PARTITION BY folder, filename ORDER BY k) - 1 AS nth FROM d)
    SELECT k AS idx, 'exported' AS export_status, folder || '/' || CASE WHEN nth = 0 THEN filename ELSE replace(filename, '.jpg', '') || '_' || lpad(nth::VARCHAR, greatest(3, len(nth::VARCHAR))::INT, '0') || '.jpg' END AS target, content FROM p WHERE NOT gone
    UNION ALL SELECT k, CASE WHEN reject THEN 'skipped_no_export' ELSE 'failed' END, NULL, NULL FROM c WHERE reject OR gone""",
)
def export_copies(spark, d):
    """An original for each customer, some of them gone and some rejected, copied to the folders of uses and types under names of their own, and the copies read again."""
    source, base, k = _folder(spark), _folder(spark), F.col("c_custkey")
    name, content = F.concat(F.lit("c"), k.cast("string"), F.lit(".jpg")), F.concat(F.lit("photo "), k.cast("string"), F.expr("repeat('x', cast(c_custkey % 7 as int))"))
    c = A.table(spark, d, "customer")
    _made_files(c.where(k % 11 > 0).select(name.alias("name"), content.alias("content")), source, str.encode)
    uses = F.when(k % 3 == 0, F.array(F.lit("客户可选"), F.lit("作品集候选"))).when(k % 3 == 1, F.array(F.lit("客户可选"))).otherwise(F.array(F.lit("精修候选")))
    photos = c.select(
        k.alias("idx"), F.concat(F.lit(f"{source}/"), name).alias("path"), F.concat(F.lit("IMG_"), (k % 50).cast("string"), F.lit(".jpg")).alias("filename"), uses.alias("delivery_use"), F.lit("").alias("photo_type"), F.lit("").alias("subtype"),
        F.when(k % 5 == 0, "X").when(k % 2 == 0, "A").otherwise("").alias("quality_rating"), F.lit("").alias("similar_group_status"),
    )
    made = export.export(photos, base, "2026-01-01_0000", export.Options(csv=False, markdown=False))
    each = made.done.join(photos.select("idx", "path"), "path").select("idx", "export_status", F.explode_outer("exported_paths").alias("to"))
    return export.contents(written(each), "to").select("idx", "export_status", F.regexp_extract("to", "/files-[0-9a-f]+/(.*)$", 1).alias("target"), F.decode("content", "UTF-8").alias("content"))
