"""Byte-level BPE against the tokenizer library, clustering and the filter audit against plain versions, on odd rows and empty tables."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from lumensift.llm import audit, bpe, clusters

from .fixtures import SCHEMA, frame, rows, texts

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(PATH)


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={}).encode_ordinary


# -- byte-level BPE

BITS = ["a", "b", "the", "ing", " ", "  ", "\n", "'", "'s", "'re", "'ll", "l", "1", "23", "!", "??", "é", "日本", "語", " ", "😀", "Ω", "_", "\t", "<|endoftext|>", "é"]


@pytest.mark.parametrize("leaves", [(1, 1), (2, 2), (3, 1), (5, 3), (16, 8), (4096, 32)])
def test_halves_join_to_the_whole(vocabulary, library, leaves):
    rng, encoder = random.Random(1), bpe.Encoder(vocabulary, P.PATTERN)
    encoder.pieces.leaf, encoder.merges.leaf = leaves
    for _ in range(800):
        t = "".join(rng.choice(BITS) for _ in range(rng.choice((3, 10, 60))))
        t = t.replace(" ", "") if rng.random() < 0.3 else t
        assert encoder.ids(t).tolist() == library(t), t


@pytest.mark.parametrize("t", ["a" * 20_001, "ab" * 5_000 + "c" * 3_333, " " * 9_001 + "x", "é" * 5_000, "\n" * 5000, "'" * 5000 + "s", "1" * 9999], ids=lambda t: repr(t[:4]))
def test_long_pieces(vocabulary, library, t):
    assert bpe.Encoder(vocabulary, P.PATTERN).ids(t).tolist() == library(t)


def test_neighbours_are_merged_again_as_far_as_needed(vocabulary):
    merges, rng = bpe.Merges(vocabulary), random.Random(2)
    for _ in range(500):
        b = "".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 60))).encode()
        cut = rng.randrange(1, len(b))
        assert merges.joined(merges.merged(b[:cut]), merges.merged(b[cut:])) == merges.merged(b)


def test_one_at_a_time_or_together(vocabulary):
    merges, rng = bpe.Merges(vocabulary), random.Random(3)
    pieces = [bytes(rng.choice(b"aeinrst \xc3\xa9") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    flat, sizes = merges.merged_together(pieces)
    assert [flat[e - n : e].tolist() for n, e in zip(sizes, sizes.cumsum())] == [merges.merged(p) for p in pieces]


def _sha(x):
    return hashlib.sha256(x).hexdigest()


def test_rows_are_encoded_and_decoded(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 2000)  # begins anew again and again
    odd = [(9000 + i, t, None, None, None, "k", i, i) for i, t in enumerate(["<|endoftext|>", "é \U0001f600\U0001f600", "don't WE'LL", "x" * 100_000])]
    data = [*rows(), *odd]
    docs = frame(spark, data).withColumnRenamed("key", "made").withColumnRenamed("bucket", "c1")
    encoded = bpe.encode(docs, PATH, P.PATTERN, digests=True)
    assert encoded.columns == [*(c for c in docs.columns if c != "text"), "n_tokens", "ids_sha256", "ids"]
    out = bpe.decode(encoded, PATH).select("doc_id", "n", "made", "n_tokens", "ids_sha256", "decoded")
    want = Counter()
    for r in data:
        ids = library(r[1] or "")
        want[r[0], r[7], r[5], len(ids), _sha(",".join(map(str, ids)).encode()), (r[1] or "").encode()] += 1
    assert Counter((*r[:5], bytes(r[5])) for r in out.collect()) == want
    assert bpe.decode(bpe.encode(spark.createDataFrame([], SCHEMA), PATH, P.PATTERN), PATH).count() == 0


def test_ids_of_any_length(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "LEAF_IDS", 3)
    import numpy as np

    ids = np.array([262, 11, 50, 7, 9, 1000, 40000], np.int32)
    assert bpe.ids_digest(ids) == _sha(b"262,11,50,7,9,1000,40000") and bpe.ids_digest(ids[:0]) == _sha(b"")
    back = {r: t for t, r in vocabulary.ranks.items()}
    assert bpe.Decoder(vocabulary.ranks).decoded(ids) == b"".join(back[i] for i in ids.tolist())


def test_bytes_that_are_no_utf8(spark, library):
    rows_ = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF62') AS string) AS text")
    assert bpe.encode(rows_, PATH, P.PATTERN).first()["ids"] == library("a�b")


# -- clustering


def _plain_lloyd(data, clusters_=8, rounds=10):
    import math

    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in data if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted(kept, key=lambda r: (_sha(f"3:{'' if r[0] is None else r[0]}".encode()), b"".join(x.to_bytes(4, "little", signed=True) for x in r[1])))[:clusters_]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), k in zip(kept, at) if k == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *near(v)) for i, v in kept]
    total = Counter()
    for _, d, j in last:
        total[j] += d
    return Counter((i, j, d, total[j], sum(total.values()), _sha(",".join(map(str, c[j])).encode())) for i, d, j in last)


def _vectors(n, seed=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(11)]
    return [(i, [float(x + rng.gauss(0, 0.3)) for x in rng.choice(centres)]) for i in range(n)]


ODD = [(None, [0.25] * 64), (500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 65), (504, [float("nan")] + [1.0] * 63), (505, [1.0] * 63 + [float("-inf")]), (506, [None] + [1.0] * 63), (507, [-0.0001] * 64)]


@pytest.mark.parametrize("data", [_vectors(240) + ODD + _vectors(240)[3:9] + [(600 + i, [0.5] * 64) for i in range(150)], _vectors(5), [(i, [1.0] * 64) for i in range(20)], []], ids=["many", "few", "equal", "none"])
def test_clusters(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(clusters, "ROWS", 7)
    spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash")).repartition(4).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = clusters.op12_centroid_clustering(spark, str(tmp_path))
    assert Counter(tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in out.collect()) == _plain_lloyd(data)


def test_far_components_are_cut(spark):
    x = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)], "vec_id long, embedding array<double>")
    out, _ = clusters.cluster(x, clusters=1, rounds=1)
    assert {r["vec_id"] for r in out.collect()} == {1, 2, 3} and max(r["distance"] for r in out.collect()) < 1 << 62


# -- filter audit


def _plain_audit(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    place = lambda i: float("inf") if i is None else i
    first = {}
    for i, t, _ in docs:
        first[t or ""] = min(first.get(t or "", float("inf")), place(i))
    out = {}
    for i, t, part in docs:
        t, part = t or "", part or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {x for x, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), place(i) > first[t])) if bad}
        for order in permutations("ABCDE"):
            at = next((s for s, x in enumerate(order, 1) if x in fails), 6)
            for s, x in enumerate(order, 1):
                r = out.setdefault((part, "".join(order), s), [0] * 6)
                for k, hit in enumerate((at > s, at == s, x in fails and at < s, fails == {x}, at == s and i in good, at == s and i in toxic)):
                    r[k] += hit
    shapley = Counter()
    for (part, order, s), r in out.items():
        shapley[part, order[s - 1]] += r[1]
    return {k: (*r, shapley[k[0], k[1][k[2] - 1]]) for k, r in out.items()}


def _audited(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("part", F.lit("clash")).withColumn("mask", F.lit(1)).repartition(5)
    out = audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in out}) == len(out)
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in audit.SUMS) for r in out}


def test_audit(spark):
    rng = random.Random(9)
    made = [t for t in texts(7, 40)] + ["LOUD WORDS " * 60, "a # b " * 70, " ".join(f"x{i}" for i in range(150)), " ".join(f"x{i}" for i in range(150)) + " $"]
    docs = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(made)]
    docs += [(100 + i, rng.choice(made), rng.choice(["en", "fr"])) for i in range(60)]
    docs += [docs[12], docs[12], docs[20], (None, made[9], None), (None, "own text", "en"), (None, "own text", "en"), (None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    assert _audited(spark, docs, labels) == _plain_audit(docs, labels)


def test_audit_of_a_large_group(spark):
    docs = [(i, "copy of one text", "en" if i % 3 else None) for i in range(3000)] + [(5, "copy of one text", "de")] * 2
    assert _audited(spark, docs, [(i, 1, i % 2) for i in range(0, 3000, 7)]) == _plain_audit(docs, [(i, 1, i % 2) for i in range(0, 3000, 7)])


def test_audit_of_nothing(spark):
    assert _audited(spark, [], []) == {}
    assert set(_audited(spark, [(1, None, None)], [])) == {("", "".join(o), s) for o in permutations("ABCDE") for s in range(1, 6)}
