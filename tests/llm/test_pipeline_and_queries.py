"""The registered queries against their SQL, and the pipeline against the stages done plainly."""

from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from lumensift.functions.durable import shared_folder
from lumensift.llm import queries

from ..conftest import same_rows
from .fixtures import SCHEMA, plain_words, rows
from .test_documents import _alnum, _components, _contamination, _measures

TINY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, TINY), queries.SQL[name], TINY)


def _plain_pipeline(docs, items):
    def good(t):
        n, chars, symbols, dup, repeats = _measures(t)
        lines = sum(bool(plain_words(x)) for x in (t or "").split("\n"))
        return n >= 50 and 100 * repeats <= 50 * n and 10 * symbols <= n and 10 * dup <= 4 * lines and 10 * sum("A" <= c <= "Z" for c in t) <= 4 * chars and 2 * t.count("!") <= n and chars <= 20 * n

    kept = [d for d in docs if good(d[1])]
    roots = {i: root for i, _, root in _components(kept, 5, 8, 10)}
    kept = [d for d in kept if roots[d[0]] == d[0]]
    first = {}
    for i, t, *_ in sorted(kept):
        w = plain_words(t)
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (i, s))
    cut = []
    for i, t, *_ in kept:
        w = plain_words(t)
        gone = {j for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] != (i, s) for j in range(s, s + 20)}
        cut.append((i, " ".join(x.decode() for j, x in enumerate(w) if j not in gone)))
    bad = {r[0] for r in _contamination(cut, items) if r[5]}
    return Counter({i: len(plain_words(t)) for i, t in cut if i not in bad and plain_words(t)})


def test_pipeline(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
    got = Counter()
    shared = Path(shared_folder(spark).removeprefix("file://"))
    before = set(shared.iterdir())
    made = corpus_pipeline.run(spark, TINY).collect()
    assert len(set(shared.iterdir()) - before) == 1  # the result alone stays
    for r in made:
        got[r["doc_id"]] += r["n_tokens"]
    assert got == _plain_pipeline(docs, items)
    fill = Counter()
    for r in made:
        fill[r["shard"], r["bin"]] += r["n_tokens"]
    assert max(fill.values()) <= 2048


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, TINY).columns == docs.columns, name
    assert _alnum("A b") == ["a", "b"]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, stage):
    """Nulls in every column, repeated rows, shared ids and clashing names; then an empty table."""
    schema = SCHEMA.replace("key string", "`measure:n_words` string").replace("bucket int", "`jaccard:key` int")
    data = [*rows(), *rows()[10:14], (None, None, None, None, None, None, None, None), (7, "other text of an id that is taken " * 12, None, None, None, None, None, None)]
    out = stage(spark, spark.createDataFrame(data, schema).repartition(3), TINY)
    assert out.count() > 0 and (stage is corpus_pipeline.packed_bins or out.columns == spark.createDataFrame([], schema).columns)
    assert stage(spark, spark.createDataFrame([], schema), TINY).count() == 0
