"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of labelled text. A text is parsed greedily
into phrases, each the longest match of what comes next in the language's text,
over word borders; the language that needs the fewest phrases a byte wins. Whole texts are
parsed, in pieces of ``PIECE`` bytes at whose ends phrases end too (for every
language alike), so that all pieces of a slice of texts walk all automata in
lockstep (numpy). A-Z are lower-cased, and runs of ASCII characters that are no
letters count as one space, since they tell nothing of a language.

The labelled text is a bounded sample, which is a parameter: of each language's different
rows about ``SAMPLE_DOCS`` are chosen by a hash of id and text, among those of up to
``TRAIN_BYTES`` bytes, and taken whole, in order of the hash, as long as they fit into ``TRAIN_BYTES``
together. (A language that has longer texts only is learnt from the first
``TRAIN_BYTES`` bytes of the shortest.) The model has about 60 bytes for each byte of it, and
languages are parsed ``AT_ONCE`` at a time. Automata are built in Spark's tasks, a group a language. Only ``lang`` and ``text`` of rows that aren't held out are
learnt; a prediction sees the text alone.

Defined results: null texts and texts without a letter are ``und`` with score 0,
as is everything if there is nothing to learn from; ties go to the first
language in order; a null id counts as not held out, and rows with null or equal ids are
chosen by their texts; repeated rows are learnt once and get equal results; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durable import written
from .vector import chunks, small_batches

SAMPLE_DOCS = 200
TRAIN_BYTES = 100_000

#: Bytes of a text that are parsed in one go.
PIECE = 512

#: Languages parsed in one go.
AT_ONCE = 8

#: A-Z to a-z; ASCII bytes that are no letters to spaces.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else (b if b >= 128 or 97 <= b <= 122 else 32) for b in range(256))

_ODD = np.uint64(0x9E3779B97F4A7C15)


def held_out(key: Column, of: int = 4, is_: int = 2) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % of == is_, F.lit(False))


def plain(text: bytes) -> bytes:
    """What is parsed of a text."""
    return b" ".join(text.translate(LETTERS).split())


def suffix_automaton(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """State, byte and next state of each arc of the smallest automaton of all substrings of text, and the number of states; 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(nxt)
        nxt.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    sizes = np.fromiter(map(len, nxt), np.int64, len(nxt))
    total = int(sizes.sum())
    symbol = np.fromiter((c for arcs in nxt for c in arcs), np.int64, total)
    to = np.fromiter((x for arcs in nxt for x in arcs.values()), np.int64, total)
    return np.repeat(np.arange(len(nxt)), sizes), symbol, to, len(nxt)


@dataclass
class Model:
    """Automata of languages. Arcs are in one table, each at one of two places that its state and byte name."""

    languages: list[str]
    roots: np.ndarray
    bits_a_phrase: np.ndarray  # what naming a place in a language's text takes
    keys: np.ndarray  # state * 256 + byte
    to: np.ndarray
    bits: int

    def places(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = key.astype(np.uint64) * _ODD
        return (h >> np.uint64(64 - self.bits)).astype(np.int64), ((h ^ (h >> np.uint64(29))) * _ODD >> np.uint64(64 - self.bits)).astype(np.int64)

    def next(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next state, or -1."""
        key = state * 256 + byte
        a, b = self.places(key)
        return np.where(self.keys[a] == key, self.to[a], np.where(self.keys[b] == key, self.to[b], -1))


def _table(languages: list[str], roots: list[int], sizes: list[int], key: np.ndarray, to: np.ndarray) -> Model:
    bits = max(4, int(np.ceil(np.log2(max(1, len(key)) * 2.5))))
    while True:
        model = Model(languages, np.array(roots, np.int64), np.log2(sizes), np.full(1 << bits, -1), np.zeros(1 << bits, np.int64), bits)
        first, second = model.places(key)
        held = np.full(1 << bits, -1)
        at, todo = first.copy(), np.arange(len(key))
        for _ in range(200):
            if not len(todo):
                break
            before = held[at[todo]]
            held[at[todo]] = todo  # the last one stays
            lost = todo[held[at[todo]] != todo]
            out = np.unique(before[before >= 0])
            todo = np.concatenate([lost, out[held[at[out]] != out]])
            at[todo] = np.where(at[todo] == first[todo], second[todo], first[todo])
        if not len(todo):
            used = np.flatnonzero(held >= 0)
            model.keys[used], model.to[used] = key[held[used]], to[held[used]]
            return model
        bits += 1


def language_text(texts: list[bytes], train_bytes: int = TRAIN_BYTES) -> bytes:
    """What is learnt of a language's sample: texts taken whole, as long as they fit into train_bytes; where none does, the beginning of the shortest."""
    taken, left, own = [], train_bytes, [plain(t) for t in texts]
    for t in own:
        if len(t) <= left:
            taken.append(t)
            left -= len(t) + 1
    return b" ".join(taken) if taken else min(own, key=len)[:train_bytes]


@dataclass
class Automaton:
    """One language: the arcs of its automaton, its number of states and the bytes of its text."""

    language: str
    state: np.ndarray
    byte: np.ndarray
    to: np.ndarray
    states: int
    size: int


def automaton(language: str, texts: list[bytes], train_bytes: int = TRAIN_BYTES) -> Automaton:
    text = b" " + language_text(texts, train_bytes) + b" "
    return Automaton(language, *suffix_automaton(text), len(text))


def assembled(automata: list[Automaton]) -> list[Model]:
    """The models of all languages in order, AT_ONCE in each."""
    automata, models = sorted(automata, key=lambda a: a.language), []
    for begin in range(0, len(automata), AT_ONCE):
        own = automata[begin : begin + AT_ONCE]
        roots = np.concatenate([[0], np.cumsum([a.states for a in own])[:-1]]).astype(np.int64)
        keys = np.concatenate([(a.state.astype(np.int64) + r) * 256 + a.byte for a, r in zip(own, roots)])
        to = np.concatenate([a.to.astype(np.int64) + r for a, r in zip(own, roots)])
        models.append(_table([a.language for a in own], roots.tolist(), [a.size for a in own], keys, to))
    return models


def train(samples: dict[str, list[bytes]], train_bytes: int = TRAIN_BYTES) -> list[Model]:
    """The models of languages whose texts are at hand; ``trained`` learns them from a table, in tasks."""
    return assembled([automaton(k, v, train_bytes) for k, v in samples.items()])


def phrase_counts(texts: list[bytes], model: Model) -> np.ndarray:
    """Phrases of a greedy parse of each plain text, as [text, language]."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    n = -(-lens // PIECE)
    of = np.repeat(np.arange(len(texts)), n)
    within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    data = np.frombuffer(b"".join(texts) + b" ", np.uint8).astype(np.int64)
    start = np.repeat(np.cumsum(lens) - lens, n) + within * PIECE
    size = np.minimum(PIECE, lens[of] - within * PIECE)
    order = np.argsort(-size, kind="stable")  # longest first
    at, left = start[order], size[order]
    k = len(model.roots)
    state = np.repeat(model.roots[None], len(order), axis=0)
    phrases = np.zeros((len(order), k), np.int64)
    for j in range(int(left[0]) if len(left) else 0):
        active = int(np.searchsorted(-left, -j, "left"))
        c = data[at[:active] + j][:, None]
        now = state[:active]
        to = model.next(now, c)
        fresh = (to < 0) | (now == model.roots)
        phrases[:active] += fresh
        if fresh.any():
            first = model.next(np.broadcast_to(model.roots, (active, k)), c)
            to = np.where(fresh, np.where(first < 0, model.roots, first), to)
        state[:active] = to
    out = np.zeros((len(texts), k), np.int64)
    np.add.at(out, of[order], phrases)
    return out


def predict_texts(texts: list[bytes | None], models: list[Model]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: 1 less the share of the best language's bits to the second's. A phrase takes log2 of the bytes of its language's text, so a language with little text isn't held back by its longer phrase list."""
    n = len(texts)
    languages = [x for m in models for x in m.languages]
    scores, best = np.zeros(n), np.zeros(n, np.int64)
    if languages:
        own = [plain(t or b"") for t in texts]
        per = np.concatenate([phrase_counts(own, m) * m.bits_a_phrase for m in models], axis=1)
        best = per.argmin(1)
        if len(languages) == 1:
            scores += 1
        else:
            two = np.partition(per, 1, axis=1)[:, :2]
            scores = np.where(two[:, 1] > 0, 1 - two[:, 0] / np.where(two[:, 1] > 0, two[:, 1], 1), 0)
    out = []
    for i, t in enumerate(texts):
        lettered = bool(languages) and t is not None and (len(t.translate(None, _LETTERS)) < len(t) or any(c.isalpha() for c in t.decode("utf-8", "replace")))
        out.append(languages[best[i]] if lettered else "und")
        if not lettered:
            scores[i] = 0
    return out, scores


_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))


def sampled(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, h and text of the bounded sample: about SAMPLE_DOCS whole texts of each language, chosen by a hash h of id and text; equal rows count once."""
    h = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text))
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), h.alias("h"), F.col(text).alias("text"))
    short = F.octet_length("text") <= TRAIN_BYTES
    sizes = {r["lang"]: r["n"] for r in labelled.select("lang", F.when(short, F.col("h")).alias("h")).distinct().groupBy("lang").agg(F.count("h").alias("n")).collect()}  # one row a language
    if not sizes:
        return labelled.limit(0)
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, SAMPLE_DOCS / max(1, v)))])
    chosen = written(labelled.where(short & ((F.col("h").cast("double") / 2.0**64 + 0.5) < share[F.col("lang")])).dropDuplicates(["lang", "h"]))
    without = sorted(set(sizes) - {r["lang"] for r in chosen.select("lang").distinct().collect()})
    if not without:
        return chosen
    least = F.min_by(F.substring("text", 1, TRAIN_BYTES), F.struct(F.octet_length("text"), "h"))
    return chosen.unionByName(labelled.where(F.col("lang").isin(without)).groupBy("lang").agg(F.min("h").alias("h"), least.alias("text")))


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, list[bytes]]:
    """The bounded sample as texts of each language, in order of the hash."""
    out: dict[str, list[bytes]] = {}
    for r in sorted(sampled(docs, key, text, lang).collect(), key=lambda r: (r["lang"], r["h"], r["text"])):
        out.setdefault(r["lang"], []).append(r["text"].encode())
    return out


def trained(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[Model]:
    """The models learnt from the sample of docs. Automata are built in tasks, a group a language (Spark may put small groups into one task); the driver only joins them, about 9 bytes an arc and 3 arcs a byte of TRAIN_BYTES."""
    train_bytes = TRAIN_BYTES

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "text"])
        a = automaton(rows["lang"].iloc[0], [t.encode() for t in rows["text"]], train_bytes)
        return pd.DataFrame({"lang": [a.language], "state": [a.state.astype("<i4").tobytes()], "byte": [a.byte.astype("u1").tobytes()], "to": [a.to.astype("<i4").tobytes()], "states": [a.states], "size": [a.size]})

    made = sampled(docs, key, text, lang).groupBy("lang").applyInPandas(learn, "lang string, state binary, byte binary, to binary, states long, size long")
    read = np.frombuffer
    return assembled([Automaton(r["lang"], read(r["state"], "<i4"), read(r["byte"], "u1"), read(r["to"], "<i4"), r["states"], r["size"]) for r in made.collect()])


def identify(docs: DataFrame, models: list[Model], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score of every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            names, scores = predict_texts(texts, held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores)], ["key", "lang_pred", "score"])

    rows = small_batches(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, trained(docs.where(~held_out(F.col("doc_id"))))).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
