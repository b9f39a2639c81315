"""Small documents with what large tables hold: nulls, blanks, long texts, copies, near copies, shared passages."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, bucket int, n int"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def texts(seed=5, n=60):
    rng = random.Random(seed)
    passage = words(rng, 35)
    out = [None, "", " \n\t ", "one", "one two", "one two three", "ÉTÉ été\x0bnoël  a b"]
    base = [words(rng, rng.randrange(3, 120)) for _ in range(n)]
    for i, b in enumerate(base):
        kind = i % 6
        if kind == 1:
            b = list(base[i - 1])
        elif kind == 2 and len(base[i - 2]) > 20:
            b = list(base[i - 2])
            b[rng.randrange(len(b))] = "edited"
        elif kind == 3:
            b = b[:10] + passage + b[10:]
        elif kind == 4:
            b = b + b[:25] + b
        base[i] = b
        out.append("".join(x + rng.choice([" ", " ", "\n", "  "]) for x in b))
    return [*out, "same " * 500, " ".join(words(rng, 6000))]


def rows(seed=5, n=60):
    own = [(i * 3 + 1, t, "en", f"s{i % 3}", 0 if t is None else len(t), "clash", i, i) for i, t in enumerate(texts(seed, n))]
    return [*own, own[12], own[20], (None, own[9][1], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


def frame(spark, data=None, parts=5):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(parts)


def plain_words(t):
    return (t or "").encode().split()
