"""Document operators against brute force, on rows with nulls, blanks, copies and clashing columns, and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lumensift.llm import decontaminate, jaccard, langid, licenses, lm, packing, quality, substring

from .fixtures import SCHEMA, frame, plain_words, rows, texts

BENCH = "item_id long, text string"


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, *columns):
    """Rows as a bag, since ids repeat and may be null."""
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# -- quality rules


def _measures(t):
    w = plain_words(t)
    t = t or ""
    lines = [x for x in t.split("\n") if plain_words(x)]
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality_measures(spark):
    got = by_row(quality.ledger(frame(spark)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == Counter((r[0], *_measures(r[1])) for r in rows())
    assert quality.ledger(empty(spark)).count() == 0


def test_policies_and_ablation(spark):
    entries = quality.ledger(frame(spark))
    kept = quality.apply_policy(entries, "base").where("kept").count()
    bad = [m for m in (_measures(r[1]) for r in rows()) if m[0] < 50 or 100 * m[4] > 50 * m[0]]
    assert kept == len(rows()) - len(bad)
    counts = {r["rule"]: r for r in quality.ablation(entries, "base").collect()}
    assert counts["too_short"]["n_failed"] == sum(_measures(r[1])[0] < 50 for r in rows()) and counts["too_short"]["n_kept"] == kept


def test_filter_keeps_rows_whole(spark):
    out = quality.filter_documents(frame(spark), "base")
    assert out.columns == frame(spark).columns
    good = [r for r in rows() if (m := _measures(r[1]))[0] >= 50 and 100 * m[4] <= 50 * m[0]]
    assert Counter(tuple(r) for r in out.collect()) == Counter(good)


def test_ledger_beside_its_rows(spark):
    docs = frame(spark).withColumnRenamed("bucket", "ledger").withColumnRenamed("n", "n_words")
    entries, name = quality.judged(docs)
    assert name == "ledger_" and entries.columns == [*docs.columns, name]
    flat = entries.select("doc_id", f"{name}.*")
    assert Counter(map(tuple, flat.collect())) == Counter(map(tuple, quality.ledger(frame(spark)).collect()))
    by_policy = {v: quality.filter_documents(docs, v).count() for v in quality.POLICIES}
    assert by_policy == {v: quality.apply_policy(flat, v).where("kept").count() for v in quality.POLICIES}


# -- substring dedup


def _kept(data, k):
    first = {}
    for i, t, *_ in data:
        w = plain_words(t)
        key = substring.NO_ID if i is None else i
        for s in range(len(w) - k + 1):
            at = tuple(w[s : s + k])
            first[at] = min(first.get(at, (key, s)), (key, s))
    out = []
    for i, t, *_ in data:
        w, key = plain_words(t), substring.NO_ID if i is None else i
        gone = {j for s in range(len(w) - k + 1) if first[tuple(w[s : s + k])] != (key, s) for j in range(s, s + k)}
        # rows of one id share what is removed
        out.append((i, w, gone))
    shared = defaultdict(set)
    for i, _, gone in out:
        shared[i] |= gone
    return [(i, len(w), sum(j in shared[i] for j in range(len(w))), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in shared[i])).hexdigest()) for i, w, _ in out]


@pytest.mark.parametrize("k", [20, 8])
def test_substrings(spark, k):
    data = [r for r in rows() if r[0] is not None]
    got = by_row(substring.digest(frame(spark, data), k=k), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == Counter(_kept(data, k)) and sum(n for _, _, n, _ in got) > 0
    assert substring.digest(empty(spark)).count() == 0


@pytest.mark.parametrize("levels", [1, 4])
def test_hot_buckets_are_dealt_again(spark, monkeypatch, levels):
    """Few words, so few minimisers: every bucket is above the limit, and what is dealt again gives the same rows."""
    import random

    rng = random.Random(levels)
    own = lambda n: [f"w{rng.randrange(4)}" for _ in range(n)]
    shared = own(70)
    data = [(i, " ".join(own(rng.randrange(10, 60)) + (shared if i % 3 else shared[10:40]) + own(30)), "en", "s", 0, "k", 0, 0) for i in range(60)]
    monkeypatch.setattr(substring, "HOT_BYTES", 200)
    monkeypatch.setattr(substring, "LEVELS", levels)
    blocks = []
    found = substring._found
    monkeypatch.setattr(substring, "_found", lambda b, k, m, level: blocks.append(level) or found(b, k, m, level))
    got = by_row(substring.digest(frame(spark, data)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == Counter(_kept(data, 20)) and max(blocks) == levels + 1


def test_window_hashes_over_bytes():
    import numpy as np

    from lumensift.llm.vector import words_of

    w = words_of([b"a b c d e a b c", b"", b"b c d x a b c"])
    first = np.array([0, 1, 5, 8, 12])
    got = substring.byte_hashes(w, first, np.array([2, 3, 7, 10, 14]))
    assert got[0] == got[2] == got[4] and got[1] == got[3] != got[0]


def test_substrings_with_null_ids(spark):
    assert substring.digest(frame(spark)).count() == len(rows())


def _shared_ids():
    import random

    rng = random.Random(8)
    own = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    a, b, c = own(60), own(45), own(30)
    lists = [(None, a), (None, own(200)), (None, a[:40] + own(50)), (None, a[:40] + own(20)), (None, own(9) + b), (7, b), (7, own(80)), (7, c + own(10)), (7, c), (9, own(5) + c), (None, own(120)), (None, [])]
    return [(i, " ".join(x) or None, "en", "s", 0, "k", 0, 0) for i, x in lists]


def test_rows_that_share_an_id_lose_only_their_own_repeats(spark):
    data = _shared_ids()
    tags = {r["text"]: r["tag"] for r in frame(spark, data).select("text", F.xxhash64("text").alias("tag")).collect()}
    name = lambda r: (substring.NO_ID if r[0] is None else r[0], tags[r[1]])
    first = {}
    for r in data:
        w = plain_words(r[1])
        for s in range(len(w) - 19):
            at = tuple(w[s : s + 20])
            first[at] = min(first.get(at, (*name(r), s)), (*name(r), s))
    want = Counter()
    for r in data:
        w = plain_words(r[1])
        gone = {j for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] != (*name(r), s) for j in range(s, s + 20)}
        want[r[0], len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()] += 1
    assert by_row(substring.digest(frame(spark, data)), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert sum(n for i, _, n, _ in want if i is None) == 40 + 40 + 45 and sum(n for i, _, n, _ in want if i is not None) == 30 + 30
    cut = Counter((r["doc_id"], hashlib.sha256(b" ".join(plain_words(r["text"]))).hexdigest()) for r in substring.dedup_documents(frame(spark, data)).collect())
    assert cut == Counter((i, h) for i, _, _, h in want.elements())


def test_spans_of_repeated_rows_are_one_list(spark):
    t = " ".join(f"w{i}" for i in range(60))
    docs = frame(spark, [(1, t, "en", "s", 0, "k", 0, 0)] + [(2, t, "en", "s", 0, "k", 0, 0)] * 600)
    marked = substring._with_spans(docs.select("doc_id", "text"), "doc_id", "text", 20, substring.M)
    assert max(len(r["substring:starts"] or []) for r in marked.collect()) < 12  # super-k-mers of one text
    assert by_row(substring.digest(docs), "doc_id", "n_removed") == Counter({(1, 0): 1, (2, 60): 600})


def test_substring_documents(spark):
    data = [r for r in rows() if r[0] is not None]
    out = substring.dedup_documents(frame(spark, data), length="n_chars")
    assert out.columns == frame(spark).columns
    want = {(i, h) for i, _, _, h in _kept(data, 20)}
    for r in out.collect():
        assert (r["doc_id"], hashlib.sha256(b" ".join(plain_words(r["text"]))).hexdigest()) in want
        assert r["text"] is None or r["n_chars"] == len(r["text"])


# -- near duplicates


def _sets(t, n):
    w = plain_words(t.translate({i: i + 32 for i in range(65, 91)}) if t else t)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def _components(data, n, num, den):
    """Rows as a bag of (id, set size, least id reachable); a null id comes after all others."""
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [_sets(r[1], n) for r in data]
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(data):
        key = jaccard.NO_ID if r[0] is None else r[0]
        least[find(i)] = min(least.get(find(i), key), key)
    back = lambda i: None if i == jaccard.NO_ID else i
    return Counter((r[0], len(sets[i]), back(least[find(i)])) for i, r in enumerate(data))


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 8, 10)])
@pytest.mark.parametrize("seed", [5, 6])
def test_near_duplicates(spark, n, num, den, seed):
    from fractions import Fraction

    data = rows(seed, 90)
    got = by_row(jaccard.near_duplicates(frame(spark, data), n=n, threshold=Fraction(num, den)), "doc_id", "n_shingles", "component_id")
    assert got == _components(data, n, num, den)


def _near_copies(groups, size, length, edits, rng):
    data = []
    for g in range(groups):
        base = [f"b{g}x{i}" for i in range(length)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(edits)):
                own[rng.randrange(length)] = f"e{rng.randrange(60)}"
            data.append((len(data), " ".join(own), "en", "s", 0, "k", 0, 0))
    return data


@pytest.mark.parametrize("groups,size,limit", [(1, 160, 1 << 19), (1, 160, 256 * 20), (12, 30, 256 * 40), (3, 40, 256)])
def test_large_groups_of_near_copies(spark, monkeypatch, groups, size, limit):
    import random

    data = _near_copies(groups, size, 90, 6, random.Random(3))
    monkeypatch.setattr(jaccard, "LIMIT", limit)
    got = by_row(jaccard.near_duplicates(frame(spark, data)), "doc_id", "n_shingles", "component_id")
    want = _components(data, 3, 90, 100)
    assert got == want and len({c for _, _, c in want}) > 5


def test_cells_are_split_by_distance_without_losing_a_link(spark, monkeypatch):
    """One cell of many groups: the pivots' windows separate the groups, and every linked pair shares a cell within the limit."""
    import random
    from fractions import Fraction

    t = Fraction(90, 100)
    data = _near_copies(20, 12, 90, 4, random.Random(5))
    profiles = jaccard._profiles(jaccard._plain(frame(spark, data), "doc_id", "text"), 3).dropDuplicates(["key"])
    sketches = profiles.select("key", F.col("n_shingles").alias("n"), "sketch").persist()
    monkeypatch.setattr(jaccard, "LIMIT", 256 * 60)
    cells = sketches.select(F.lit(7).cast("long").alias("cell"), "key", "n")
    got = jaccard._bounded(cells, sketches, t).collect()
    size = Counter(r["cell"] for r in got)
    assert max(size.values()) <= 60 and len(got) < 3 * sketches.count()
    member = defaultdict(set)
    for r in got:
        member[r["key"]].add(r["cell"])
    keys = {r["id"]: r["key"] for r in profiles.select("id", "key").collect()}
    sets = {keys[i]: _sets(x, 3) for i, x, *_ in data if i in keys}
    linked = [(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b])]
    assert len(linked) > 20 and all(member[a] & member[b] for a, b in linked)


def test_links_of_a_group_grow_with_its_members(spark):
    import random
    from fractions import Fraction

    counts = []
    for size in (60, 240):
        plain = jaccard._plain(frame(spark, _near_copies(1, size, 200, 3, random.Random(1))), "doc_id", "text")
        profiles = jaccard._profiles(plain, 3).dropDuplicates(["key"])
        sketches = profiles.select("key", F.col("n_shingles").alias("n"), "sketch")
        cells = sketches.select(F.lit(1).cast("long").alias("cell"), "key")
        links = jaccard._links(jaccard._alive(cells, sketches, Fraction(9, 10)), jaccard._sets(plain, sketches.select("key"), 3), Fraction(9, 10)).count()
        assert 0 < links < sketches.count()
        counts.append(links / sketches.count())
    assert counts[1] <= 1.2 * counts[0]


@pytest.mark.parametrize("rows_,members", [(100_000, 2), (0, 2), (1, 10)])
def test_large_components_are_named_by_broadcast_or_shuffle(spark, monkeypatch, rows_, members):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", rows_)
    monkeypatch.setattr(jaccard, "LARGE_KEY", members)
    got = by_row(jaccard.near_duplicates(frame(spark)), "doc_id", "n_shingles", "component_id")
    assert got == _components(rows(), 3, 90, 100)


def test_distinct_documents(spark):
    out = jaccard.distinct_documents(frame(spark))
    assert out.columns == frame(spark).columns
    stays = {i for i, _, root in _components(rows(), 5, 8, 10) if i == root}
    assert {r["doc_id"] for r in out.collect()} == stays
    assert jaccard.near_duplicates(empty(spark)).count() == 0


def test_one_row_of_each_component(spark):
    a, b, c, d = ([f"{x}{i}" for i in range(40)] for x in "abcd")
    lists = [(None, a), (None, a), (None, a), (None, [*a[:39], "edited"]), (None, b), (7, b), (None, b), (3, c), (3, c), (3, d), (5, c), (None, []), (None, [])]
    data = [(i, " ".join(x) or None, "en", f"s{n}", 0, "k", n, n) for n, (i, x) in enumerate(lists)]
    out = jaccard.distinct_documents(frame(spark, data)).collect()
    assert len(out) == 6 and sum(r["text"] is None for r in out) == 2
    assert Counter((r["doc_id"], r["text"][0]) for r in out if r["text"]) == {(None, "a"): 1, (7, "b"): 1, (3, "c"): 1, (3, "d"): 1}
    assert all(tuple(r) in data for r in out)
    assert {r["n"] for r in out if r["doc_id"] == 3} == {7, 9}


# -- decontamination


def _alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))


def _contamination(data, items):
    grams = defaultdict(set)
    for i, t in items:
        w = _alnum(t)
        for s in range(max(1, len(w) - 12)) if w else ():
            grams[tuple(w[s : s + 13])].add(str(i))
    sizes = {len(g) for g in grams}
    out = []
    for i, t, *_ in data:
        w, hit, found = _alnum(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in grams:
                    hit |= set(range(s, s + n))
                    found |= grams[tuple(w[s : s + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


def _items():
    t = texts()
    w = _alnum(t[30])
    return [(1, " ".join(w[3:40]).upper()), (2, " ".join(w[3:40])), (10, " ".join(_alnum(t[17])[5:18])), (3, "one two"), (4, None), (5, "  "), (9, " ".join(_alnum(t[25])[:14]) + " not there")]


def test_contamination(spark):
    bench = spark.createDataFrame(_items(), BENCH)
    got = by_row(decontaminate.score(frame(spark), bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = _contamination(rows(), _items())
    assert got == want and sum(c for r, c in want.items() if r[5]) > 3
    assert decontaminate.score(empty(spark), bench).count() == 0
    nothing = decontaminate.score(frame(spark), spark.createDataFrame([], BENCH))
    assert nothing.where("n_hit > 0").count() == 0 and nothing.count() == len(rows())


@pytest.mark.parametrize("limit", ["BROADCAST_NGRAMS", "BROADCAST_BYTES"])
def test_a_large_set_is_joined_by_shuffle(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, limit, 1)
    test_contamination(spark)


def test_drop_and_remove(spark):
    bench = spark.createDataFrame(_items(), BENCH)
    out = decontaminate.drop_contaminated(frame(spark), bench)
    assert out.columns == frame(spark).columns
    want = Counter(r[0] for r in rows()) - Counter(i for (i, *_, bad), c in _contamination(rows(), _items()).items() for _ in range(c) if bad)
    assert Counter(r["doc_id"] for r in out.collect()) == want
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().toString())
    clean = decontaminate.remove_spans(frame(spark), bench)
    cut = {r[0]: r[1] - r[2] for r in _contamination(rows(), _items()) if r[2]}
    assert all(len(_alnum(r["text"])) == cut[r["doc_id"]] for r in clean.collect() if r["doc_id"] in cut)


def test_decontamination_is_native(spark):
    plan = decontaminate.score(frame(spark), spark.createDataFrame(_items(), BENCH))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# -- licenses


def test_licenses(spark):
    cases = ["x released under the MIT License.\nnext", "Under The MIT license cc BY nc cc by nc", "Licensed under the Apache License, Version 2.0.", "the license of mit", None, "", "apache license version 20"]
    cases += ["Permission is granted, free of charge, to any person obtaining a copy of the software and associated documentation files"]
    data = [(i, t, "en", "s", 0, "k", 0, 0) for i, t in enumerate(cases)]
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, data)).collect()}
    assert [got[i]["base_labels"] for i in range(8)] == ["mit", "cc-by-nc,mit", "apache-2", "", "", "", "", ""]
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (3, 0, 7) and got[3]["first_word"] is None
    assert got[7]["labels"] == "mit" and 0.8 <= got[7]["score"] < 1 and got[3]["score"] == 0
    assert licenses.scan(empty(spark)).count() == 0


def _plain_blocks(t):
    """Every block against every template, without filters."""
    w = licenses.tokens((t or "").encode())
    for n, ((notice, *_), (words, _, needs, bars)) in enumerate(zip(licenses.TEMPLATES, licenses._template_sets())):
        width = math.ceil(len(licenses.tokens(notice.encode())) / 0.8)
        need = len(words) if len(words) < 10 else math.ceil(0.8 * len(words) - 1e-9)
        for i, x in enumerate(w):
            own = set(w[i : i + width])
            if x in words and len(own & words) >= need and needs <= own and not bars & own and not (licenses.NEGATIONS - words) & (own | set(w[max(0, i - 2) : i])):
                yield i, n


def test_license_join_equals_plain_comparison(spark):
    import random

    rng = random.Random(2)
    cases = []
    for text, *_ in licenses.TEMPLATES:
        w = text.split()
        for _ in range(14):
            own = list(w) if rng.random() < 0.5 else rng.sample(w, len(w))
            for _ in range(rng.randrange(4)):
                own.insert(rng.randrange(len(own) + 1), rng.choice(["extra", "not", "nc", "lesser", "the", "\n", "//"]))
            cases.append(" ".join(own[: len(own) - rng.randrange(3)]))
    joined = ["\n".join(cases[i : i + 5]) for i in range(0, len(cases), 5)]
    docs = frame(spark, [(i, t, "en", "s", 0, "k", 0, 0) for i, t in enumerate([*joined, *cases, None, ""])])
    got = Counter((r["doc_id"], r["first_word"], r["template"]) for r in licenses.block_matches(docs).collect())
    assert got == Counter((i, *b) for i, t in enumerate([*joined, *cases]) for b in _plain_blocks(t)) and len(got) > 100


def test_a_notice_gets_the_label_of_its_own_license_only(spark):
    import textwrap

    cases = [(t, label) for t, label, *_ in licenses.TEMPLATES]
    cases += [("Licensed under the Apache License, Version 2.0.", "apache-2"), ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"), ("This work is licensed under CC BY 4.0.", "cc-by")]
    cases += [("licensed under the GNU Lesser General Public License, version 3", "lgpl"), ("Licensed under CC BY-SA 4.0.", "cc-by-sa"), ("It is released under the BSD license.", "bsd"), ("released under the license", "")]
    cases += [("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation", "")]
    cases += [("BSD-3-Clause", "bsd"), ("SPDX-License-Identifier: MIT", "mit"), ("CC BY 4.0", "cc-by"), ("GNU General Public License version 2 or later", "gpl-2")]
    cases += [("\n".join(textwrap.wrap(t, 34)), label) for t, label in cases]
    data = [(i, "Some prose.\n\n" + text + "\n\nmore", "en", "s", 0, "k", 0, 0) for i, (text, _) in enumerate(cases)]
    got = {r["doc_id"]: (r["labels"], r["base_labels"]) for r in licenses.scan(frame(spark, data)).collect()}
    for i, (text, label) in enumerate(cases):
        own = got[i][0].split(",")
        assert [x for x in own if x not in got[i][1].split(",")] in ([label], []) and label in own, text


def test_prose_is_no_notice(spark):
    import random

    rng = random.Random(1)
    long = [f"w{rng.randrange(900)}" for _ in range(5000)]
    for at, w in zip((10, 900, 2500, 3900, 4800), ("license", "mit", "under", "licensed", "the")):
        long[at] = w
    cases = ["Der Hund kommt mit dem Ball. The license was under review by the licensed driver.", " ".join(long), "\n".join(long), "A clause of 3 pages, said the BSD user, and by 4 or 0 votes", "the general public needs no license for version 2"]
    denied = ["This repo is not licensed under the MIT License.", "This was never released under the MIT license", "It isn't under the BSD License"]
    docs = frame(spark, [(i, t, "en", "s", 0, "k", 0, 0) for i, t in enumerate([*cases, *denied])])
    assert licenses.block_matches(docs).count() == 0
    got = {r["doc_id"]: (r["labels"], r["base_labels"]) for r in licenses.scan(docs).collect()}
    assert all(got[i] == ("", "") for i in range(len(cases))) and got[len(cases)] == ("mit", "mit")  # the base phrase stays


def test_the_same_words_match_on_one_line_and_over_many(spark):
    import textwrap

    long = [(t, label) for t, label, *_ in licenses.TEMPLATES if len(t.split()) > 12]
    cases = [(x, label) for t, label in long for x in [t, *("\n".join(textwrap.wrap(t, width, initial_indent=start, subsequent_indent=start)) for width, start in ((40, ""), (60, " * "), (72, "# ")))]]
    data = [(i, "Some prose.\n\n" + text + "\nmore words", "en", "s", 0, "k", 0, 0) for i, (text, _) in enumerate(cases)]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(frame(spark, data)).collect()}
    for i, (text, label) in enumerate(cases):
        assert label in got[i][0].split(",") and got[i] == got[i - i % 4], text
    t = long[0][0].split()
    apart = licenses.scan(frame(spark, [(1, " ".join(t[:9]) + "\n" + "other words " * 20 + "\n" + " ".join(t[9:]), "en", "s", 0, "k", 0, 0)]))
    assert apart.first()["labels"] == ""


# -- language


def test_languages(spark):
    en, fr = "the this that with thing other then there think", "le la les dans leur que quoi quand avec"
    import random

    rng = random.Random(4)
    data = [(i, " ".join(rng.choices((en if i % 2 else fr).split(), k=30)), "en" if i % 2 else "fr", "s", 0, "k", 0, 0) for i in range(80)]
    model = langid.train(langid.sample(frame(spark, data).where(~langid.held_out(F.col("doc_id")))))
    out = {r["doc_id"]: r for r in langid.identify(frame(spark, data), model).collect()}
    assert all(out[r[0]]["lang_pred"] == r[2] and 0 < out[r[0]]["score"] <= 1 for r in data)
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.identify(frame(spark, [(1, None, *[None] * 6), (2, "12 !", *[None] * 6), (3, "ß", *[None] * 6), (None, "the", *[None] * 6)]), model).collect()}
    assert odd[1] == odd[2] == "und" and odd[3] in ("en", "fr") and odd[None] == "en"
    none = langid.train(langid.sample(empty(spark)))
    assert {r["lang_pred"] for r in langid.identify(frame(spark, data), none).collect()} == {"und"}


def _plain_phrases(text, source, piece):
    """Phrases of a greedy parse of text by the longest matches in source."""
    n = 0
    for begin in range(0, len(text), piece):
        part, at = text[begin : begin + piece], 0
        while at < len(part):
            size = 1
            while at + size < len(part) and part[at : at + size + 1] in source:
                size += 1
            n, at = n + 1, at + size
    return n


def _plain_text(t):
    return re.sub(rb"[\x00-\x60\x7B-\x7F]+", b" ", (t or "").translate({i: i + 32 for i in range(65, 91)}).encode()).strip(b" ")


@pytest.mark.parametrize("piece", [512, 7])
def test_automata_parse_like_plain_search(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    sources = {"a": ["abracadabra barb", "cab"], "b": ["la cigale ayant chanté"], "c": ["z"]}
    models = langid.train({k: [x.encode() for x in v] for k, v in sources.items()})
    cases = ["abra", "xabra", "barbara la cigale", "zz", "cad bar chanté z", "", "Abra, 12 CAB!", "é" * 40]
    got = langid.phrase_counts([langid.plain(t.encode()) for t in cases], models[0])
    for t, own in zip(cases, got.tolist()):
        assert own == [_plain_phrases(_plain_text(t), b" " + b" ".join(_plain_text(x) for x in v) + b" ", piece) for v in sources.values()], t


def test_languages_equal_a_plain_parse(spark, monkeypatch):
    """Null ids, repeated rows, shared ids, mixed and very long texts; more languages than are parsed at once."""
    import random

    monkeypatch.setattr(langid, "AT_ONCE", 2)
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 6)
    monkeypatch.setattr(langid, "TRAIN_BYTES", 700)
    rng = random.Random(11)
    stems = {x: [x + "".join(rng.choices("aeiounrst", k=4)) for _ in range(12)] for x in ("de", "en", "fr")}
    data = [(None if i % 4 == 0 else i % 30, " ".join(rng.choices(stems[x], k=rng.randrange(1, 40))), x, "s", 0, "k", 0, 0) for i, x in enumerate(["de", "en", "fr"] * 20)]
    data += [data[0]] * 50 + [(90, "ü " * 4000, "long", "s", 0, "k", 0, 0), (91, None, "en", "s", 0, "k", 0, 0), (92, " ".join(rng.choices(stems["fr"], k=3000)), None, "s", 0, "k", 0, 0)]
    samples = langid.sample(frame(spark, data))
    assert sorted(samples) == ["de", "en", "fr", "long"] and all(len(v) == len(set(v)) <= 20 for v in samples.values())
    assert all(t.decode() in {d[1] for d in data} for x, v in samples.items() if x != "long" for t in v)
    sources = {}
    for x in sorted(samples):
        taken, left = [], 700
        for t in samples[x]:
            t = _plain_text(t.decode())
            if len(t) <= left:
                taken.append(t)
                left -= len(t) + 1
        sources[x] = b" " + (b" ".join(taken) if taken else _plain_text(samples[x][0].decode())[:700]) + b" "
    want = Counter()
    for d in data:
        counts = [(_plain_phrases(_plain_text(d[1]), v, langid.PIECE) * math.log2(len(v)), x) for x, v in sources.items()]
        one, two = sorted(counts)[:2]
        want[(d[0], min(counts)[1] if d[1] else "und", round(1 - one[0] / two[0], 9) if d[1] else 0.0)] += 1
    got = langid.identify(frame(spark, data), langid.train(samples, 700))
    assert Counter((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in got.collect()) == want


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op8_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    right, all_ = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert all_ > 200 and right >= 0.99 * all_


def test_tasks_learn_what_the_driver_would(spark, monkeypatch):
    """Automata built by a task a language, texts that fit and one that doesn't, repeated rows and null languages."""
    monkeypatch.setattr(langid, "TRAIN_BYTES", 400)
    rng = random.Random(5)
    word = lambda own: "".join(rng.choice(own) for _ in range(rng.randint(1, 7)))
    data = [(n, " ".join(word(own) for _ in range(rng.randint(1, 40))), lang, *[None] * 5) for n, (lang, own) in enumerate([("aa", "abc"), ("bb", "bcdé"), ("cc", "xyz ß")] * 30)]
    data += [(1000, "only one much longer text " * 40, "dd", *[None] * 5), data[0], data[0], (1001, None, "aa", *[None] * 5), (1002, "no language", None, *[None] * 5), (None, "a text without id", "bb", *[None] * 5)]
    docs = frame(spark, data)
    mine, plain = langid.trained(docs), langid.train(langid.sample(docs), 400)
    assert [m.languages for m in mine] == [m.languages for m in plain] == [["aa", "bb", "cc", "dd"]]
    for a, b in zip(mine, plain):
        assert all((getattr(a, f) == getattr(b, f)).all() for f in ("roots", "bits_a_phrase", "keys", "to"))
    assert langid.trained(empty(spark)) == []


def test_unequal_samples(spark):
    """A language with 5 labelled rows beside others with 200."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train_ = docs.where(~langid.held_out(F.col("doc_id")))
    few = train_.where("lang = 'es'").orderBy("doc_id").limit(5)
    models = langid.train(langid.sample(train_.where("lang <> 'es'").unionByName(few)))
    test = docs.where(langid.held_out(F.col("doc_id")))
    got = langid.identify(test, models).join(test.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'")
    right, all_ = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert all_ > 200 and right >= 0.99 * all_


# -- language model


def test_unigram_scores(spark):
    got = lm.score(frame(spark), lm.held_out(F.col("doc_id")))
    counts = Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    for r in rows():
        if not held(r[0]):
            counts.update([*plain_words(r[1]), None])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows():
        t = [*plain_words(r[1]), None]
        want[(r[0], held(r[0]), len(t), sum(counts[x] > 0 for x in t), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got.collect()) == want
    assert lm.score(empty(spark), lm.held_out(F.col("doc_id"))).count() == 0


def test_rare_tokens_meet_their_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 3)
    test_unigram_scores(spark)


def test_unigram_lower_cases(spark):
    cases = ["The cat THE Cat", "the Dog sat", "ÉTÉ Été CAT", "Dog the dog", None, "A a"]
    data = [(i, t, "en", "s", 0, "k", 0, 0) for i, t in enumerate(cases)]
    got = {r["doc_id"]: r for r in lm.score(frame(spark, data), F.col("doc_id") == 3).collect()}
    plain = [[*plain_words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None] for t in cases]
    counts = Counter(x for i, t in enumerate(plain) if i != 3 for x in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(plain):
        want = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(t), sum(counts[x] > 0 for x in t), n)
        assert got[i]["base_score"] == pytest.approx(want, abs=1e-6)
    assert got[3]["n_known"] == 4


def _whole_trie(train, order=3):
    """log10 of a text's probability over the end mark and all 256 bytes, by the definition."""
    grams = [defaultdict(Counter) for _ in range(order + 1)]
    framed = lambda t: [-1] * order + list(t) + [-1]
    for t in train:
        s = framed(t)
        for i in range(order, len(s)):
            for o in range(order + 1):
                grams[o][tuple(s[i - o : i])][s[i]] += 1

    def log(context, x):
        out, gone = 0.0, set()
        for o in range(order, -1, -1):
            seen = {y: c for y, c in grams[o][tuple(context[order - o :])].items() if y not in gone}
            if not seen:
                continue
            gone |= set(seen)
            total = sum(seen.values()) + (len(seen) if len(gone) < 257 else 0)
            if x in seen:
                return out + math.log10(seen[x] / total)
            out += math.log10(len(seen) / total)
        return out - math.log10(257 - len(gone))

    return lambda t: sum(log(s[i - order : i], s[i]) for s in [framed(t)] for i in range(order, len(s)))


@pytest.mark.parametrize("cache", [1 << 20, 200, 0])
def test_all_bytes_have_contexts(spark, monkeypatch, cache):
    monkeypatch.setattr(lm, "CACHE", cache)
    latin = "".join(map(chr, range(33, 127)))  # more byte values than a table of 64 symbols holds
    cases = [latin * 3, "мир и мир", "мир или дом", "漢字と漢字", "漢字と仮名", None, "", "abc ABC 012\0", "дом 漢字 new", "\0\0", latin]
    data = [(i, t, "en", "s", 0, "k", 0, 0) for i, t in enumerate(cases)] + [(None, "abc мир", None, None, None, None, None, None)]
    held = F.col("doc_id").isin(4, 8, 9) & F.col("doc_id").isNotNull()
    got = {r["doc_id"]: r["score"] for r in lm.score(frame(spark, data), held).collect()}
    plain = _whole_trie([(t or "").encode() for i, t, *_ in data if i not in (4, 8, 9)])
    for i, t, *_ in data:
        assert got[i] == pytest.approx(plain((t or "").encode()), abs=1e-6), i


@pytest.mark.parametrize("left_out", [0, 1, 60])
def test_probabilities_of_a_context_sum_to_one(left_out):
    """Also where every symbol has been seen, so that nothing is left to escape to."""
    import numpy as np

    rng = np.random.default_rng(left_out)
    symbols = np.arange(lm.WHOLE - left_out)
    pairs = np.zeros((lm.WHOLE, lm.WHOLE), np.int64)
    pairs[:, symbols] = rng.integers(0, 4, (lm.WHOLE, len(symbols)))
    pairs[7, symbols] += 1  # a context of one symbol that has seen all of these
    for context in (5 * lm.WHOLE**2 + 6 * lm.WHOLE + 7, 9, lm.WHOLE**3 - 1):
        k = context * lm.WHOLE + np.arange(lm.WHOLE)
        for n in (np.zeros(lm.WHOLE, np.int64), rng.integers(0, 3, lm.WHOLE), np.ones(lm.WHOLE, np.int64)):
            assert (10.0 ** lm.resolve(k, n, pairs)).sum() == pytest.approx(1, abs=1e-9)


def test_adaptive_code_learns():
    once, again = lm.adaptive_code_length(b"some words here "), lm.adaptive_code_length(b"some words here " * 4)
    assert again < 2 * once and lm.adaptive_code_length(b"") == pytest.approx(math.log2(257))


# -- packing


def test_packing(spark):
    data = [r for r in rows() if r[0] is not None]
    packed = packing.pack(frame(spark, data), capacity=150, per_source=2).collect()
    total = Counter()
    bins = defaultdict(list)
    for r in packed:
        total[r["doc_id"]] += r["n_tokens"]
        bins[r["shard"], r["bin"]].append(r)
    want = Counter()
    for r in data:
        want[r[0]] += len(plain_words(r[1]))
    assert +total == +want
    by_id = {r[0]: r for r in data}
    for own in bins.values():
        assert sum(r["n_tokens"] for r in own) <= 150
        assert max(Counter(by_id[r["doc_id"]][3] for r in own).values()) <= 2
        assert max(Counter(by_id[r["doc_id"]][1] for r in own).values()) == 1
    assert packing.pack(empty(spark)).count() == 0 and packing.pack(frame(spark)).count() > len(packed) // 2


def test_repeated_rows_fill_no_shard(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 500)
    row = (7, "one row again and again", "en", "s", 0, "k", 0, 0)
    out = packing.pack(spark.range(20_000).select(*(F.lit(x).alias(c) for x, c in zip(row, ("doc_id", "text", "lang", "source", "n_chars", "key", "bucket", "n"))))).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("bin").alias("bins")).collect()
    assert sum(r["n"] for r in out) == 20_000 and max(r["n"] for r in out) < 700 and all(r["n"] == r["bins"] for r in out)


def test_best_fit_equals_plain_search():
    import random

    rng = random.Random(9)
    for _ in range(20):
        cap, per = rng.randrange(5, 40), rng.randrange(1, 4)
        items = sorted(((rng.randrange(1, cap + 1), rng.randrange(4), rng.randrange(-1, 6)) for _ in range(80)), reverse=True)
        bins, want = [], []
        for size, s, c in items:
            fit = [(cap - sum(x[0] for x in b), n) for n, b in enumerate(bins) if cap - sum(x[0] for x in b) >= size and sum(x[1] == s for x in b) < per and (c < 0 or all(x[2] != c for x in b))]
            n = min(fit)[1] if fit else len(bins)
            if not fit:
                bins.append([])
            bins[n].append((size, s, c))
            want.append(n)
        assert packing.best_fit(*map(list, zip(*items)), cap, per) == want


def test_long_documents_are_cut_without_loss(spark):
    docs = frame(spark, [(7, "x " * 1000, None, None, None, None, None, None)])
    got = sorted((r["first_word"], r["n_tokens"]) for r in packing.pack(docs, capacity=300).collect())
    assert got == [(0, 300), (300, 300), (600, 300), (900, 100)]
