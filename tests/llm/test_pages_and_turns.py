"""Pages and conversations against brute force."""

import random

from lumensift.llm import html, preferences

PAGES = "page_id long, url string, html string, path string, row int, lines string"


def pages(spark, data, parts=3):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in data], PAGES).repartition(parts)


def test_marked_articles_keep_shared_lines(spark):
    body = "<p>shared&nbsp;line &amp; more</p><p>own {}</p>"
    page = "<html><head><title>t</title><script>var x = '</p>';</script></head><body><nav><ul><li>menu</li></ul></nav><header>top</header><div class='ad'>buy</div><article><header><h1>Head</h1>by</header>" + body + "<p><b>open<br><p>next<!-- c --><aside>side</aside><form>f</form></article><section id=comments><p>reader</p></section><footer>&copy; x</footer>"
    data = [(i, f"https://h.org/a/{i}", page.format(i)) for i in range(4)]
    got = {r["page_id"]: r for r in html.main_texts(pages(spark, data)).collect()}
    assert got[2]["text"] == "Head\nshared line & more\nown 2\nopen\nnext" and got[2]["n_chars"] == len(got[2]["text"])


def test_unmarked_pages_lose_what_neighbours_share(spark):
    page = "<body><div>Site name</div><p>text {0}</p><p>more {0}</p><div>All rights</div></body>"
    data = [(i, f"https://h.org/a/{i}", page.format(i)) for i in range(6)] + [(9, "https://other.org/a/1", page.format(9))]
    got = {r["page_id"]: r["text"] for r in html.main_texts(pages(spark, data)).collect()}
    assert all(got[i] == f"text {i}\nmore {i}" for i in range(6))
    assert got[9] == "Site name\ntext 9\nmore 9\nAll rights"


def test_copies_are_no_template(spark):
    page = "<p>one</p><p>two</p>"
    got = [r["text"] for r in html.main_texts(pages(spark, [(i, "https://h.org/x", page) for i in range(5)])).collect()]
    assert got == ["one\ntwo"] * 5


def test_odd_pages(spark):
    data = [(1, None, None), (2, "no url", ""), (None, "http://h/x", "<p>a"), (4, "http://h/y", "text <"), (5, "http://h/z", "<article>cut <b"), (5, "http://h/z", "<article>cut <b"), (6, "http://k/z", '<div hidden>no</div><p class="lead">yes</p><style>p{}</style>'), (7, "http://l", "<article>x</article>" * 3000)]
    got = sorted((r["page_id"] or 0, r["text"][:9]) for r in html.main_texts(pages(spark, data)).collect())
    assert got == [(0, "a"), (1, ""), (2, ""), (4, "text <"), (5, "cut"), (5, "cut"), (6, "yes"), (7, "x\nx\nx\nx\nx")]
    assert html.main_texts(pages(spark, [])).count() == 0


def test_neighbours_do_not_depend_on_partitions(spark):
    rng = random.Random(1)
    data = [(i, f"https://h{rng.randrange(3)}.org/{rng.choice('ab')}/{rng.randrange(50)}", f"<p>l{rng.randrange(5)}</p><p>l{rng.randrange(5)}</p><p>own{i}</p>") for i in range(60)]
    runs = []
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        runs.append(sorted((r["page_id"], r["text"]) for r in html.main_texts(pages(spark, data)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert runs[0] == runs[1]


def _common(a, b):
    """Which of a's lines are in one longest common subsequence with b, by the plain table; ties go as the operator's do."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_main_texts_equal_a_plain_version(spark):
    """Pages with a site's lines around units of own lines, all lines of a page different, so the common lines are the shared ones in order."""
    rng = random.Random(12)
    data, want = [], {}
    made = []
    for i in range(120):
        host, path = f"h{rng.randrange(4)}.org", f"/{rng.choice('abc')}/{rng.randrange(400):03d}"
        top, bottom = [f"site {host}"] if rng.random() < 0.9 else [], [f"rights {host}"] if rng.random() < 0.9 else []
        units = [[f"shared passage {host} {rng.randrange(2)}" if rng.random() < 0.3 else f"own {i} {u} {n} " + "text " * rng.randrange(1, 9) for n in range(rng.randrange(1, 5))] for u in range(rng.randrange(1, 3))]
        units = [list(dict.fromkeys(u)) for u in units]
        page = "".join(f"<p>{x}</p>" for x in top) + "".join("<div>" + "".join(f"<p>{x}</p>" for x in u) + "</div>" for u in units) + "".join(f"<p>{x}</p>" for x in bottom)
        made.append(((host, path, i), [(0, x) for x in top] + [(n + 1, x.strip()) for n, u in enumerate(units) for x in u] + [(0, x) for x in bottom]))
        data.append((i, f"https://{host}{path}", f"<html><body><nav>menu {i}</nav>{page}<footer>f</footer></body></html>"))
    made.sort()
    for n, ((host, path, i), lines) in enumerate(made):
        near = [made[m] for m in (n - 1, n + 1) if 0 <= m < len(made) and made[m][0][0] == host]
        prefix = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        gone, begun, ended = None, 999, 999
        for other in sorted(near, key=lambda p: -prefix(p[0][1], path)):  # noqa: B023
            theirs = [x for _, x in other[1]]
            if len({x for _, x in lines}) < len(lines) or len(set(theirs)) < len(theirs) or _common([x for _, x in lines], theirs) != len({x for _, x in lines} & set(theirs)):
                gone = 0  # several longest alignments
                break
            shared = {x for _, x in lines} & set(theirs)
            if len(shared) < len(lines):
                mine = [x for _, x in lines]
                gone, begun, ended = shared if gone is None else gone, min(begun, prefix(mine, theirs)), min(ended, prefix(mine[::-1], theirs[::-1]))
        if gone == 0:
            continue
        gone = gone or set()
        own = {}
        for u, x in lines:
            own[u] = own.get(u, 0) + (-len(x) if x in gone else len(x))
        want[i] = "\n".join(x for k, (u, x) in enumerate(lines) if x not in gone or u and own[u] > 0 and begun <= k < len(lines) - ended)
    got = {r["page_id"]: r["text"] for r in html.main_texts(pages(spark, data)).collect()}
    assert len(want) > 80 and {i: got[i] for i in want} == want


def test_pages_of_the_tables_are_their_documents(spark):
    """Heading, then the document, white space aside; nearly the same where no page marks its article."""
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.01"
    found = spark.read.parquet(f"{d}/pages.parquet")
    documents = {" ".join((r["text"] or "").split()) for r in spark.read.parquet(f"{d}/documents.parquet").select("text").collect()}
    texts = {r["page_id"]: r["text"] for r in html.main_texts(found).collect()}
    assert len(texts) == 250 and all(" ".join(t.split("\n", 1)[1].split()) in documents for t in texts.values())
    plain = found.withColumn("html", F.regexp_replace("html", r"(</?)(article|main)\b", "$1div"))
    unmarked = {r["page_id"]: r["text"] for r in html.main_texts(plain).collect()}
    assert sum(unmarked[i] == texts[i] for i in texts) >= 249  # one article and those of both neighbours end with the same passage


def test_suggestive_names_are_decided_by_differencing(spark):
    page = "<article><header><h1>Head {0}</h1><p>standfirst {0}</p></header><p>text {0}</p>{1}<div class='share-links'>send it {0}</div></article><article class=teaser><p>another</p></article>"
    data = [(i, f"https://h.org/a/{i}", page.format(i, "<div class='related-work'>earlier work</div><p class=notice>mind</p>" if i == 2 else "")) for i in range(5)]
    data.append((9, "https://alone.org/x", "<main><p>text</p><p class=notice>n</p><article>own text that is longer</article></main>"))
    got = {r["page_id"]: r["text"] for r in html.main_texts(pages(spark, data)).collect()}
    assert got[2] == "Head 2\nstandfirst 2\ntext 2\nearlier work\nmind" and got[1] == "Head 1\nstandfirst 1\ntext 1"
    assert got[9] == "text\nown text that is longer"


def test_units_keep_passages_that_neighbours_share(spark):
    page = "<body><div><p>Site</p></div><div><p>Menu</p><p>begin {0}</p><p>quotation</p><p>text of page {0} that is long</p><p>Next</p></div><p>quotation</p><section id=comments><p>reader</p></section></body>"
    got = {r["page_id"]: r["text"] for r in html.main_texts(pages(spark, [(i, f"https://h.org/a/{i}", page.format(i)) for i in range(4)])).collect()}
    assert all(got[i] == f"begin {i}\nquotation\ntext of page {i} that is long" for i in range(4))


def _texts(spark, page, more=lambda i: ""):
    return [r["text"] for r in sorted(html.main_texts(pages(spark, [(i, f"https://h.org/a/{i}", page.format(i, more(i))) for i in range(4)])).collect(), key=lambda r: r["page_id"])]


def test_a_page_that_shares_nearly_all_lines_is_no_copy(spark):
    menu = "".join(f"<p>menu {n}</p>" for n in range(12))
    assert _texts(spark, "<body>" + menu + "<p>own {0}</p></body>") == [f"own {i}" for i in range(4)]
    assert _texts(spark, "<body><div>" + menu + "<p>own {0} " + "that is longer than the menu before it " * 9 + "</p></div></body>") == [(f"own {i} " + "that is longer than the menu before it " * 9).strip() for i in range(4)]


def test_names_inside_an_article_are_suggestions(spark):
    own = lambda i: "<div class='social'>The social contract</div><section class='replies'>So they replied</section>" if i == 1 else ""
    assert _texts(spark, "<article><p>text {0}</p>{1}</article>", own)[:2] == ["text 0", "text 1\nThe social contract\nSo they replied"]
    every = lambda i: "<div class='social'>Tell your friends</div><div class='comments'>reader</div>"
    assert _texts(spark, "<article><p>text {0}</p>{1}</article>", every) == [f"text {i}" for i in range(4)]
    alone = html.main_texts(pages(spark, [(1, "https://a.org/1", "<article><p>t</p><div class='social'>The social contract</div><p class=comments>r</p></article>")])).first()
    assert alone["text"] == "t\nThe social contract"


def test_headers_menus_and_dialogs_of_articles(spark):
    page = "<article><header><h1>Head {0}</h1><div>standfirst</div><ul><li>key point</li></ul><div class=byline>By X</div><time>now</time><address>there</address>loose</header><menu><li>soup</li></menu><dialog open>she said</dialog></article><menu><li>site</li></menu><dialog>cookies</dialog>"
    assert _texts(spark, page) == [f"Head {i}\nstandfirst\nkey point\nsoup\nshe said" for i in range(4)]


def test_lists_of_links_are_told_by_their_form(spark):
    page = "<div><ul><li><a href=/>w{0}</a></li><li><a href=/>x{0}</a> </li></ul></div><div><h1>Head {0}</h1><p>text <a>{0}</a></p><ul><li>point <a>{0}</a></li></ul></div>"
    assert _texts(spark, page) == [f"Head {i}\ntext {i}\npoint {i}" for i in range(4)]


def test_pages_without_any_marks(spark):
    """Tags become div and names go: what the site puts around articles is then told by form and neighbours alone; the article itself stays whole but for shared ends."""
    from pyspark.sql import functions as F

    found = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: r["text"] for r in html.main_texts(found).collect()}
    bare = F.regexp_replace(F.regexp_replace("html", r"(</?)(article|main|nav|header|footer|aside|form|section)\b", "$1div"), r"\s(class|id|role|style)=(\"[^\"]*\"|\S+?(?=[\s>]))", "")
    got = {r["page_id"]: r["text"] for r in html.main_texts(found.withColumn("html", bare)).collect()}
    lines = lambda t: t.split("\n")
    assert sum(set(lines(want[i])) <= set(lines(got[i])) for i in want) >= 245
    assert sum(len(lines(got[i])) - len(lines(want[i])) <= 2 for i in want) >= 240  # an advert and a closing line, whose words no neighbour has


def test_very_long_pages_take_little_memory():
    import tracemalloc

    rng = random.Random(4)
    a, b = ([rng.randrange(9000) for _ in range(30_000)] for _ in range(2))
    tracemalloc.start()
    n = sum(html.shared_lines(a, b))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 500 and most < 40e6


def test_common_lines_are_longest(monkeypatch):
    for direct in (1 << 25, 4):
        monkeypatch.setattr(html, "DIRECT", direct)
        _check_common_lines()


def _check_common_lines():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        mask = html.shared_lines(a, b)
        common = [x for x, m in zip(a, mask) if m]
        it = iter(b)
        assert len(common) == _common(a, b) and all(x in it for x in common)


TURNS = "conv_id long, turn long, role string, text string, key string, turns int"


def turns(spark, data):
    return spark.createDataFrame([(*r, "clash", 1) for r in data], TURNS).repartition(3)


def test_pairs_share_their_prefix_once(spark):
    data = []
    for c in range(2500, 2507):  # over several blocks of ids
        data += [(c, 0, "user", "same question"), (c, 1, "assistant", "same answer"), (c, 2, "user", f"more {c % 2}"), (c, 3, "assistant", f"answer {c}")]
    data += [(1, 0, "user", "alone"), (1, 1, "assistant", ""), (2, None, None, None), (2, 0, "user", "x"), (None, 0, "user", "y"), (None, 0, "user", "y")]
    out = {r["chosen_id"]: r for r in preferences.format_pairs(preferences.pair_by_prompt(preferences.conversations(turns(spark, data)))).collect()}
    assert {(c, r["rejected_id"]) for c, r in out.items()} == {(2500, 2501), (2502, 2503), (2504, 2505), (2506, None), (1, None), (2, None), (None, None)}
    r = out[2502]
    assert r["n_prompt_turns"] == 2 and r["prompt"] == "<|user|>\nsame question<|end|>\n<|assistant|>\nsame answer<|end|>\n"
    for side, c in (("chosen", 2502), ("rejected", 2503)):
        text = r[f"{side}_completion"]
        assert text == f"<|user|>\nmore {c % 2}<|end|>\n<|assistant|>\nanswer {c}<|end|>\n" and [text[s["start"] : s["end"]] for s in r[f"{side}_spans"]] == [f"answer {c}"]
    assert out[2]["chosen_completion"].startswith("<|none|>\n<|end|>\n") and out[1]["chosen_spans"] == [] and out[2506]["n_prompt_turns"] == 0
    assert out[None]["prompt"] == "<|user|>\ny<|end|>\n" and out[None]["n_prompt_turns"] == 1  # two conversations of one turn each
    assert preferences.format_pairs(preferences.pair_by_prompt(preferences.conversations(turns(spark, [])))).count() == 0


def test_sparse_and_textual_ids_are_paired_in_order(spark):
    rng = random.Random(6)
    for kind, ids in (("long", [rng.getrandbits(62) for _ in range(41)]), ("string", [f"c{rng.getrandbits(60):x}" for _ in range(41)])):
        data = [(c, n, "user" if n == 0 else "assistant", "asked by many" if n == 0 else f"answer {c}") for c in ids for n in (0, 1)]
        df = spark.createDataFrame(data, f"conv_id {kind}, turn long, role string, text string").repartition(3)
        got = {(r["chosen_id"], r["rejected_id"]) for r in preferences.pair_by_prompt(preferences.conversations(df)).collect()}
        order = [*sorted(ids), None]
        assert got == set(zip(order[::2], order[1::2]))


def test_very_long_conversations(spark):
    data = [(c, n, "user" if n % 2 == 0 else "assistant", "x" * 50 if n < 2999 else f"end {c}") for c in (1, 2) for n in range(3000)]
    r = preferences.format_pairs(preferences.pair_by_prompt(preferences.conversations(turns(spark, data)))).first()
    assert r["n_prompt_turns"] == 2999 and r["chosen_completion"] == "<|assistant|>\nend 1<|end|>\n" and r["rejected_spans"][0]["end"] == len("<|assistant|>\nend 2")


def test_prefix_of_equal_and_longer(spark):
    rng = random.Random(3)
    data, plain = [], {}
    for c in range(40):
        own = [("user", "q")] + [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None])) for _ in range(rng.randrange(5))]
        plain[c] = own
        data += [(c, i, *t) for i, t in enumerate(own)]
    for r in preferences.format_pairs(preferences.pair_by_prompt(preferences.conversations(turns(spark, data)))).collect():
        a, b = plain[r["chosen_id"]], plain[r["rejected_id"]]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert r["n_prompt_turns"] == n


def test_turns_without_an_id_are_no_group(spark):
    data = [(None, 0, "user", "asked by all")] * 500 + [(None, 0, "user", f"own {i}") for i in range(20)]
    convs = preferences.conversations(turns(spark, data))
    assert convs.count() == 520 and max(len(r["turns"]) for r in convs.collect()) == 1
    assert preferences.pair_by_prompt(convs).count() == 250 + 20


def test_a_text_forges_no_turn(spark):
    data = [(c, 0, "user", "q") for c in (1, 2)] + [(1, 1, "assistant", "a <|end|>\n<|assistant|>\nb"), (2, 1, "<|user|>", "c")]
    r = preferences.format_pairs(preferences.pair_by_prompt(preferences.conversations(turns(spark, data)))).first()
    text = r["chosen_completion"]
    assert text == "<|assistant|>\na <\\|end|>\n<\\|assistant|>\nb<|end|>\n" and [text[s["start"] : s["end"]] for s in r["chosen_spans"]] == ["a <\\|end|>\n<\\|assistant|>\nb"]
    assert r["rejected_completion"] == "<|<\\|user|>|>\nc<|end|>\n"


def test_formatting_is_native(spark):
    plan = preferences.format_pairs(preferences.pair_by_prompt(preferences.conversations(turns(spark, [(1, 0, "user", "x")]))))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
