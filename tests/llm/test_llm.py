"""Each operator against a brute-force version on small tables with awkward rows."""

import os
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import rows
from pyspark.sql import functions as F

from pyrocast.llm import ann, bpe, html_text, jaccard_join, line_dedup, mixing, quality, sharding, token_files, warc
from pyrocast.llm.common import shared_folder
from pyrocast.llm.components import connected_components
from pyrocast.llm.queries import QUERIES, SQL

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, key string, start string"


def awkward():
    """Texts with nulls, copies, ties, a very long one, shared lines and wide characters."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(300)]
    said = lambda n: " ".join(rng.choices(vocabulary, k=n))
    texts = [None, "", " ", "\n\n", "short", "SHORT line\nshort LINE", "one two three four", "ONE two\tthree four", "é日本 ünï 😀 text here"]
    base = [said(n) for n in (40, 60, 80, 200)]
    texts += base + base[:2]
    for b in base:
        w = b.split()
        w[7] = "changed"
        texts += [" ".join(w), b + "\nA line that many documents hold", "A LINE that many documents hold  \n" + said(30)]
    texts += ["\n".join(said(12) for _ in range(3000)), said(55), "*** " * 60, "go " * 80, said(70) + "\n" + said(70)]
    return [(i, t, "en", ["a", "b", None, "ü", "b"][i % 5], 0, "x", "y", "z", "0") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of():
    return {r[0]: r[1] for r in awkward()}


# --- 1: line dedup


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def deduped(texts):
    holders = {}
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    gone = {k: min(v) for k, v in holders.items() if len(k) >= 10 and len(v) > 1}
    out = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        stay = [x for x in lines if gone.get(key(x), i) == i]
        out[i] = ("\n".join(stay), len(lines), len(lines) - len(stay))
    return out


def test_line_dedup(docs, none):
    got = {r.doc_id: (r.text or "", r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect()}
    want = deduped(texts_of())
    assert got == want and sum(w[2] for w in want.values()) > 5
    assert line_dedup.dedup_lines(docs).columns == [*docs.columns, "n_lines", "n_dropped"]
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_ids(spark):
    df = spark.createDataFrame([(None, "the very same line"), (5, "the very same line"), (5, "The very same line"), (7, "the very same line\nmine")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(False, 5, "The very same line"), (False, 5, "the very same line"), (False, 7, "mine"), (True, 0, "")]


def test_line_dedup_hot_line(spark):
    """A line of so many documents that its first is sent to it; columns with the names of results."""
    texts = {i: f"the line that all hold\nmine alone {i}\nheld by two or three {i % 500}" for i in range(1400)}
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in texts.items()], "doc_id long, text string, n_lines long, __x string").repartition(5)
    want = deduped(texts)
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()} == want
    kept = line_dedup.drop_lines(df)
    assert kept.columns == df.columns
    assert {r.doc_id: (r.text, r.n_lines) for r in kept.collect()} == {i: (w[0], 7) for i, w in want.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir), duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    # as tuples: pandas would make floats of whole numbers where some are null
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


# --- 2: HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu, one.</a><li><a href=/b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies, always.</div><aside>Side, note.</aside>
<article><header><h1>The head &amp; tail</h1></header><p>First  paragraph,\n with <b>bold</b> text &eacute;.<br>More<p>Second &lt;one&gt;, unclosed.
<div class="ad">Buy, now!</div><ul><li>Item one, here.</ul><form><input value="x">Sign, up.</form><section id="comments"><p>I, a reader, say so.</p></section></article>
<footer>&copy; Site, all.</footer><!-- <p>gone</p> --></body></html>"""


def test_html():
    assert html_text.main_text(PAGE).split("\n") == ["The head & tail", "First paragraph, with bold text é. More", "Second <one>, unclosed.", "Item one, here."]


def test_html_names_inside_an_article():
    """Names and links that an article's own paragraphs may have."""
    said = ["Legal words stand here, and they are long enough to be read.", "A side note that belongs to the article, with commas, too.", "The discussion of the results goes on, with marks, and so on.", "A paragraph that is one link, all of it.", "A plain paragraph that ends the article, which is good."]
    inner = "<div class='legal'><p>{}</p></div><p class='side note'>{}</p><div id='discussion'><p>{}</p></div><p><a href=x>{}</a></p><p>{}</p>".format(*said)
    page = f"<body><nav><a href=/>Home</a></nav><article><h1>Head</h1>{inner}<div class='comments'><p>A reader says so, and so.</p></div></article><div class='legal'>All rights, reserved.</div></body>"
    assert html_text.main_text(page).split("\n") == ["Head", *said]


def test_html_takes_linear_time():
    import time

    n = 80_000
    for page in ("<div>" * n + "x, y", "<p>x, y</p>" + '<a title="x ' * n, '<p>x, y</p><a title="x ' * n + ">", "<div>text, here." * n, "<p>a, b" * n, "<b>a" * n, "<div>" * n + "</p>" * n + "a, b", "<div class=side>" * n + "<p>x", "<" * n + "<p>x", "<!-- x" * n):
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 6, page[:30]


def test_html_table(spark):
    """Nulls, repeated rows, columns with the names of results, and an empty table."""
    page = "<article><p>Words, of a page.</p></article>"
    df = spark.createDataFrame([(1, "u", page, 5, "t"), (1, "u", page, 5, "t"), (None, None, None, 6, "t"), (2, "v", "", 7, "t")], "page_id long, url string, html string, n_chars int, text string")
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in html_text.extract(df).collect())
    assert got == [(0, "", "", 0), (1, "u", "Words, of a page.", 17), (1, "u", "Words, of a page.", 17), (2, "v", "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_without_article():
    body = "".join(f"<div class=content><p>Paragraph {i}, which is long enough to be read, and has marks.</p></div>" for i in range(4))
    page = f"<body><ul class=list><li><a href=x>Home</a><li><a href=y>About</a></ul>{body}<div class=row><span>tiny</span></div></body>"
    assert html_text.main_text(page).count("Paragraph") == 4 and "Home" not in html_text.main_text(page) and "tiny" not in html_text.main_text(page)


def test_html_ratios_decide():
    """A long block, short list items and wrappers with the name of a part lose no text; text beside an article counts by its ratios."""
    said = [f"Paragraph {i} says what it has to say, and then it ends." for i in range(6)]
    ps, long = "".join(f"<p>{x}</p>" for x in said), "x = f(a, b); " * 400
    assert html_text.main_text(f"<body><div>{ps}</div><pre>{long}</pre></body>").split("\n") == [*said, long.strip()]
    items = [f"Part number {i} of the kit" for i in range(5)]
    listed = f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>"
    assert html_text.main_text(f"<body><div>{ps}{listed}<pre>{long}</pre></div></body>").split("\n") == [*said, *items, long.strip()]
    wrapped = f'<body><div class="with sidebar"><div class=sidebar>Elsewhere, other things.</div><article>{ps}<p id=comments>No, never.</p></article></div></body>'
    assert html_text.main_text(wrapped).split("\n") == said
    comments = f"<body><div>{ps}</div><div id=comments><article class=comment>I, a reader, say so.</article></div></body>"
    assert html_text.main_text(comments).split("\n") == said
    assert html_text.main_text(f"<body><article>{ps}</article><div class=more>{ps}</div></body>").split("\n") == said


SAID = [f"Paragraph {i} says what it has to say, and then it ends." for i in range(6)]
ARTICLE = "<h1>Head</h1>" + "".join(f"<p>{x}</p>" for x in SAID)


@pytest.mark.parametrize(
    "inner",
    ["<section id='recommendations'><p>{}</p></section>", "<div class='related-work'><p>{}</p></div>", "<div id='social-history'>{}</div>", "<p id='modal'>{}</p>", "<ul><li><a href=x>{}</a></li></ul>", "<p>{}</p>"],
)
def test_html_keeps_what_stands_in_the_article(inner):
    more = "One more says this, and that as well."
    for outer in ("<article>{}</article>", "<main>{}</main>", "<form id=aspnetForm><article>{}</article></form>", "<div class=sidebar><article>{}</article></div>"):
        page = f"<body><nav><a href=/>Home</a></nav>{outer.format(ARTICLE + inner.format(more))}<footer>Site, all.</footer></body>"
        assert html_text.main_text(page).split("\n") == ["Head", *SAID, more], outer
    sources = "".join(f"<li><a href=x>Source {i}</a></li>" for i in range(9))
    assert html_text.main_text(f"<body><article>{ARTICLE}<ul>{sources}</ul></article></body>").split("\n") == ["Head", *SAID, *[f"Source {i}" for i in range(9)]]
    # a form in the article that holds nearly all of it
    assert html_text.main_text(f"<body><article><form>{ARTICLE}</form></article></body>").split("\n") == ["Head", *SAID]


@pytest.mark.parametrize(
    "beside",
    [
        "<div class=cards>" + "".join(f"<div><h3>Card {i}</h3><p>A card that says some words, and leads on.</p></div>" for i in range(9)) + "</div>",
        "<div>All rights reserved, by the owner of the site, for all times.</div>",
        "<section>" + "".join(f"<div><p>I, reader number {i}, say that this is so, and so on, at length.</p></div>" for i in range(60)) + "</section>",
        "<article class=comment><p>I, a reader, say so, and so on.</p></article>",
        "<article><h3>Card</h3></article><article><h3>Card</h3></article>",
    ],
)
def test_html_leaves_out_what_stands_beside_the_article(beside):
    for page in (f"<body><article>{ARTICLE}</article>{beside}</body>", f"<body><div>{beside}</div><main>{ARTICLE}</main></body>"):
        assert html_text.main_text(page).split("\n") == ["Head", *SAID]


def test_html_articles_of_a_list():
    page = "<body><div>" + "".join(f"<article>{ARTICLE}</article>" for _ in range(4)) + "</div><div><p>Beside them, there is this.</p></div></body>"
    assert html_text.main_text(page).split("\n") == ["Head", *SAID] * 4


def naive_text(page, threshold):
    """The same by definition: a tree of a well-formed page, with a list of its text nodes, and sums made anew for each element."""
    import html.parser
    import math

    elements, nodes, stack = [(None, "", {}, "")], [], [0]

    class Reader(html.parser.HTMLParser):
        fresh, linked = True, 0

        def handle_starttag(self, tag, attrs):
            if tag in ("b", "a"):
                self.linked += tag == "a"
            elif tag == "br":
                self.handle_data(" ", False)
            elif tag not in ("meta", "link"):
                if tag == "p" and elements[stack[-1]][1] == "p":
                    stack.pop()
                up = stack[-1]
                attrs = dict(attrs)
                elements.append((up, tag, attrs, elements[up][3] + "/" + tag + ("." + attrs["class"].split()[0] if attrs.get("class") else "")))
                stack.append(len(elements) - 1)
                self.fresh = True

        def handle_endtag(self, tag):
            if tag in ("b", "a"):
                self.linked -= tag == "a"
            else:
                while elements[stack[-1]][1] != tag and any(elements[i][1] == tag for i in stack):
                    stack.pop()
                if elements[stack[-1]][1] == tag:
                    stack.pop()
                self.fresh = True

        def handle_data(self, data, begins=True):
            if any(elements[i][1] in ("script", "style", "title", "head") for i in stack) or self.fresh and (not data.strip() or not begins):
                return
            if self.fresh:
                nodes.append([stack[-1], "", 0])
                self.fresh = False
            nodes[-1][1] += data
            nodes[-1][2] += len(data.strip()) if self.linked else 0

    reader = Reader(convert_charrefs=True)
    reader.feed(page)
    reader.close()
    nodes = [(i, " ".join(t.split()), n) for i, t, n in nodes if t.strip()]
    above = lambda i: [] if i is None else [i, *above(elements[i][0])]
    path = [elements[i][3] for i, _, _ in nodes]
    mean = {p: [sum(f(n) for n, q in zip(nodes, path) if q == p) / path.count(p) for f in (lambda n: len(n[1]), lambda n: len(re.findall("[.,;:!?…、。，？！]", n[1])))] for p in path}
    x, y = ([math.log1p(mean[p][0] / 16) for p in path], [math.log1p(mean[p][1]) for p in path])

    def smooth(v):
        return [sum(w * v[j] for j, w in near) / sum(w for _, w in near) for i in range(len(v)) for near in [[(j, w) for j, w in ((i - 1, 0.25), (i, 0.5), (i + 1, 0.25)) if 0 <= j < len(v)]]]

    own = [math.sqrt((a + b) * (c + d)) for a, b, c, d in zip(x, y, smooth(x), smooth(y))]
    fused = {p: sum(v for v, q in zip(own, path) if q == p) / path.count(p) for p in path}
    links = {p for p in path if sum(n[2] for n, q in zip(nodes, path) if q == p) > 0.5 * sum(len(n[1]) for n, q in zip(nodes, path) if q == p)}
    part = lambda i: elements[i][1] in ("nav", "footer", "aside", "form")
    factor = [0.15 if any(part(j) or elements[j][2].get("class") == "ad" for j in above(i)) else 1.0 for i, _, _ in nodes]
    def median(v):
        return next((w for k, w in enumerate(sorted(v)) if sum(sorted(v)[: k + 1]) >= sum(sorted(v)) / 2 * (1 - 1e-12)), 0)

    middle = median([fused[p] * f for p, f in zip(path, factor) if p not in links])
    mass = lambda e: sum(fused[p] * f for (i, _, _), p, f in zip(nodes, path, factor) if e in above(i))
    held = lambda e: sum(e in above(i) for i, _, _ in nodes)
    (article,) = [i for i, x in enumerate(elements) if x[1] == "article"]
    if held(article) and (mass(article) >= 0.15 * mass(0) or mass(article) >= 2.5 * threshold * middle * held(article)):
        middle = median([fused[p] for (i, _, _), p in zip(nodes, path) if article in above(i) and p not in links])
        return "\n".join(t for (i, t, _), p in zip(nodes, path) if article in above(i) and 4 * fused[p] >= threshold * middle)
    region = 0
    while children := [i for i, x in enumerate(elements) if x[0] == region and mass(i) >= 0.8 * mass(region)]:
        region = children[0]
    below = lambda i: above(i)[: above(i).index(region)]
    rows = [(i, p, t) for (i, t, _), p in zip(nodes, path) if region in above(i) and not any(part(j) for j in below(i)) and p not in links]
    score = [fused[p] * (0.15 if any(elements[j][2].get("class") == "ad" for j in below(i)) else 1) for i, p, _ in rows]
    middle = median(score)
    kept = {p.rpartition("/")[0] for (i, p, _), v in zip(rows, score) if v >= threshold * middle}
    plain = lambda i, p: elements[i][1] == "h1" and p.rpartition("/")[0] in kept
    return "\n".join(t for (i, p, t), v in zip(rows, score) if v >= threshold * middle or plain(i, p))


def test_html_ratios_by_definition():
    """Every page of a larger table, at thresholds that keep and that drop, with names and without."""
    import duckdb

    pages = [x for (x,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()]
    small = [x for x in pages if len(x) < 6000]
    assert len(small) > 150
    seen = {t: [html_text.main_text(x, t) for x in small] for t in (0.2, 2.0, 6.0)}
    for t, texts in seen.items():
        assert texts == [naive_text(x, t) for x in small], t
    assert seen[0.2] != seen[2.0] != seen[6.0]


def test_html_pages_without_names(monkeypatch):
    """Names are weak: without any of them pages give the same."""
    import duckdb

    pages = [x for (x,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()]
    want = [html_text.main_text(x) for x in pages]
    for name in ("_NAME", "_CLEAR_NAME"):
        monkeypatch.setattr(html_text, name, re.compile("(?!)"))
    assert [html_text.main_text(x) for x in pages] == want


@pytest.mark.parametrize("page", [None, "", "<html></html>", "<script>x", "<p", "<!-- never ends", "<style>p{}</style>"])
def test_html_empty(page):
    assert html_text.main_text(page) == ""


def test_html_pages(spark, sf_dir):
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    inside = {r.page_id: re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1] for r in pages.collect()}
    for r in html_text.query(spark, sf_dir).collect():
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", inside[r.page_id])]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


# --- 3: n-gram Jaccard join


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE:
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def brute_components(texts, percent=80):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in texts}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def got_components(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(df).collect()}


def test_jaccard(docs, none):
    want = brute_components(texts_of())
    assert got_components(docs) == want and len({c for _, c in want.values()}) < len(want) - 5
    assert jaccard_join.components(none).count() == 0
    kept = {r.doc_id for r in jaccard_join.keep_one(docs).collect()}
    assert kept == {i for i, (_, c) in want.items() if c == i}


def test_jaccard_repeated_ids(spark):
    """Rows with one id keep the components of their own sets; rows without an id have none."""
    rng = random.Random(11)
    p, q = ([f"w{rng.randint(0, 10**6)}" for _ in range(100)] for _ in "pq")
    near = lambda w: " ".join([*w[:50], "changed", *w[51:]])
    data = [(5, " ".join(p)), (5, " ".join(q)), (7, near(p)), (9, near(q)), (3, near(q) + " more"), (None, near(p)), (5, " ".join(p)), (11, None)]
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_join.components(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect())
    assert got == [(0, 0), (3, 3), (5, 3), (5, 5), (5, 5), (7, 5), (9, 3), (11, 11)]


def test_jaccard_boilerplate(spark):
    """Many texts that share most of their words, but don't link; a few do."""
    rng = random.Random(12)
    shared = [f"b{rng.randint(0, 10**6)}" for _ in range(140)]
    texts = {i: " ".join(shared + [f"w{rng.randint(0, 10**9)}" for _ in range(60)]) for i in range(1500)}
    for i in range(0, 1500, 300):
        texts[2000 + i] = texts[i] + " more"
    got = got_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4))
    assert {i: c for i, (_, c) in got.items()} == {i: i - 2000 if i >= 2000 else i for i in texts}


def test_jaccard_chains_across_blocks(spark, monkeypatch):
    """Near copies of one text whose links form chains, with blocks so small that both phases work."""
    monkeypatch.setattr(jaccard_join, "_BLOCK_DOCS", 8)
    rng = random.Random(8)
    texts, now = {}, [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    for i in range(90):
        now = list(now)
        for _ in range(rng.choice((1, 1, 2, 5))):
            now[rng.randrange(len(now))] = f"x{rng.randint(0, 10**6)}"
        texts[i * 7 % 90] = " ".join(now)
    want = brute_components(texts)
    assert got_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")) == want
    assert 1 < len({c for _, c in want.values()}) < 60


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)]
    up = {v: v for e in edges for v in e}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.v: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for a, b in edges if a != b for v in (a, b)}


# --- 4: byte-level BPE


RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def reference_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_bpe(docs, none):
    e, texts = reference_encoding(), texts_of()
    got = {r.doc_id: r for r in bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in texts.items():
        ids = e.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    apart = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: r.decoded.decode() for r in apart} == {i: t or "" for i, t in texts.items()}
    assert bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_pieces():
    rng = random.Random(2)
    parts = ["a", "aa", "aaa", "b", "ab", "the", "th", "in", "er", " ", "  ", "\n", "\n\n", "=", "==", "é", "日本", "\t", "'s", "'ll", "123", "\x1c", " ", "😀", "ㅋㅋ", "..."]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(3000)] + ["a" * 4000, "=" * 999, " " * 500]
    e, coder = reference_encoding(), bpe.MergeReplay(RANKS, public_tokenizers.PATTERN)
    for t, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, np.uint32).tolist() == e.encode_ordinary(t), t
        assert coder.decode(ids).decode() == t
    for t in texts[:300]:
        assert coder._alone(t.encode()) == (np.concatenate([coder.replay([t.encode()])[0]]).tolist() if t else [])
    # the cut at spaces holds for the usual pattern alone
    other = r"\p{L}+ |\p{L}+|[^\p{L}]"
    tiktoken = __import__("tiktoken").Encoding("other", pat_str=other, mergeable_ranks=RANKS, special_tokens={})
    coder = bpe.MergeReplay(RANKS, other)
    for t, ids in zip(texts[:500], coder.encode(texts[:500]), strict=True):
        assert np.frombuffer(ids, np.uint32).tolist() == tiktoken.encode_ordinary(t), t


def test_token_pieces():
    """The same awkward texts by the tokenizers library."""
    from tokenizers import Tokenizer

    rng = random.Random(5)
    parts = ["a", "the", "in", " ", "  ", "\n", "\n\n", "=", "é", "日本", "\t", "'s", "123", "\x1c", "\0", "\xa0", "\u3000", "\u200b", "<|endoftext|>", "...", "x. y"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)] + [None, ""]
    coder, whole = token_files.Encoder(tokenizer(), public_tokenizers.PATTERN), Tokenizer.from_str(tokenizer())
    for a in range(0, len(texts), 700):
        ids, counts = coder.encode(texts[a : a + 700])
        for t, got in zip(texts[a : a + 700], np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert got.tolist() == whole.encode(t or "", add_special_tokens=False).ids, t


# --- 5: mixing


def test_mixing(docs, none):
    got = mixing.mix(docs).toPandas()
    texts = texts_of()
    assert {r.doc_id: r.size for r in got.itertuples()} == {i: len(words(t)) for i, t in texts.items()}
    assert ((got.taken == got["size"] * got.copies) & (got.copies <= 2)).all()
    got["source"] = got.source.fillna("￿")
    by = got.groupby("source").agg(size=("size", "sum"), said=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.said).all()
    # shares by water filling, one round after the other
    weights, left, target = dict(zip(sorted(by.index), [3, 1, 2, 3], strict=True)), 1.5 * by["size"].sum(), {}
    while True:
        free = [s for s in by.index if s not in target]
        level = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if level[s] > 2 * by["size"][s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * by["size"][s]
            left -= target[s]
    target |= level
    assert by.target.to_dict() == pytest.approx(target)
    # no document that isn't taken again is as small as what is missing or too much
    epochs, gap = (by.target // by["size"]).to_dict(), (by.target - by.taken).abs()
    for r in got[got["size"] > 0].itertuples():
        assert r.copies > epochs[r.source] or r.size > gap[r.source]
    again = mixing.mix(docs.repartition(5)).toPandas().sort_values("doc_id")
    assert again.taken.tolist() == got.sort_values("doc_id").taken.tolist()
    assert mixing.mix(none).count() == 0
    rows = mixing.mixed(docs).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict()
    assert rows == {r.doc_id: r.copies for r in got.itertuples() if r.copies}
    assert mixing.mixed(docs).columns == docs.columns


def test_mixing_repeated_ids_and_empty_sources(spark):
    df = spark.createDataFrame([(1, "a b c", "s")] * 3 + [(2, None, "t"), (None, "x y", "s")], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == 5 and len({r.copies for r in got if r.doc_id == 1}) == 1
    assert [r.taken for r in got if r.doc_id == 2] == [0] and [r.target for r in got if r.doc_id == 2] == [0.0]


# --- 6: sharding


def test_sharding(spark, docs, none):
    got = sharding.shard(docs, shards=4, bucket_rows=8).toPandas()
    texts = texts_of()
    assert sorted(got.doc_id) == sorted(texts)
    for r in got.itertuples():
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    counts = got.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and len(counts) == 4
    assert all(sorted(x.slot) == list(range(len(x))) for _, x in got.groupby("shard"))
    again = sharding.shard(docs.repartition(7), shards=4, bucket_rows=8).toPandas()
    assert rows(again) == rows(got)
    assert sharding.shard(none).count() == 0
    same = spark.createDataFrame([(1, "x")] * 40 + [(None, None)], "doc_id long, text string")
    assert sharding.shard(same, bucket_rows=4).groupBy("shard").count().agg(F.max("count") - F.min("count")).first()[0] <= 1


def test_sharding_moves_records(spark, tmp_path):
    """Rows of one id and rows without one keep their count and columns; buckets are bounded by bytes too."""
    rows = [(1, "same", "a")] * 5 + [(1, "other", "b"), (1, None, "c")] + [(None, "x", "d")] * 3 + [(i, f"{i} " * 40, "e") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name, given in (("a", docs), ("b", docs.repartition(5))):
        sharding.write_shards(given, str(tmp_path / name), shards=3, bucket_bytes=500)
    got, again = [sharding.read_shards(docs, str(tmp_path / n)).collect() for n in "ab"]
    assert sorted(map(repr, [(r.doc_id, r.text, r.source) for r in got])) == sorted(map(repr, rows))
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert sorted((r.shard, r.slot) for r in got) == sorted((i % 3, i // 3) for i in range(len(rows)))
    assert sorted(os.listdir(tmp_path / "a"))[-3:] == ["shard=0", "shard=1", "shard=2"]


def test_sharding_files(spark, docs):
    path = f"{shared_folder(spark)}/shards"
    sharding.write_shards(docs, path, shards=3)
    back = spark.read.parquet(path)
    assert back.count() == docs.count() and back.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).isEmpty()


def test_permutations_are_even(spark):
    got = spark.range(6000).select(sharding.fisher_yates("4", "xxhash64(id, i)").alias("p")).groupBy("p").count().collect()
    assert len(got) == 24 and all(sorted(r.p) == [0, 1, 2, 3] and 170 < r["count"] < 340 for r in got)


# --- 7: quality


def brute_counts(text):
    import re

    w = [x for x in re.split(r"[\x20\x09-\x0d]+", text or "") if x]
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dups += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + d for at in windows.values() if len(at) > 1 for i in at for d in range(3)}
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dups, len(covered))


def test_quality_counts(docs, none):
    for r in quality.score(docs, None).collect():
        base = brute_counts(texts_of()[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and r.kept == (not r.base_failed)
    assert quality.score(none, None).count() == 0


def test_quality_held_out(spark):
    """Labels that the classifier never saw, on tables with more of them."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    even, odd = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    model = quality.train(docs, even, sample_rows=1200)
    got = quality.score(docs.join(odd, "doc_id"), model).join(odd, "doc_id").filter("NOT base_failed").select("probability", "quality").toPandas()
    assert ((got.probability >= 0.5) == (got.quality == 1)).mean() > 0.98
    assert (got[got.quality == 1].probability >= 0.5).mean() > 0.99


def test_quality_features():
    """Pairs of words and 4-grams of characters, not bytes; A-Z count as lower case."""
    dims = lambda t: [set(x.tolist()) for x in quality.dimensions(quality.counts(t)[1], t)]
    a, b = dims("one two three"), dims("three two one")
    assert a[0] == b[0] and a[1] != b[1] and a[2] != b[2] and len(a[1]) == 2
    assert dims("日本語の")[2] == dims("日本語の")[2] and [len(x) for x in dims("日本語のé")] == [1, 0, 2]
    assert dims("ABCDe")[2] == dims("abcde")[2] and dims("abc")[2] == set() == dims("")[0]
    # in both words, pairs and characters the numbers of the families don't meet
    assert max(a[0]) < quality._DIMS <= min(a[1]) and max(a[1]) < 2 * quality._DIMS <= min(a[2])


def test_quality_conflicts(spark):
    """Documents labelled both ways aren't fitted on; repeated labels count once."""
    docs = spark.createDataFrame([(i, f"good words here {i} and there" if i % 2 else f"$$$ buy {i} now ###") for i in range(80)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(60)]
    clear, mixed = (quality.train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, [*labels, *labels[:9], *[(i, q) for i in range(60, 80) for q in (0, 1)]]))
    assert np.array_equal(clear.weights, mixed.weights)
    held = quality.score(docs, clear).filter("doc_id >= 60").collect()
    assert all((r.probability >= 0.5) == (r.doc_id % 2 == 1) for r in held)
    assert quality.keep(docs, spark.createDataFrame(labels, "doc_id long, quality int")).count() == quality.score(docs, clear).filter("kept").count()


def test_quality_without_labels(spark, docs):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(docs, empty) is None
    assert quality.train(docs, spark.createDataFrame([(9, 1), (10, None)], "doc_id long, quality int")) is None
    assert quality.keep(docs, empty).columns == docs.columns


# --- 8: WARC


def test_warc(spark):
    long = "<p>" + "same words, " * 30
    pages = [(3, "http://a", long), (1, "http://b\r\nX: y", long), (2, None, long), (4, "c", None), (5, "c", ""), (6, "d", "tiny"), (7, "d", "tiny"), (None, "e", long), (8, "ü", "é" * 70_000)]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, digest string, size string").repartition(2)
    manifest = warc.write(df, f"{shared_folder(spark)}/warc", archive_bytes=1000)
    assert manifest.agg(F.sum("n_records")).first()[0] == len(pages) and manifest.count() > 1
    got = {r.page_id: r for r in warc.read(manifest).collect()}
    for page_id, _, html in pages:
        data = (html or "").encode()
        r = got[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        first = 1 if html == long and page_id != 1 else None
        assert (r.record_type, r.refers_to) == ("revisit" if first else "response", first)
        assert r.payload == (None if first else data)
    assert got[1].url == "http://b X: y"
    empty = warc.write(df.limit(0), f"{shared_folder(spark)}/warc")
    assert warc.read(empty).count() == 0


def test_warc_dictionary():
    import io
    import struct

    records = [warc.record("response", [("N", str(i))], f"<html><body class='page'><p>Words number {i} and {i * i}</p>".encode() * 3) for i in range(400)]
    parts = warc.archive(records)
    assert struct.unpack("<I", parts[0][:4])[0] == 0x184D2A5D and len(parts) == len(records) + 1
    assert [f["N"] for _, f, _ in warc.records(io.BytesIO(b"".join(parts)))] == [str(i) for i in range(400)]


# --- 9: nearest neighbours


def test_ann(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((700, 16)).astype(np.float32)
    v[100:160] = v[100]
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(800, None), (900, [0.0] * 16), (1000, [float("nan")] + [1.0] * 15), (1100, [None] * 16), (1200, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame([(*d, 1) for d in data], "vec_id long, embedding array<float>, label int")
    got = ann.nearest(df, recall=1.0).toPandas()
    hits, d64 = 0, v.astype(float)
    for q in range(0, 700, 100):
        d = np.sqrt(((d64 - d64[q]) ** 2).sum(1))
        d[q] = np.inf
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        assert mine.score.tolist() == pytest.approx(d[mine.vec_id].tolist(), rel=1e-14)
        assert list(zip(mine.score, mine.vec_id, strict=True)) == sorted(zip(mine.score, mine.vec_id, strict=True))
        hits += len(set(mine.vec_id) & set(np.lexsort((np.arange(700), d))[:10].tolist()))
    assert hits / 70 >= 0.9 and set(got.query_id) == set(range(0, 700, 100))
    assert got[got.query_id == 100].vec_id.tolist() == list(range(101, 111))
    assert ann.nearest(df.limit(0)).count() == 0
    few = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 1)]


def test_ann_far_and_close(spark):
    """Clusters open few leaves; distances beyond doubles are infinite; repeated ids and extra columns."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((60, 16)) * 20
    v = (centres[rng.integers(0, 60, 6000)] + rng.standard_normal((6000, 16))).astype(np.float32)
    sample = v.astype(float)
    forest = [ann.Tree(sample[:3000], 16, i) for i in range(8)]
    assert 10 < ann.enough_for(forest, sample[3000:], 5, 0.96) < 6000
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, score int")
    got = ann.nearest(df).toPandas()
    hits = 0
    for q in range(0, 6000, 100):
        d = np.sqrt(((sample - sample[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(got[got.query_id == q].vec_id) & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits / 600 >= 0.9
    far = [(0, [1e200, 1.0]), (1, [-1e200, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 2.0]), (100, [1.0, 1.5])]
    got = ann.nearest(spark.createDataFrame(far, "vec_id long, embedding array<double>"), recall=1.0).collect()
    assert [(r.rank, r.vec_id, r.score) for r in got if r.query_id == 0] == [(1, 1, np.inf), (2, 2, np.inf), (3, 100, np.inf)]
    assert [(r.rank, r.vec_id, r.score) for r in got if r.query_id == 100] == [(1, 1, 0.5), (2, 2, 0.5), (3, 0, np.inf)]


def test_ann_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.nearest(vectors).toPandas()
    t = vectors.orderBy("vec_id").toPandas()
    v, ids, hits, n = np.array(t.embedding.tolist(), float), t.vec_id.to_numpy(), 0, 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits += len(set(got[got.query_id == q].vec_id) & set(ids[np.lexsort((ids, d))[:10]].tolist()))
        n += 10
    assert hits / n >= 0.9


# --- 10: token files


def tokenizer():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.mark.parametrize("pattern", [public_tokenizers.PATTERN, None])
def test_token_files(spark, docs, pattern):
    from tokenizers import Tokenizer

    coder, at = Tokenizer.from_str(tokenizer()), 0
    extra = spark.createDataFrame([(1000, "a <|endoftext|> b\n\n c  d", *["x"] * 2, 0, *["x"] * 4)], SCHEMA)
    manifest = token_files.write(docs.unionByName(extra), f"{shared_folder(spark)}/ids", tokenizer(), pattern, file_ids=5000)
    got = {r.doc_id: r for r in token_files.read(manifest, with_ids=True).collect()}
    texts = texts_of() | {1000: "a <|endoftext|> b\n\n c  d"}
    for i in sorted(texts):
        ids = np.array([*coder.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32, got[i].ids) == (at, len(ids) // 4, zlib.crc32(ids), ids)
        at += len(ids) // 4
    assert manifest.count() > 1
    empty = token_files.write(docs.limit(0), f"{shared_folder(spark)}/ids", tokenizer())
    assert token_files.read(empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 50, 20_000])
def test_repair(n):
    rng = np.random.default_rng(n)
    ids = np.tile(rng.integers(0, 40, max(1, n // 4)), 5)[:n]
    seq, rules, lengths = token_files.repair(ids, 50_258)
    assert token_files.expand(seq, rules, lengths, 50_258).tolist() == ids.tolist()
    if n == 20_000:
        assert len(seq) < 0.8 * n
    file = token_files.TokenFile(b"".join(token_files.pack([1, None], [n, 0], ids, 50_258)))
    assert file.doc_ids == [1, None] and file.n_ids == n
    for a, b in [(0, n), (n // 3, n // 2), (n // 2, n // 2), (max(0, n - 1), n)]:
        assert file.span(a, b).tolist() == ids[a:b].tolist()


def test_repair_goes_on():
    """Any vocabulary, runs of one id, and pairs of one head get rules, until no pair stands 8 times."""
    rng = np.random.default_rng(20_000)
    told = np.tile(rng.integers(0, 40, 5000), 5)[:20_000]
    for symbols in (50_258, 70_000, 1 << 24):
        ids = np.concatenate([told, np.full(5000, symbols - 1), told + symbols - 50])
        seq, rules, lengths = token_files.repair(ids, symbols)
        assert token_files.expand(seq, rules, lengths, symbols).tolist() == ids.tolist() and len(lengths) == len(rules)
        assert len(seq) < 0.7 * len(ids) and max(np.bincount(np.unique(rules[:, 0], return_inverse=True)[1])) > 1
        left = {}
        for i, pair in enumerate(zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True)):
            if left.get(pair, (0, -2))[1] != i - 1:
                left[pair] = (left.get(pair, (0, -2))[0] + 1, i)
        assert max(n for n, _ in left.values()) < 8
        file = token_files.TokenFile(b"".join(token_files.pack([1], [len(ids)], ids, symbols)))
        assert file.span(19_000, 26_000).tolist() == ids[19_000:26_000].tolist()
    assert len(token_files.repair(np.full(4096, 7), 50_258)[0]) < 16
    assert len(token_files.repair(told, 50_258)[0]) < 0.7 * len(told)
