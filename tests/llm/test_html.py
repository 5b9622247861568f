import random
import time

import numpy as np
import pytest
from parlance.llm import html_text


def text_of(spark, *pages):
    rows = [(i, url, html) for i, (url, html) in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


CASES = [
    ("<nav>menu</nav><article><h1>T</h1><p>a  b\n c</p><p>d&amp;e &eacute;&#8364;</p></article><footer>f</footer>", "T a b c d&e é€"),
    ("<article><p><b>one<br><p>two</article>after", "one two"),
    ("<article>x<script>var a='</p>';</script><style>p{}</style><!-- c -->y</article>", "xy"),
    ("<article><header><h1>In</h1></header><div class='comments'>reader</div><form>f</form><aside>s</aside><p>body</p></article>", "In body"),
    ("<div role=main><p>m</p><div class=\"ad\">buy</div></div><div class='notice'>n</div>", "m"),
    ("<article><p>x &lt;b&gt; y</p><ul><li>1</li><li>2</li></ul><table><tr><td>c</td><td>d</td></tr></table></article>", "x <b> y 1 2 c d"),
    ("<article>w<em>o</em>rd</article>", "word"),
    ("", ""),
    (None, ""),
    ("<nav>only menu", ""),
    ("<article><p>never closed <!-- nor this", "never closed"),
    ("plain text", "plain text"),
    ("<article><p hidden>h</p><p style='display: none'>i</p><p>v</p></article>", "v"),
    ("<ARTICLE><P>Up</P></ARTICLE>", "Up"),
    ("<article>a<![CDATA[b]]>c</article>", "abc"),
]


@pytest.mark.parametrize(("html", "expected"), CASES)
def test_structure(spark, html, expected):
    found = html_text.blocks(html)
    main = [t for inside, t in found if inside]
    assert " ".join(main or [t for _, t in found]) == expected


def test_contract(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = html_text.main_text(pages).collect()
    assert len(rows) == pages.count() and all(r["n_chars"] == len(r["text"]) > 0 for r in rows)
    by = {r["page_id"]: r["text"] for r in rows}
    import html
    import re

    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        plain = [" ".join(html.unescape(re.sub(r"<b>|</b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", body)]
        assert by[r["page_id"]] == " ".join(x for x in plain if x)


def brute_cover(streams, least):
    where = {}
    for k, s in enumerate(streams):
        for i in range(len(s) - least + 1):
            where.setdefault(tuple(s[i : i + least]), set()).add(k)
    out = [np.zeros(len(s), bool) for s in streams]
    for k, s in enumerate(streams):
        for i in range(len(s) - least + 1):
            if len(where[tuple(s[i : i + least])]) > 1:
                out[k][i : i + least] = True
    return out


def test_suffix_array_covers_what_windows_cover():
    r = random.Random(7)
    for least in (2, 4, 8):
        shared = [r.choice("abcdef") for _ in range(30)]
        streams = [[r.choice("abcdefgh") for _ in range(r.randrange(0, 40))] + shared[: r.randrange(0, 30)] for _ in range(12)]
        got = html_text.covered(streams, least)
        assert all((g[: len(s)] == e).all() for g, s, e in zip(got, streams, brute_cover(streams, least), strict=True))
    tokens = np.array([2, 1, 2, 1, 2, 9, 1])
    order, lcp = html_text.suffix_array(tokens)
    assert order.tolist() == sorted(range(7), key=lambda i: tokens[i:].tolist())
    for a, b, n in zip(order, order[1:], lcp[1:], strict=False):
        x, y = tokens[a:].tolist(), tokens[b:].tolist()
        assert n == next((k for k, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))


def open_pages():
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    banner = " ".join(r.choices(words, k=20))
    rows = []
    for i in range(30):
        own = " ".join(r.choices(words, k=r.randrange(0, 60)))
        rows.append((f"http://h{i % 2}.example/{i}", f"<div>{banner}</div><div>{own}</div><div>{banner if i % 3 else ''}</div>"))
    return rows


def test_open_pages_lose_what_their_host_repeats(spark):
    pages = open_pages()
    got = text_of(spark, *pages)
    for host in range(2):
        ids = [i for i in range(len(pages)) if i % 2 == host]
        streams = [" ".join(t for _, t in html_text.blocks(pages[i][1])).split() for i in ids]
        for i, s, c in zip(ids, streams, brute_cover(streams, html_text.MIN_TOKENS), strict=True):
            assert got[i] == " ".join(t for t, x in zip(s, c, strict=True) if not x)


def test_a_large_host_gives_the_same(spark):
    rows = [(i, u, h) for i, (u, h) in enumerate(open_pages())]
    read = html_text.parsed(spark.createDataFrame(rows, "page_id long, url string, html string")).where("n_tokens > 0")
    small = {r["page_id"]: r["text"] for r in html_text.unique_runs(read).collect()}
    large = {r["page_id"]: r["text"] for r in html_text.unique_runs(read, host_tokens=0).collect()}
    assert small == large


def test_edges(spark):
    schema = "page_id long, url string, html string, text string, host string"
    rows = [(1, None, None, "x", "y"), (None, "u", "", "x", "y"), (2, "http://a/", "<article>z</article>", "x", "y"), (2, "http://a/", "<article>z</article>", "x", "y"), (3, "bad url", "<p>" * 20_000 + "deep", "x", "y"), (4, "http://a/", "a" * 500_000, "x", "y")]
    got = sorted(((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in html_text.main_text(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (0, "u", "", 0), (2, "http://a/", "z", 1), (2, "http://a/", "z", 1), (3, "bad url", "deep", 4), (4, "http://a/", "a" * 500_000, 500_000)], key=str)
    assert html_text.main_text(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("host_tokens", [html_text.HOST_TOKENS, 0])
def test_repeated_rows_and_mirrors_keep_their_text(spark, host_tokens):
    common = "this line stands on each page of the host"
    texts = [(1, "a b c d e f g h i j " + common), (1, "a b c d e f g h i j " + common), (2, "a b c d e f g h i j " + common), (3, "k l m " + common)]
    rows = [(i, "http://h/", "h", t, len(t.split())) for i, t in texts]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, text string, n_tokens long")
    got = sorted((r["page_id"], r["text"]) for r in html_text.unique_runs(pages, host_tokens=host_tokens).collect())
    assert got == [(1, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (2, "a b c d e f g h i j"), (3, "k l m")]


@pytest.mark.parametrize("page", ["<b>x" * 200_000 + "</i>" * 200_000, "<span>" * 100_000 + "<p>y" * 100_000, "<div>" * 100_000 + "z" + "</div>" * 100_000, "<b>" * 100_000 + "</b>" * 100_000, "<li>w" * 200_000])
def test_nested_pages_of_a_megabyte_take_seconds(page):
    began = time.time()
    assert html_text.blocks(page) or "<b>" in page
    assert time.time() - began < 20
