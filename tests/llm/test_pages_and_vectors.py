"""Page text, WARC records and nearest neighbours: expected results, round trips and brute force."""

import base64
import hashlib
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import ann, html, warc

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site, all of them, always.</div>
<article><header><h1>Head&shy;line</h1></header><p>First &eacute;t&eacute;  <b>bold</b>er&nbsp;text<br>next<p>Unclosed
<div class="ad">Buy this</div><aside>See also</aside><ul><li>one<li>two</ul><form>Name <input></form><p>Fin.</p>
<section id="comments"><p>Nice post, very long comment indeed, thank you so much for this.</p></section></article><footer>&copy; 2020</footer></body></html>"""
SOUP = """<div class=menu><a href=/>Home</a> | <a href=/n>News</a></div><div id=content><h1>A headline here</h1><p>The first paragraph of this article is long enough to surge, with many words.
<p>Short.<p>And another long paragraph that keeps the sums above zero until the end of it.</div><div class="comments">I disagree with all that was said in here, entirely.</div><div>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, "Head\xadline First été bolder text next Unclosed one two Fin."),
        (SOUP, "A headline here The first paragraph of this article is long enough to surge, with many words. Short. And another long paragraph that keeps the sums above zero until the end of it."),
        ("<article>x</article>", "x"),
        ('<div class="content"><p>tease</p><main><h1>M</h1><article>deep</article></main></div>', "deep"),
        ('<p>We use cookies here and there and everywhere, for all of it, yes.</p><div id="mainContent"><h1>Y</h1><p>z</p><div class="userComments">no</div></div>', "Y z"),
        ("<main><p>Tiny.</main>", "Tiny."),
        ("<p>just &lt;one&gt; &#x41;&amp;amp; para", "just <one> A&amp; para"),
        ("plain text without markup", "plain text without markup"),
        ("<article><p>a < b and 1<2 <p>c</article>", "a < b and 1<2 c"),
        ("<!-- only --><script>x</script>", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_extraction_of_rows(spark):
    long = "<article>" + "<p>word </p>" * 30_000 + "</article>"
    rows = [(1, "u", PAGE, 9), (2, None, None, 9), (None, "v", "", 9), (4, "w", long, 9), (1, "u", PAGE, 9)]
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(out) == 5 and out[0] == out[4] and out[1].text == "" and out[3].n_chars == 5 * 30_000 - 1
    assert all(r.n_chars == len(r.text) for r in out)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_surges_and_dives_without_a_marked_article():
    lines = [html.Line("menu", 0, 0, 0)] * 4 + [html.Line("x" * 80, 80, 0, 0), html.Line("short", 5, 0, 0)] + [html.Line("l", 0, 0, 0)] * 5
    assert [x.text for x in html.kept(lines)] == ["x" * 80, "short"]


LONG = "This paragraph stands outside of the marked article and goes on for so long that it must belong to the text. " * 7


@pytest.mark.parametrize(
    ("page", "text"),
    [  # marks alone would keep the article element only, or everything
        (f"<div>Home page</div><article><p>A marked teaser.</p></article><div><p>{LONG}</p><p>Short end.</p></div><div>Imprint</div>", f"A marked teaser. {LONG}Short end. Imprint"),
        ("<article><p>A marked text.</p></article><p>One short line beside it.</p>", "A marked text."),
        ("<article><h2><a href=/x>A headline that is a link</a></h2><p>Text.</p><div class=ad>Buy</div><form>f</form><aside>s</aside><nav>n</nav><p>Fin.</p></article>", "A headline that is a link Text. Fin."),
        (f"<p><a href=/>Home</a></p><p><a href=/n>News</a></p><p>{LONG}</p><p><a href=/m>A linked line</a></p><p>End.</p>" + "<p><a href=/o>Other</a></p>" * 4, f"{LONG}A linked line End."),
    ],
)
def test_the_distribution_decides_the_span(page, text):
    assert html.main_text(page) == text


def plain_page(seed: int) -> tuple[str, str]:
    """A page of divisions without any telling name: menus of links, a text, short notes and links at the end."""
    rng = np.random.default_rng(seed)
    line = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(n))
    link = lambda: f"<div class=x{rng.integers(9)}><a href=/{rng.integers(99)}>{line(3)}</a></div>"
    title, body = line(6), [line(int(rng.integers(14, 60))) for _ in range(rng.integers(2, 7))]
    body.insert(1, line(2))  # a short line in the middle
    wrap = lambda x: f"<p>{x}</p>" if seed % 2 else f"<div class=q>{x}</div>"
    top, end = "".join(link() for _ in range(rng.integers(3, 9))), "".join(link() for _ in range(rng.integers(3, 9)))
    return f"<body><div>{top}</div><h1>{title} {line(8)}</h1>" + "".join(wrap(x) for x in body) + f"<div>{end}</div></body>", " ".join(body)


@pytest.mark.parametrize("seed", range(20))
def test_pages_without_telling_names(seed):
    page, body = plain_page(seed)
    got = html.main_text(page)
    assert got.endswith(body) and len(got) < len(body) + 120  # the headline besides, no link


def test_names_in_doubt_are_weights():
    long, short = "A real paragraph of the article that happens to bear a name in doubt and goes on for a good while longer. " * 2, "See all of these."
    page = lambda name, text: f"<article><p>{LONG}</p><div class={name}>{text}</div><p>Fin.</p></article>"
    for name in ("side", "legal", "search", "related", "skip"):
        assert html.main_text(page(name, long)) == f"{LONG}{long}Fin." and html.main_text(page(name, short)) == f"{LONG}Fin."
    for name in ("notice", "comments", "ad", "sidebar"):
        assert html.main_text(page(name, long)) == f"{LONG}Fin."
    # A negative line is a dive: what follows has to surge by itself on a page without marks.
    assert html.main_text(f"<p>{LONG}</p><div class=ad>Buy</div><p>Short.</p>") == LONG.strip()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the given tables are not here")
def test_the_window_decides_lines_of_the_given_pages(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    dropped = plain = 0
    for page in pages:
        found = html.lines(page)
        kept = {id(x) for x in html.kept(found)}
        dropped += sum(id(x) not in kept for x in found)
        plain += sum(id(x) not in kept and not x.cost for x in found)
    assert dropped > len(pages) and plain >= 0  # lines are no longer taken out before the distribution sees them


def digest(b):
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_warc_derivatives_and_round_trip(spark):
    rows = [(1, "http://a.example/x/", PAGE, 0), (2, None, None, 0), (None, "http://b.example/?q=a\r\nb", "é\r\n\r\nWARC/1.1\r\n", 0), (3, "http://[bad", "<a href='http://[x'>t</a>", 0), (1, "http://a.example/x/", PAGE, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, headers int")
    source = warc.responses(pages)
    made = warc.derivatives(source)
    out = made.collect()
    assert len(out) == 10
    by = {}
    for r in out:
        by.setdefault(r.refers_to, {})[r.warc_type] = r
    sources = {r.record_id: r for r in source.collect()}
    assert len(sources) == 4 and set(by) == set(sources)
    for ref, pair in by.items():
        s = sources[ref]
        status, head, body = warc.split_http(bytes(s.block))
        assert status == "HTTP/1.1 200 OK" and int(head["Content-Length"]) == len(body)
        for r in pair.values():
            data = r.content.encode()
            assert (r.block_digest, r.content_length) == (digest(data), len(data))
            assert r.source_headers == s.headers and r.source_block_digest == digest(bytes(s.block)) and r.source_payload_digest == digest(body)
            assert r.target_uri == s.target_uri and r.warc_date == s.warc_date
        meta = json.loads(pair["metadata"].content)
        assert meta["conversion"] == pair["conversion"].record_id and meta["envelope"]["headers"] == s.headers
    first = next(p for p in by.values() if p["metadata"].page_id == 1)
    meta = json.loads(first["metadata"].content)
    assert meta["html"]["title"] == "T & x" and meta["html"]["lang"] == "en" and {"path": "a@href", "url": "http://a.example/a"} in meta["html"]["links"]
    assert first["conversion"].content.startswith("T & x\n") and "var t" not in first["conversion"].content
    for df, column in ((source, "block"), (made, "content")):
        stored = warc.serialized(df).collect()
        parsed = list(warc.parse(b"".join(bytes(r.record) for r in stored)))
        assert len(parsed) == len(stored)
        for (headers, block), r in zip(parsed, stored):
            assert headers["WARC-Record-ID"] == r.record_id and block == (bytes(r.block) if column == "block" else r.content.encode())
            assert headers == {k: " ".join(v.split()) for k, v in r.headers.items()}
    assert warc.derivatives(source.where("false")).count() == 0


def brute(rows, k=10, every=100):
    out = []
    for q, v in rows:
        if q % every:
            continue
        near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))), i) for i, w in rows if i != q)[:k]
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return out


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 300)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 4)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1200, 24)).astype(np.float32)
    x[300:700] = x[5]  # one very common vector
    x[800:830] = x[100:130] + 1e-4
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    odd = [(None, [1.0] * 24), (5000, None), (5100, [0.0] * 24), (5200, [float("nan")] + [1.0] * 23), (5300, [float("inf")] + [1.0] * 23), (5400, [None] + [1.0] * 23), (5500, [1.0, 2.0]), rows[0], rows[0]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("v", F.lit(2))
    for c in ("query_id", "rank", "score", "block", "asked", "bits"):  # named like what the search adds
        df = df.withColumn(c, F.lit("mine"))
    df = df.repartition(5)
    got = [tuple(r) for r in ann.search(df).orderBy("query_id", "rank").select("query_id", "rank", "vec_id", "score").collect()]
    want = brute(rows)
    assert len(got) == len(want) == 120
    hits = len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want})
    assert hits >= 0.99 * len(want)
    truth = {(q, i): d for q, _, i, d in want}
    assert all(abs(d - truth[q, i]) < 1e-12 for q, _, i, d in got if (q, i) in truth)
    common = [g for g in got if g[0] == 300]
    assert [g[2] for g in common] == [5, 301, 302, 303, 304, 305, 306, 307, 308, 309] and all(g[3] == 0 for g in common)


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.search(spark.createDataFrame([], schema)).count() == 0
    two = ann.search(spark.createDataFrame([(0, [1.0, 2.0]), (100, [1.0, 3.0]), (7, [4.0, 6.0])], schema)).orderBy("query_id", "rank").collect()
    assert [tuple(r)[:3] for r in two] == [(0, 1, 100), (0, 2, 7), (100, 1, 0), (100, 2, 7)] and two[1].score == 5.0


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((4000, 64)), rng.standard_normal((20, 64))
    centers, turn = ann.centroids(x[:500], 8, 1), ann.rotation(64, 1)
    middle, lower = ann.bounds(ann.encode(x, centers, turn), q, centers, turn, 3.0)
    true = ((q[:, None] - x[None]) ** 2).sum(-1)
    assert abs((middle - true).mean()) < 0.5 and (lower > true).mean() < 0.005
    assert np.allclose(turn @ turn.T, np.eye(64))


def test_a_very_long_page_has_its_whole_text_in_its_records(spark):
    page = "<article>" + "<p>some words of a long page</p>" * 60_000 + "</article>"
    made = warc.derivatives(warc.responses(spark.createDataFrame([(1, "http://a.example/", page)], "page_id long, url string, html string"))).collect()
    text = next(r.content for r in made if r.content.startswith("some words"))
    assert len(page) > 1 << 20 and len(text.split()) == 6 * 60_000
