"""Main text of pages: the markup, repeats against brute force, shards, and every row of the table."""

from __future__ import annotations

import html
import re

import duckdb
import numpy as np
import pytest

from panelweave.llm import main_text
from panelweave.llm.html_blocks import blocks
from panelweave.llm.queries import QUERIES

SCHEMA = "page_id bigint, url string, html string, host string, k1 string, stream string, runs string"


def content(page):
    return " ".join(b.text for b in blocks(page) if b.content)


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""),
        ("<article>a<b>b</b> c<p>d &amp; e&lt;p&gt;</article>", "ab c d & e<p>"),
        ("<article><h1>T</h1><p><b>open<br><p>next \t\n line</p></article>after", "T open next line"),
        ("<ARTICLE CLASS='x'>up</ARTICLE>", "up"),
        ("<article>x<script>var t='</p><article>';</script>y<style>p{}</style>z</article>", "xyz"),
        ("<article>x<!-- <p>no</p> -->y<!-->z</article>", "xyz"),
        ("<article>a <nav>no</nav>b<aside><p>no</aside>c<form>no<input value='>'></form>d</article>", "a b c d"),
        ("<article>a<div class='ad-box'><div>no</div>no</div>b<div id=comments>no</div></article>", "a b"),
        ("<article>a</article><article class=comment>no</article><footer><article>no</article></footer>", "a"),
        ("<main>m<p>n</main>out", "m n"),
        ("<main>side<article>a</article></main>", "a"),
        ("<div role=main>m</div>", "m"),
        ("<body class='has-sidebar'><article class='with-sidebar'>a</article>", "a"),
        ("<article>1 < 2 & 3 > 2 <3 </ x>y &am &amp &#x41;&nbsp;z", "1 < 2 & 3 > 2 <3 y &am & A z"),
        ("<article>a<p title=\"x > y\" data-q='>'>b<p title=it's>c", "a b c"),
        ("<article><ul><li class=menu>no<li>yes</ul><table><tr><td>a<td>b</table>", "yes a b"),
        ("<head><title>no</title><article>a</article>", "a"),
        ("<article>cut in a tag <a href='x", "cut in a tag"),
        ("<article>é\x0b\x1c　ü</article>", "é ü"),
        ("<nav><article>never closed", ""),
    ],
)
def test_markup(page, want):
    assert content(page) == want


def brute_repeats(streams, least):
    """Positions covered by a string of ``least`` tokens that another page has too."""
    tokens = [[t for t, _, _ in main_text.stream_tokens(s)] for s in streams]
    seen = {}
    for p, told in enumerate(tokens):
        for i in range(len(told) - least + 1):
            seen.setdefault(tuple(told[i : i + least]), set()).add(p)
    out = []
    for told in tokens:
        gone = set()
        for i in range(len(told) - least + 1):
            if len(seen[tuple(told[i : i + least])]) > 1:
                gone.update(range(i, i + least))
        out.append(gone)
    return out


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n, letters in [(0, 1), (1, 1), (2, 1), (60, 2), (300, 3), (40, 1)]:
        ids = rng.integers(0, letters, n)
        order, common = main_text.suffix_array(ids)
        suffixes = sorted(range(n), key=lambda i: ids[i:].tolist())
        assert order.tolist() == suffixes
        for a, b, c in zip(order, order[1:], common):
            k = 0
            while max(a, b) + k < n and ids[a + k] == ids[b + k]:
                k += 1
            assert c == k


def made(n, hosts):
    """Pages of plain divs: a template, a shared notice, text of their own."""
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    pages = []
    for i in range(n):
        own = " ".join(rng.choice(words, rng.integers(1, 40)))
        quoted = " ".join(words[:12]) if i % 3 == 0 else ""
        h = hosts[i % len(hosts)]
        pages.append((i, f"http://{h}/p/{i}", f"<div>home news all about the weather of {h} today</div><p>{own} {quoted}</p><div>all rights are reserved by the owners of {h}</div>"))
    return pages


def expected(pages, least):
    """Unique runs by brute force, over distinct html of a host."""
    out = {}
    for h in {re.sub(r"https?://([^/]*).*", r"\1", u or "") for _, u, _ in pages}:
        mine = sorted({x or "" for _, u, x in pages if re.sub(r"https?://([^/]*).*", r"\1", u or "") == h})
        streams = [main_text.outer_stream(x) for x in mine]
        for x, s, gone in zip(mine, streams, brute_repeats(streams, least)):
            parts = [(i, b.text) for i, b in enumerate(blocks(x)) if b.content]
            last = None
            for k, (t, block, marked) in enumerate(main_text.stream_tokens(s)):
                if block < 0 or marked or k in gone:
                    last = None
                elif last == block:
                    parts[-1] = (block, parts[-1][1] + " " + t)
                else:
                    parts.append((block, t))
                    last = block
            out[h, x] = " ".join(t for _, t in sorted(parts, key=lambda p: p[0]))
    return out


@pytest.mark.parametrize("shard_tokens", [1 << 15, 200, 40])
def test_repeats_equal_brute_force_for_any_shard(spark, shard_tokens):
    pages = made(90, ["hot.org", "hot.org", "hot.org", "b.org", "c.org:80"])
    pages += [(500, "http://b.org/copy", pages[3][2]), (None, None, None), (None, None, "<p>alone")]
    df = spark.createDataFrame([(*p, *["clash"] * 4) for p in pages], SCHEMA)
    got = {(r["page_id"], r["url"], r["n_chars"]): r["text"] for r in main_text.extract(df, 8, shard_tokens).collect()}
    want = expected([(i, (u or "").replace(":80", ""), x) for i, u, x in pages], 8)
    assert len(got) == len(pages)
    for i, u, x in pages:
        h = re.sub(r"https?://([^/:]*).*", r"\1", u or "")
        text = want[h, x or ""]
        assert got[i, u, len(text)] == text
    assert sum("rights are reserved" in t for t in got.values()) == 0


def test_without_the_arrays_the_template_stays(spark):
    df = spark.createDataFrame([(*p, *["x"] * 4) for p in made(20, ["a.org"])], SCHEMA)
    off = main_text.extract(df, least=10_000).collect()
    on = main_text.extract(df).collect()
    assert all("rights are reserved" in r["text"] for r in off) and not any("rights are reserved" in r["text"] for r in on)


def test_declared_text_is_kept_however_often_it_is_repeated(spark):
    page = "<nav><a>one</a></nav><article>" + "the same words again and again " * 20 + "</article><footer>{}</footer>"
    df = spark.createDataFrame([(i, "http://a.org/", page.format(i), *["x"] * 4) for i in range(9)], SCHEMA)
    assert {r["text"] for r in main_text.extract(df).collect()} == {("the same words again and again " * 20).strip()}


def test_very_long_and_empty(spark):
    long = "<article>" + "word " * 400_000 + "</article>" + "<b " * 2000
    df = spark.createDataFrame([(1, "u", long, *["x"] * 4), (2, "u", "", *["x"] * 4)], SCHEMA)
    got = {r["page_id"]: r for r in main_text.extract(df).collect()}
    assert got[1]["n_chars"] == 400_000 * 5 - 1 and got[2]["text"] == "" and got[2]["n_chars"] == 0
    assert main_text.extract(df.limit(0)).collect() == []


def test_every_page_of_the_table(spark, sf_dir):
    """The template of these pages is known: the article, its tags taken out by hand."""
    pages = duckdb.sql(f"SELECT page_id, html FROM '{sf_dir}/pages.parquet'").fetchall()
    want = {i: " ".join(" ".join(html.unescape(t) for t in re.split(r"</?(?:p|h1|br|b)>", re.search("<article>(.*)</article>", x, re.S)[1])).split()) for i, x in pages}
    got = QUERIES["op11_main_text"](spark, sf_dir).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_more_pages_than_words(spark):
    """A large host of which all pages say the same in a few words."""
    pages = [(i, f"http://a.org/{i}", f"<div>one two three four five six seven eight</div><p>p{i % 3} {'x ' * (i % 50)}") for i in range(300)]
    df = spark.createDataFrame([(*p, *["x"] * 4) for p in pages], SCHEMA)
    got = {r["page_id"]: r["text"] for r in main_text.extract(df, 8, 500).collect()}
    want = expected(pages, 8)
    assert all(got[i] == want["a.org", x] for i, _, x in pages)
