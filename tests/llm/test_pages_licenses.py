"""HTML extraction by host suffix arrays, and license scans."""

from __future__ import annotations

import html
import random
import re
from collections import Counter

import numpy as np

from revcast.llm import host_suffix, license_scan
from revcast.llm.html_blocks import ARTICLE, FRAME, OPEN, blocks
from revcast.llm.license_texts import NOTICES
from tests.llm.helpers import awkward, empty, prose

PAGES = "page_id long, url string, html string, key string, host string, text string"


def page(rng, body: str, template: str) -> str:
    return f"<html><head><title>t</title><style>p{{}}</style></head><body><div>{template}</div>{body}<div>{template}</div></body></html>"


def test_blocks_of_a_rich_page():
    source = """<!DOCTYPE html><html><head><title>No</title><script>if (a<b) {x = "</p>"}</script></head><body class="home">
      <header>Site</header><div id="cookie-notice">We use cookies</div><nav><a>Home</a></nav>
      <article class="post"><header><h1>Head&nbsp;line &lt;x&gt;</h1></header><p>One <b>two</b>
      three<br>four<span class="ad">Buy</span> five<p>six &amp seven<ul><li>a<li>b</ul>
      <form><input value="q">Search</form><section id="comments"><p>nice post</p></section><footer>tags</footer></article>
      <aside>side</aside><div style="display: none">hidden</div><footer>&copy; me</footer><p>cut o"""
    got = [b.text for b in blocks(source) if b.place == ARTICLE]
    assert got == ["Head line <x>", "One two three", "four", "five", "six & seven", "a", "b"]
    assert {b.place for b in blocks(source) if b.text in ("Site", "Home", "side", "nice post", "We use cookies", "hidden", "cut o")} == {FRAME}


def test_blocks_of_broken_sources():
    assert blocks(None) == blocks("") == blocks("<p" * 9) == []
    assert [b.text for b in blocks("no tags < here")] == ["no tags < here"]
    assert [(b.place, b.text) for b in blocks("<p>a</div><p>b <i>c</b>d")] == [(OPEN, "a"), (OPEN, "b cd")]
    assert [b.text for b in blocks("<main>m</main><p>out")] == ["m", "out"]
    assert len(blocks("<div>x" * 20_000)) == 20_000


def test_names_of_frames_leave_the_article():
    text = lambda source, *places: [b.text for b in blocks(source) if b.place in places]
    around = '<div class="layout has-sidebar"><nav>menu</nav><article>a</article></div>', '<div class="no-comments"><article>a</article></div>'
    around += '<form id="aspnetForm"><nav>menu</nav><article>a</article></form>', '<div class="sidebar"><article>a</article></div>'
    around += '<article class="notice">a</article>', '<body class="modal"><article>a</article>', '<aside>x</aside><div id="popup"><main>a</main></div>'
    assert [text(s, ARTICLE) for s in around] == [["a"]] * len(around)
    inside = """<article><h2 id="related-work">one</h2><h2 id="search">two</h2><p id="form-and-function">three
      <span class="token comment">four</span></p><div class="comment">no</div><div class="share-box">perhaps</div></article>"""
    assert text(inside, ARTICLE) == ["one", "two", "three four"] and text(inside, OPEN) == ["perhaps"] and text(inside, FRAME) == ["no"]
    # Without an article: a form may be the page, names do not take all of it, and frames by tag stay frames.
    assert text("<form><nav>menu</nav><p>a</p></form>", OPEN) == text('<div id="modal"><nav>menu</nav>a</div>', OPEN) == ["a"]
    # Readers' comments are no article where there is another one.
    assert text('<main><div id="comments"><article>no</article></div>a</main>', ARTICLE) == ["a"]


def test_end_tags_left_out():
    text = lambda source, *places: [b.text for b in blocks(source) if b.place in places]
    inside = """<article><div class="notice">x</div><p class="notice">x<p>a<ul><li class="share">x<li>b</ul><table><tr class="share"><td>x<tr><td
      class="ad">x<td>c</table><dl><dd class="comment">x<dt>d</dl><p class="ad">x<div>e</div>f</article>"""
    assert text(inside, ARTICLE) == ["a", "b", "c", "d", "e", "f"]
    assert text("<ul><li class='share'>x<ul><li>x</ul><li>a</ul>", OPEN) == ["a"]
    front = '<div class="ad">x<article>a</article>', "<body><nav>x<article>a</article></body>", "<main>x<div class='ad'>x<article>a</article></main>"
    assert [text(s, ARTICLE) for s in front] == [["a"]] * 3
    # Without a declared article the rest of the page is open; closed frames inside one that was left open are not.
    assert text("<body><nav>m<p>a</p><footer>x</footer></body>", OPEN) == ["m", "a"]
    assert text("<article><p>a<table><tr><td>b</p>c</table>d</article>", ARTICLE) == ["a", "b", "c", "d"]
    assert len(blocks("<p><table><td>" * 3000 + "<li>x" * 20_000)) == 20_000


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in host_suffix.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article)]
        want = "\n".join(p for p in parts if p)
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (want, len(want))


def test_repeated_runs_leave_open_blocks(spark, monkeypatch):
    rng = random.Random(6)
    template = "all our stories are free to read and share with your friends every day"
    bodies = [prose(rng, 40, 5000) for _ in range(12)]
    copied = "<article><p>" + prose(rng, 30) + "</p></article>"
    rows = [(k, f"http://Big.example.com:80/{k}", page(rng, f"<p>{b}</p>", template), "k", "h", "t") for k, b in enumerate(bodies)]
    rows += [(50 + k, f"https://u@other.example.com/{k}?x", page(rng, copied, template), "k", "h", "t") for k in range(4)]
    rows += [(70, "http://lone.example.com/", page(rng, "<p>alone here</p>", template), "k", "h", "t")]
    rows += [(80, None, None, None, None, None), (None, "x", "", None, None, None), (0, *rows[0][1:])]
    frame = spark.createDataFrame(rows, PAGES)
    want = Counter({(k, b): 1 for k, b in enumerate(bodies)})
    want[0, bodies[0]] = 2
    # Articles that the markup declares stay although they repeat; nothing repeats on the lone host.
    want.update({(50 + k, re.sub("<[^>]*>", "", copied)): 1 for k in range(4)})
    want.update({(70, f"{template}\nalone here\n{template}"): 1, (80, ""): 1, (None, ""): 1})
    for limit in (2_000_000, 60):  # one stream for a host, and many whose runs are summed
        monkeypatch.setattr(host_suffix, "STREAM_WORDS", limit)
        monkeypatch.setattr(host_suffix, "TASK_WORDS", 4 * limit)
        rows = host_suffix.extract(frame).collect()
        assert Counter((r.page_id, r.text) for r in rows) == want
        assert all(r.n_repeated >= 28 for r in rows if r.page_id is not None and r.page_id < 60)
    assert host_suffix.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_suffix_ranks_equal_brute_force():
    rng = np.random.default_rng(2)
    words = np.concatenate([rng.integers(0, 3, 300), [90], rng.integers(0, 3, 200), [91]])
    order, rank = host_suffix.repeated_suffixes(words, 8)
    runs = [tuple(words[i : i + 8]) for i in order]
    assert runs == sorted(runs)
    assert all((runs[k] == runs[k + 1]) == (rank[k] == rank[k + 1]) for k in range(len(runs) - 1))
    streams = [[f"w{rng.integers(0, 2)}" for _ in range(60)] for _ in range(5)]
    pages, starts, _, n = host_suffix.stream_runs(streams)
    for p, s, k in zip(pages, starts, n, strict=True):
        run = streams[p][s : s + 8]
        assert k == sum(any(t[i : i + 8] == run for i in range(53)) for t in streams)


def test_hosts(spark):
    urls = ["http://A.b.com:8080/x", "//c.org?d", "https://u:p@e.net#f", "mailto:x", "", None, "h.com/x"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in frame.select(host_suffix.host_of()).collect()] == ["a.b.com", "c.org", "e.net", "", "", "", ""]


def words(text):
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def brute_scan(rows, templates, percent=80):
    shingles = lambda x: [tuple(x[k : k + 3]) for k in range(len(x) - 2)]
    out = {}
    for doc_id, text in rows:
        own = shingles(words(text or ""))
        for i, (_, template) in enumerate(templates):
            t = words(template)
            want = set(shingles(t))
            for s in range(0, len(own), 3):
                if want & set(own[s : s + 3]):
                    low = max(0, s - len(t))
                    held = len(want & set(own[low : low + 2 * len(t) + 5])) / len(want)
                    if 100 * held >= percent:
                        out[doc_id, i] = max(held, out.get((doc_id, i), 0))
    return out


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, "one two"), (3, "all rights reserved"), (4, "ALL RIGHTS -- RESERVED! " * 400)]
    for k, (_, text) in enumerate(NOTICES):
        changed = text.split()
        changed[len(changed) // 2] = "altered"
        rows.append((100 + k, prose(rng, rng.randrange(40)) + " " + text + " " + prose(rng, rng.randrange(40))))
        rows.append((200 + k, prose(rng, rng.randrange(40)) + "\n" + " ".join(changed)))
        rows.append((300 + k, prose(rng, 50)))
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, hashes string, template string")
    got = {(r.doc_id, r.template): r.containment for r in license_scan.scan(frame.repartition(3)).collect()}
    want = brute_scan(rows, NOTICES)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert all((100 + k, k) in got for k in range(len(NOTICES)))


def test_license_scan_edges(spark):
    assert license_scan.scan(empty(spark)).count() == 0
    assert license_scan.scan(awkward(spark)).count() == 0
    assert license_scan.scan(awkward(spark), []).count() == 0
    assert license_scan.scan(awkward(spark), [("short", "two words")]).count() == 0
    plan = license_scan.scan(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_the_index_runs_without_python(spark):
    from revcast.llm.exact_dedup import new_index

    plan = new_index(spark).load(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
