"""Main-text extraction: what leaks and what doesn't, deep and long pages, and the style tree against plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np

from weft.llm import html_extract

LEAKS = [
    ('<p>a <span class="ad">Buy now</span> b</p>', "a b"),
    ("<p>a <button>Go</button> b</p>", "a b"),
    ("<p>a <span hidden>x</span>b</p>", "a b"),
    ("<p>a <svg><text>q</text></svg> <math><mi>x</mi></math> b</p>", "a b"),
    ("<p>a <select><option>one<option>two</select> b</p>", "a b"),
    ("<p>a</p><form>f <p>g</p></form><p>b</p>", "a\nb"),
    ("<p>a <i style='display: none'>x</i> b<div role=navigation>n</div>c</p>", "a b\nc"),
    ("<p class=a\">x</p>", "x"),
    ('<p title="never closed>x</p><p>y</p>', "x\ny"),
    ("<p>1 < 2 &lt; 3 &amp;amp; &#x41;&#66;&nbsp;c</p>", "1 < 2 < 3 &amp; AB c"),
    ("<div>İ</div><script>İİ</SCRIPT >z<style>p</style>", "İ\nz"),
    ("<p>a<br>b<p>c<ul><li>d<li>e</ul>", "a b\nc\nd\ne"),
]


def test_dropped_elements_leave_nothing():
    assert [html_extract.main_text(page) for page, _ in LEAKS] == [text for _, text in LEAKS]


def test_attributes_of_any_length():
    for size in (9_000, 11_000, 100_000):
        assert html_extract.main_text(f'<p>before</p><div data-x="{"y>" * size}">after</div>') == "before\nafter"


def test_deep_pages_take_memory_by_their_size():
    import tracemalloc

    deep = "<div>t" * 100_000
    tracemalloc.start()
    assert html_extract.main_text(deep).count("t") == 100_000
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    spans = "<span>" * 100_000 + "<li>a</li></b>" * 2_000
    assert html_extract.main_text(spans).count("a") == 2_000


def plain_importance(pages, least_pages, gamma):
    """Importance of every node by plain counting: (host, path) -> (pages, importance)."""
    contents, layouts, present, kin = defaultdict(Counter), defaultdict(Counter), defaultdict(set), {}
    for host, page in sorted(set(pages)):
        tree = html_extract.parse(page, host)
        seen = set()
        for i in range(1, len(tree.key)):
            present[tree.key[i]].add(page)
            kin[tree.key[i]] = tree.above(i)
            seen.add((tree.key[i], "layout", ",".join(tree.kids[i])))
        seen |= {(tree.key[i], "content", text) for text, _, i in tree.blocks if i}
        for node, kind, x in seen:
            (contents if kind == "content" else layouts)[node][x] += 1
    own, layout = {}, {}
    for node, on in present.items():
        m = len(on)
        if m < least_pages:
            continue
        total = sum(layouts[node].values())
        layout[node] = min(1.0, -sum(c / total * math.log(c / total) for c in layouts[node].values()) / math.log(m))
        n = sum(contents[node].values())
        if n:
            own[node] = (n, max(0.0, 1 - sum(c / n * math.log(c) for c in contents[node].values()) / math.log(m)))
    out = {}
    for node in layout:
        below = [own[x] for x in own if node in kin[x]]
        if below:
            weight = gamma ** max(1, len(layouts[node]))
            out[node] = (len(present[node]), (1 - weight) * layout[node] + weight * sum(n * c for n, c in below) / sum(n for n, _ in below))
    return out


def test_style_tree_against_plain_counting(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(60):
        host = rnd.choice(["a.example", "b.example", ""])
        menu = "<div class='box'><ul>" + "".join(f"<li>{x}</li>" for x in ("one", "two")) + "</ul></div>"
        body = "".join(f"<{t}>{rnd.choice('pqrst')} {rnd.randrange(9)}</{t}>" for t in rnd.choices(["p", "h2", "section", "i"], k=rnd.randrange(1, 6)))
        rows.append((host, f"<html><body>{menu if rnd.random() < 0.8 else ''}<div id='c{rnd.randrange(3)}'>{body}</div></body></html>"))
    rows += rows[:5]
    df = spark.createDataFrame([(h, p) for h, p in rows], "host string, html string")
    got = {r.node: (r.pages, r.importance) for r in html_extract.style_tree(df, 4, 0.9).collect()}
    want = plain_importance(rows, 4, 0.9)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0]
        assert abs(got[k][1] - want[k][1]) < 1e-9


def test_noise_is_taken_by_branch():
    page = "<body><div class='x'><p>a</p></div><div class='y'><p>b</p><span class='x'>c</span></div></body>"
    tree = html_extract.parse(page, "h")
    noise = np.sort(np.asarray([k for k, kids in zip(tree.key, tree.kids) if kids == ["p"]], np.int64))
    assert html_extract.main_text(page, "h", noise) == "b\nc"
    assert html_extract.main_text(page, "other", noise) == "a\nb\nc"
