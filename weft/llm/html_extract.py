"""Main-text extraction by site style trees.

The pages of a host are merged into one tree of elements, named by their path of
tags with classes and ids. A node's presentation importance is the entropy of the
child layouts it is seen with, its content importance is low where the same content
stands on many pages (entropy of the content over pages); an inner node combines its
own presentation with its content nodes. Branches of low importance are navigation,
notices, advertising and the like, and leave every page of the host. Elements whose tag,
role, class or id says what they are leave first, on every host: the texts of comments and
advertisements differ from page to page, and a host with few pages can't be judged at all.
The tree judges what is left, each branch by itself.
"""

from __future__ import annotations

import html
import re
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, small

#: HTML elements by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
DROPPED = frozenset("head title script style noscript template nav footer aside form button select textarea input iframe object svg canvas dialog menu audio video map math".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements whose opening ends an open paragraph, and elements that end one of their own kind.
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Without class or id these are labels and cells of their surroundings (often equal on all pages), not branches of their own.
PLAIN = frozenset("h1 h2 h3 h4 h5 h6 dt dd tbody tr td th caption".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside rail widget widgets footer masthead topbar comments comment replies reply disqus respond cookie cookies consent notice notices gdpr alert popup modal newsletter subscribe signup social share sharing related recommended recommendations pagination pager search searchbox login skip toolbar copyright disclaimer".split()
)
#: Words that say where or how large something is, not what; with them a class stays a hint.
LAYOUT = frozenset("site page post top bottom left right box bar block container wrapper wrap area inner outer global main primary secondary list links link item items button buttons section panel content articles posts stories".split())
OUTER_HINTS = frozenset("header head foot side".split())
#: Elements whose class and id are no hints: anywhere, and in main content, where ids are slugs of headings.
UNNAMED = frozenset("html body article main h1 h2".split())
UNNAMED_IN_MAIN = frozenset("section h3 h4 h5 h6".split())
#: Elements that the tree never takes away, unless they have a class or id.
UNJUDGED = frozenset("html body article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())

#: Elements are told apart by their path down to this depth; what is nested deeper belongs to the branch there. Nothing is
#: left out by it: browsers flatten deeper trees as well.
MAX_DEPTH = 256

#: One attribute: a name, and a value in quotes (of any length) or without. A quote that is never closed is none.
_ATTR = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))?)?""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SPLIT = re.compile(r"[\s_\-]+|(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I) for tag in RAW}


def _names(value: str, outer: bool) -> bool:
    """Whether a whole class or a short id is made of hints, and of layout words besides; a slug of other words isn't."""
    for token in value.split():
        words = [w for w in _SPLIT.split(token) if w and not w.isdigit()]
        hints = [w.lower() in HINTS or (outer and w.lower() in OUTER_HINTS) for w in words]
        if any(hints) and len(words) <= 3 and all(h or w.lower() in LAYOUT for h, w in zip(hints, words)):
            return True
    return False


def key64(*parts: str) -> int:
    return int.from_bytes(blake2b("\x1f".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class Tree:
    """The block elements of a page, numbered in page order; a parent's number is below its children's. Number 0 is the root.

    ``key`` is a 64-bit hash of the host and the path of names (tag, classes and id), ``kids`` the names of the elements
    right below, ``judged`` whether the element is a branch of its own. ``blocks`` are the page's texts: (text, number of
    the outermost article or main element or 0, number of the block element). Memory grows with the page, not with
    the depth times the page.
    """

    __slots__ = ("parent", "key", "depth", "judged", "kids", "blocks")

    def __init__(self, host: str):
        self.parent, self.key, self.depth, self.judged, self.kids = [0], [key64(host)], [0], [False], [[]]
        self.blocks: list[tuple[str, int, int]] = []

    def add(self, up: int, name: str, judged: bool) -> int:
        if self.depth[up] >= MAX_DEPTH:
            return up
        self.parent.append(up)
        self.key.append(key64(str(self.key[up]), name))
        self.depth.append(self.depth[up] + 1)
        self.judged.append(judged)
        self.kids.append([])
        return len(self.key) - 1

    def above(self, node: int) -> list[int]:
        """Keys from the node up to below the root; at most MAX_DEPTH."""
        out = []
        while node:
            out.append(self.key[node])
            node = self.parent[node]
        return out


class _Open:
    """An open element: its tag, the number of the block element that its text belongs to, and what holds for its text."""

    __slots__ = ("tag", "block", "dropped", "main")

    def __init__(self, tag, block, dropped, main):
        self.tag, self.block, self.dropped, self.main = tag, block, dropped, main


def _attributes(page: str, at: int):
    """([(name, value)], index after the tag) from ``at`` behind a tag's name; the index is -1 if the tag never ends."""
    found, n = [], len(page)
    while True:
        while at < n and (page[at].isspace() or page[at] == "/"):
            at += 1
        if at >= n:
            return found, -1
        if page[at] == ">":
            return found, at + 1
        m = _ATTR.match(page, at)
        found.append((m[1].lower(), m[2] or m[3] or m[4] or ""))
        at = m.end()


def parse(page: str, host: str = "") -> Tree:
    """The page's tree and texts. What dropped elements hold is no text, and doesn't break the text around it unless it is a block."""
    tree = Tree(host)
    stack = [_Open("", 0, False, 0)]
    open_tags: dict[str, int] = {}
    buf: list[str] = []
    mains = 0

    def flush():
        if buf:
            text = " ".join("".join(buf).split())
            if text:
                tree.blocks.append((text, stack[-1].main, stack[-1].block))
            buf.clear()

    def close(to: int):
        while len(stack) > to:
            if stack[-1].tag in BLOCKS:
                flush()
            open_tags[stack.pop().tag] -= 1

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        lt = n if lt == -1 else lt
        if lt > at and not stack[-1].dropped:
            text = page[at:lt]
            buf.append(html.unescape(text) if "&" in text else text)
        if lt >= n:
            break
        nxt = page[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            comment = page.startswith("<!--", lt)
            end = page.find("-->" if comment else ">", lt + 4 if comment else lt)
            at = n if end == -1 else end + (3 if comment else 1)
            continue
        closing = nxt == "/"
        m = _NAME.match(page, lt + 1 + closing)
        if not m:
            if closing:
                end = page.find(">", lt)
                at = n if end == -1 else end + 1
            else:
                if not stack[-1].dropped:
                    buf.append("<")
                at = lt + 1
            continue
        tag = m[0].lower()
        attributes, at = _attributes(page, m.end())
        if at == -1:
            break
        if closing:
            if open_tags.get(tag):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if tag not in BLOCKS and stack[i].tag in BLOCKS:
                        break
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br" and not stack[-1].dropped:
                buf.append(" ")
            continue
        if tag in BLOCKS and open_tags.get("p"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCKS:
                    break
        if tag in SELF_CLOSING and any(open_tags.get(t) for t in SELF_CLOSING[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SELF_CLOSING[tag]:
                    close(i)
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select"):
                    break
        block = tag in BLOCKS
        if block:
            flush()
        up = stack[-1]
        name, hinted, marked = tag, False, False
        for k, v in attributes:
            if k in ("class", "id"):
                words = [w.lower() for w in _SPLIT.split(v) if w]
                marked = marked or bool(words)
                name += "." + _DIGITS.sub("0", "-".join(sorted(words)))
                if tag not in UNNAMED and not (up.main and tag in UNNAMED_IN_MAIN):
                    hinted = hinted or _names(v, not up.main)
            elif k == "role":
                hinted = hinted or v.lower() in ROLES
            elif k == "hidden" or (k == "aria-hidden" and v.lower() == "true") or (k == "style" and _HIDDEN.search(v)):
                hinted = True
        dropped = up.dropped or hinted or tag in DROPPED or (tag == "header" and not up.main)
        tree.kids[up.block].append(name)
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = n if end is None else end.end()
            continue
        main = up.main
        if not main and tag in ("article", "main"):
            mains += 1
            main = mains
        own = tree.add(up.block, name, (marked or tag not in PLAIN) and name not in UNJUDGED) if block and not dropped else up.block
        stack.append(_Open(tag, own, dropped, main))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return tree


def main_text(page: str | None, host: str = "", noise=None) -> str:
    """The page's main text; ``noise``: sorted keys of the host's unimportant nodes."""
    if not page:
        return ""
    tree = parse(page, host)
    kept = tree.blocks
    if noise is not None and len(noise) and kept:
        keys = np.asarray(tree.key, np.int64)
        at = np.minimum(np.searchsorted(noise, keys), len(noise) - 1)
        hit = (noise[at] == keys) & np.asarray(tree.judged)
        noisy = [False] * len(keys)
        for i in range(1, len(keys)):
            noisy[i] = bool(hit[i]) or noisy[tree.parent[i]]
        kept = [b for b in kept if not noisy[b[2]]] or kept  # a page of nothing else is left as it is
    # outside of articles stands nothing more, unless it outweighs each of them: then they are cards or remarks beside it
    size: dict[int, int] = {}
    for b in kept:
        size[b[1]] = size.get(b[1], 0) + len(b[0])
    outside = size.pop(0, 0)
    if size and outside < max(size.values()):
        kept = [b for b in kept if b[1]]
    return "\n".join(b[0] for b in kept)


def _features(batches):
    """(node, kind, feature, page, up): kind 0 content of a block, 1 child layout of an element, 2 the node's presence
    (with its key and those above). Rows leave in pieces of bounded size, however deep or long a page is."""
    import pyarrow as pa

    names, types = ["node", "kind", "feature", "page", "up"], (pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    cols: list[list] = [[], [], [], [], []]
    held = 0

    def piece():
        nonlocal cols, held
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
        cols, held = [[], [], [], [], []], 0
        return out

    for b in batches:
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not page:
                continue
            sig = key64(page)
            tree = parse(page, host or "")
            seen = {(tree.key[i], 0, key64(text)): 0 for text, _, i in tree.blocks if i}
            seen.update({(tree.key[i], 1, key64(",".join(tree.kids[i]))): 0 for i in range(1, len(tree.key))})
            seen.update({(tree.key[i], 2, 0): i for i in range(1, len(tree.key))})
            for (node, kind, feature), i in seen.items():
                up = tree.above(i) if kind == 2 else []
                for c, x in zip(cols, (node, kind, feature, sig, up)):
                    c.append(x)
                held += 5 + len(up)
                if held > 500_000:
                    yield piece()
    if held:
        yield piece()


def style_tree(pages: DataFrame, least_pages: int = 4, gamma: float = 0.9, stash: Stash | None = None) -> DataFrame:
    """``(node, pages, importance)`` of every host's style tree, from rows (host, html); equal pages count once.

    node is a 64-bit key of host and element path. A node on fewer than ``least_pages``
    pages has importance 1. All figures are aggregates with map-side combine.
    """
    seen = pages.select("host", "html").mapInArrow(_features, "node long, kind byte, feature long, page long, up array<long>")
    seen = seen.groupBy("node", "kind", "feature", "page").agg(F.first("up").alias("up"))
    count = seen.groupBy("node", "kind", "feature").agg(F.count("*").alias("c"), F.first("up").alias("up"))
    c = F.col("c").cast("double")
    of = lambda k, x: F.sum(F.when(F.col("kind") == k, x))
    node = count.groupBy("node").agg(
        F.coalesce(of(2, c), F.lit(0.0)).alias("m"), of(0, c).alias("blocks"), of(0, c * F.log(c)).alias("spread"),
        of(1, c).alias("layouts"), of(1, c * F.log(c)).alias("clog"), F.coalesce(of(1, F.lit(1)), F.lit(0)).alias("kinds"),
        F.max(F.when(F.col("kind") == 2, F.col("up"))).alias("up"),
    ).where(F.col("m") >= least_pages)
    # content: 1 - mean entropy of a block's occurrence over pages; presentation: entropy of layouts; both to base m
    content = F.greatest(F.lit(0.0), 1 - F.col("spread") / F.col("blocks") / F.log("m"))
    layout = F.least(F.lit(1.0), (F.log("layouts") - F.col("clog") / F.col("layouts")) / F.log("m"))
    node = node.select("node", "m", "blocks", "kinds", "up", content.alias("content"), F.coalesce(layout, F.lit(0.0)).alias("layout"))
    # written once: the pages are not parsed again for the part that looks up the tree
    node = (stash or Stash(pages.sparkSession, "style-tree")).put("nodes", node)
    below = node.where("blocks > 0").select(F.explode("up").alias("node"), "content", "blocks").groupBy("node").agg(
        (F.sum(F.col("content") * F.col("blocks")) / F.sum("blocks")).alias("below")
    )
    weight = F.pow(F.lit(gamma), F.greatest(F.col("kinds"), F.lit(1)))
    whole = node.join(below, "node")
    return whole.select("node", F.col("m").cast("long").alias("pages"), ((1 - weight) * F.col("layout") + weight * F.col("below")).alias("importance"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.2, least_pages: int = 4, noise_rows: int = 2_000_000) -> DataFrame:
    """``(id, url, text, n_chars)`` per row of pages: its main text, blocks joined by line breaks.

    A null html counts as empty and gives an empty text; pages without a host in their
    url share one tree. Node keys of unimportant branches are broadcast while there are
    at most ``noise_rows`` of them (8 bytes each); beyond that each page gets its own
    nodes' keys by a join. Repeated rows come back as often as they came.
    """
    host = F.lower(F.coalesce(F.regexp_extract(url_col, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    own = pages.select(F.col(id_col), F.col(url_col), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    stash = Stash(pages.sparkSession, "html")
    noise = stash.put("noise", style_tree(own, least_pages, stash=stash).where(F.col("importance") < threshold).select("node"))
    stash.drop("nodes")
    types = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    schema = f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}, text string, n_chars long"

    def out(b, texts):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"]
        )

    if small(noise, noise_rows):
        keys = np.sort(np.asarray([r[0] for r in noise.collect()], np.int64))
        stash.drop("noise")
        shared = pages.sparkSession.sparkContext.broadcast(keys)

        def run(batches):
            for b in batches:
                yield out(b, [main_text(h, u or "", shared.value) for u, h in zip(b.column(2).to_pylist(), b.column(3).to_pylist())])

        return own.mapInArrow(run, schema)

    def keys_of(batches):
        import pyarrow as pa

        for b in batches:
            nodes = [sorted(set(parse(h, u or "").key)) if h else [] for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.list_(pa.int64()))], names=["host", "html", "nodes"])

    found = own.select("host", "html").distinct().mapInArrow(keys_of, "host string, html string, nodes array<long>")
    found = found.select("host", F.sha2("html", 256).alias("sig"), F.explode("nodes").alias("node")).join(noise, "node", "left_semi")
    per_page = found.groupBy("host", "sig").agg(F.collect_list("node").alias("nodes"))
    joined = own.withColumn("sig", F.sha2("html", 256)).join(per_page, ["host", "sig"], "left").select(id_col, url_col, "host", "html", "nodes")

    def run_joined(batches):
        for b in batches:
            rows = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())
            yield out(b, [main_text(h, u or "", np.sort(np.asarray(k or [], np.int64))) for u, h, k in rows])

    return joined.mapInArrow(run_joined, schema)
