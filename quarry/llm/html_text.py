"""HTML extraction by site style trees.

The pages of one host are merged into a style tree: a node is a path of elements with their classes
and ids. For each node Spark counts over all the host's pages in how many it stands (m), how its
child elements vary (presentation), and in how many pages each of its texts stands (c). A text's
content importance is 1 - log(c) / log(m); a node's presentation importance is the entropy of its
child sequences over log(m); a block's importance blends the two. Blocks of low importance are
removed, as are branches whose element, class or id says that they are no article (menus, headers,
footers, sidebars, notices, adverts, forms, comments), of importance 0 by definition. If a page
marks its article or main part, what is left of that part alone is kept, unless long blocks outside
hold more text than it does (teasers or comments beside the real body). Pages of one host and one
body count once, whatever stands around it: a page that was copied is no template.

Defined cases: a null html gives an empty text; a null or odd url counts as one more host; a block
needs LEAST_PAGES pages of its host to be judged by them; where all would go, the page's own
structure alone decides; pages that repeat, or share an id, give a text each; a very long page is read
whole; an importance just at the limit stays; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import BROADCAST_ROWS, pieces, pinned
from .ngrams import lookup

LEAST_PAGES, LEAST_IMPORTANCE, BLEND = 4, 0.5, 0.9
#: Words from which a block outside the marked part weighs against it, and a block tells a page's body.
LONG = 20
#: Elements by what they mean for the text.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
NOT_TEXT = frozenset("head nav footer aside form button select option dialog menu object svg math canvas audio video map".split()) | RAW
MAIN = frozenset(("article", "main"))
NOISE_NAMES = frozenset("ad ads adv advert advertisement advertisements adverts adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar sidebar sidenav footer masthead topbar comment comments disqus reply replies respond cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup login social share sharing related recommended breadcrumb popup modal overlay toolbar pagination pager widget skip".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())
CLOSES = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",))}
WALLS = frozenset("table ul ol dl div article main section body html td th li blockquote".split())
CLOSE_P = BLOCKS - frozenset("br li td th tr tbody thead tfoot caption dt dd html body option optgroup legend summary figcaption".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)", re.S)
NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


class Block:
    __slots__ = ("path", "text", "noise", "main")

    def __init__(self, path: str, text: str, noise: bool, main: bool):
        self.path, self.text, self.noise, self.main = path, text, noise, main


def _names(attrs: str) -> tuple[str, bool]:
    """Class and id as part of the node's path, and whether they (or the role, or being hidden) say that it is no article."""
    path, noise = "", False
    for m in NAMES.finditer(attrs):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind in ("class", "id"):
            path += ("." if kind == "class" else "#") + re.sub(r"\d+", "0", value.strip())
            noise = noise or any(x.lower() in NOISE_NAMES or x.lower().removesuffix("s") in NOISE_NAMES for x in SPLIT.split(value) if x)
        elif kind == "role":
            noise = noise or value.strip().lower() in NOISE_ROLES
        elif kind == "hidden":
            noise = noise or not value or value.lower() in ("hidden", "true")
        elif kind == "aria-hidden":
            noise = noise or value.lower() == "true"
        elif "display" in value and re.search(r"display\s*:\s*none", value, re.I):
            noise = True
    return path, noise


def parse(html: str) -> tuple[list[Block], dict[str, list[str]]]:
    """The page's blocks of text in order, and for each node's path its child elements."""
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]  # element, path, noise, main
    blocks: list[Block] = []
    children: dict[str, list[str]] = {}
    text: list[str] = []
    own = stack[0]

    def flush() -> None:
        nonlocal own
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                blocks.append(Block(own[1], joined, own[2], own[3]))
            text.clear()
        own = stack[-1]

    def put(piece: str) -> None:
        nonlocal own
        # an inline branch that is no text leaves no trace in its block
        if stack[-1][2] != own[2] or stack[-1][3] != own[3]:
            flush()
        text.append(piece)

    at, n = 0, len(html)
    while at < n:
        m = TAG.search(html, at)
        if m is None:
            put(html[at:])
            break
        if m.start() > at:
            put(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "br" or name == "p" and all(x[0] != "p" for x in stack):
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    if name in BLOCKS or any(x[0] in BLOCKS for x in stack[i:]):
                        flush()
                    del stack[i:]
                    if not text:
                        own = stack[-1]
                    break
            if name in BLOCKS:
                flush()
            continue
        if name in BLOCKS:
            flush()
        if name in VOID:
            continue
        ends = CLOSES.get(name)
        if ends is not None or name in CLOSE_P:
            ends = ends or CLOSES["p"]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ends:
                    del stack[i:]
                    break
                if stack[i][0] in WALLS:
                    break
        above = stack[-1]
        extra, noise = _names(m[3]) if m[3] else ("", False)
        main = above[3] or name in MAIN or "main" in extra and not noise and 'role="main"' in m[3]
        if name in NOT_TEXT or name == "header" and not above[3]:
            noise = True
        if name in ("html", "body"):
            noise = False
        # of a header inside the article its headings stay
        if above[0] == "header" and above[3] and name not in ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "div"):
            noise = True
        path = f"{above[1]}>{name}{extra}"
        children.setdefault(above[1], []).append(name + extra)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if m[3].endswith("/") and name not in BLOCKS:
            continue
        stack.append((name, path, above[2] or noise, main))
        if name in BLOCKS or not text:
            own = stack[-1]
    flush()
    return blocks, children


HOST = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def host_of(url: str | None) -> str:
    m = HOST.match((url or "").strip())
    return m[1].lower() if m else ""


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts))


def body(blocks: list[Block]) -> list[Block]:
    """The blocks of the marked part; all blocks if none are marked, or the long ones outside hold more text."""
    marked = [b for b in blocks if b.main]
    outside = sum(len(b.text) for b in blocks if not b.main and len(b.text.split()) >= LONG)
    return marked if marked and sum(len(b.text) for b in marked) >= outside else blocks


def body_key(blocks: list[Block]) -> int:
    """The same for pages of one body: the least hash of its long blocks, or a hash of all its blocks if none is long."""
    held = body([b for b in blocks if not b.noise])
    return min((_hash(b.text) for b in held if len(b.text.split()) >= LONG), default=_hash(*[b.text for b in held]))


def style_rows(pages: DataFrame) -> DataFrame:
    """(host, node, kind, value, page): once a page, for each node the texts in it (kind 0) and its child sequence (kind 1), as hashes; page stands for the page's body."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, (1,)):
                out = [[], [], [], [], []]
                for url, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    host = host_of(url)
                    h = _hash(host)
                    blocks, children = parse(html or "")
                    page = body_key(blocks)
                    seen = {(_hash(host, b.path), 0, _hash(b.text)) for b in blocks if not b.noise}
                    seen |= {(_hash(host, p), 1, _hash(*c)) for p, c in children.items()}
                    for node, kind, value in seen:
                        for x, v in zip(out, (h, node, kind, value, page), strict=True):
                            x.append(v)
                longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([longs(out[0]), longs(out[1]), pa.array(out[2], pa.int32()), longs(out[3]), longs(out[4])], names=["host", "node", "kind", "value", "page"])

    return map_arrow(pages.select("url", "html"), run, "host long, node long, kind int, value long, page long")


def low_importance(pages: DataFrame) -> DataFrame:
    """(node, value) of the texts that the host's style tree finds unimportant."""
    counts = pinned(style_rows(pages).select("node", "kind", "value", "page").distinct().groupBy("node", "kind", "value").agg(F.count("*").alias("c")))
    nodes = counts.groupBy("node").agg(
        F.sum(F.when(F.col("kind") == 1, F.col("c"))).alias("m1"), F.sum(F.when(F.col("kind") == 1, F.col("c") * F.log("c"))).alias("s1"),
    )
    m = F.coalesce(F.col("m1"), F.lit(0))
    shape = F.when(m > 1, (F.log(m) - F.col("s1") / m) / F.log(m)).otherwise(F.lit(1.0))
    # m for content: the pages that hold the node; a page with several texts of one node counts once for each, so c <= m
    held = counts.where("kind = 0").groupBy("node").agg(F.sum("c").alias("m"))
    texts = counts.where("kind = 0 and c > 1").join(held, "node").where(F.col("m") >= LEAST_PAGES).join(nodes.select("node", shape.alias("shape")), "node", "left")
    importance = BLEND * (1 - F.log("c") / F.log("m")) + (1 - BLEND) * F.coalesce("shape", F.lit(1.0))
    return texts.where((F.col("c") >= 3) & (importance < LEAST_IMPORTANCE)).select("node", "value")


def text_of(url: str | None, html: str | None, unimportant) -> str:
    """The page's text; unimportant(keys) says which (node, value) hashes the style tree has found so."""
    blocks, _ = parse(html or "")
    blocks = [b for b in blocks if not b.noise]
    if not blocks:
        return ""
    host = host_of(url)
    gone = unimportant([_hash(host, b.path) ^ _hash(b.text) * 2 & 0xFFFFFFFFFFFFFFFF for b in blocks])
    kept = [b for b, g in zip(blocks, gone, strict=True) if not g]
    return " ".join([b.text for b in body(kept or blocks)])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most: int = BROADCAST_ROWS) -> DataFrame:
    """id, url, text and n_chars of every page. Extra columns are ignored.

    The unimportant texts go to every task as one sorted array while they are at most `most`;
    beyond that each page is joined with its own.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = dict(rows.dtypes)["id"]
    # node ^ 2 * value, as text_of has it
    low = pinned(low_importance(rows).select(F.expr("node ^ shiftleft(value, 1)").alias("k")).distinct())
    schema = f"`{id_col}` {kind}, url string, text string, n_chars long"
    few = low.limit(most + 1).count() <= most
    table = np.sort(low.toArrow().column("k").to_numpy().view(np.uint64)) if few else None
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        keys = shared.value
        for whole in batches:
            for batch in pieces(whole, (2,)):
                urls, htmls = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                own = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * len(urls)
                texts = []
                for url, html, mine in zip(urls, htmls, own, strict=True):
                    held = keys if keys is not None else np.sort(np.array(mine or [], np.int64).view(np.uint64))
                    texts.append(text_of(url, html, lambda k, held=held: lookup(held, np.array(k, np.uint64))[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, "url", "text", "n_chars"])

    if few:
        return map_arrow(rows, run, schema)

    def keys_of(batches):
        for batch in batches:
            url_list, html_list, page, key = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], []
            for i, (url, html) in enumerate(zip(url_list, html_list, strict=True)):
                host = host_of(url)
                for b in parse(html or "")[0]:
                    if not b.noise:
                        page.append(i)
                        key.append(_hash(host, b.path) ^ _hash(b.text) * 2 & 0xFFFFFFFFFFFFFFFF)
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(page, pa.int64())), pa.array(np.array(key, np.uint64).view(np.int64))], names=["p", "k"])

    page_key = F.sha2(F.concat_ws("\x1f", F.coalesce("url", F.lit("\x1e")), F.coalesce("html", F.lit("\x1e"))), 256)
    own = map_arrow(rows.select("url", "html", page_key.alias("p")), keys_of, "p string, k long").join(low, "k").groupBy("p").agg(F.collect_set("k").alias("own"))
    return map_arrow(rows.withColumn("p", page_key).join(own, "p", "left").select("id", "url", "html", "own"), run, schema)
