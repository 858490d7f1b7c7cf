"""HTML extraction by site style trees (after Yi, Liu and Li, KDD 2003).

Pages of a host are merged into one style tree: a node is a chain of element
names with classes, and stands for all elements of the host with that chain.
Presentation: a node with child elements matters as far as the pages differ in
the sequence of its children (entropy, to the base of the number of pages).
Content: the words and link targets right below a node matter as far as they
are their page's own; one on n of the m pages with the node has the entropy
log n / log m, and 1 less that, averaged over all occurrences, is the content's
importance. The importance of a branch mixes the two of all its nodes; content
weighs less the more levels of elements hold it, by DAMPING a level, as what
pages always build alike is a menu whatever its words. A branch that holds more
than half of the host's words is no noise as a whole, though its parts may be.
Branches below a threshold are removed from each page, in articles too. A host's few pages prove
little: importance is that of the pages and of PRIOR pages more on which all
matters. Pages of one host with the same article count as one, so that copies
are no boilerplate.

Adverts may differ in every word and be built like paragraphs, and a lone page
has no tree; therefore elements whose name, role or class declares them menus,
footers, adverts and so on have no importance from the start, and where a page
marks its main part or articles, only these are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, small_keys, written
from .urls import host_of
from .words import SLAB, mix, words

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset("script style noscript template iframe object embed svg canvas audio video title textarea select button".split())
NOISE_ELEMENTS = frozenset("nav footer aside form menu dialog head".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer "
    "header masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login share sharing social "
    "related recommended comment comments reply replies disqus respond pagination pager widget search skip".split()
)
#: What may stand beside such a word in a hyphenated class.
NEUTRAL_WORDS = frozenset("area bar block bottom box col column container content element group inner item js left link links list main outer page panel primary right row secondary section site small top unit widget wrap wrapper".split())
CLOSES_P = BLOCKS - frozenset("head html body".split())
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = frozenset("ul ol dl table menu dir select body article main section div".split())

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(?:(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?![\w-])|[^\s"'=/>]+\s*=\s*(?:"[^"]*"|'[^']*'))""", re.I)
_PARTS = re.compile(r"[-_0-9]+")
_HREF = re.compile(r"""(?<![\w-])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: What content weighs for each level of elements that holds it, and pages on which all matters.
DAMPING, PRIOR = 0.4, 1.0
#: Levels of elements below a node that count for it.
LEVELS = 32
_STYLE, _FEATURE, _ABOVE = 0, 1, 2


class Block(NamedTuple):
    text: str
    node: int  # style node of the block's element
    noise: bool
    marked: bool  # in the main part or an article


class Page(NamedTuple):
    blocks: list[Block]
    links: list[tuple[int, str]]  # node and target
    above: dict[int, int]  # parent of each node
    styles: list[tuple[int, int]]  # node and hash of its child sequence, for each element


class _Open(NamedTuple):
    name: str
    node: int
    noise: bool
    marked: bool
    children: list


def _declared(token: str) -> bool:
    """Whether a class or id says noise: a noise word, or several words that are all noise or neutral."""
    parts = [p for p in _PARTS.split(token) if p]
    return not NOISE_WORDS.isdisjoint(parts) and all(p in NOISE_WORDS or p in NEUTRAL_WORDS for p in parts)


def _attributes(raw: str) -> tuple[str, bool]:
    """The style of an element from its class, and whether class, id, role or hidden call it noise."""
    if not raw.strip(" /"):
        return "", False
    style, noise = "", False
    for m in _ATTRIBUTE.finditer(raw):
        if not m[1]:
            continue  # the value of another attribute is no attribute
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role":
            noise |= value.strip() in NOISE_ROLES
        elif name in ("class", "id"):
            style = " ".join(sorted(value.split())) if name == "class" else style
            noise |= any(map(_declared, value.split()))
        else:
            noise |= name == "hidden" or value == "true"
    return style, noise


def parsed(page: str) -> Page:
    """The text blocks, links and style nodes of a page.

    A tolerant reader: unknown end tags are ignored, open elements end with
    their parents, paragraphs end where blocks begin, raw elements are skipped
    to their end tag.
    """
    stack = [_Open("", 0, False, False, [])]
    open_names: Counter = Counter()
    blocks: list[Block] = []
    links: list[tuple[int, str]] = []
    above: dict[int, int] = {0: 0}
    styles: list[tuple[int, int]] = []
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).replace("\0", " ").split())
            buffer.clear()
            if text:
                top = stack[-1]
                blocks.append(Block(text, top.node, top.noise, top.marked))

    def close(depth: int) -> None:
        while len(stack) > depth:
            x = stack.pop()
            open_names[x.name] -= 1
            styles.append((x.node, crc32("|".join(x.children).encode())))

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            buffer.append(page[at:])
            break
        if lt > at:
            buffer.append(page[at:lt])
        m = _TOKEN.match(page, lt)
        if not m:
            buffer.append("<")
            at = lt + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        name, ends = m[2].lower(), m[1] == "/"
        if name in SKIPPED and not ends:
            if name not in VOID and not m[3].rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}(?![\w-])[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else size if name in ("script", "style", "textarea", "title", "noscript", "template", "iframe") else at
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name not in BLOCKS:
            if name == "a" and not ends and (href := _HREF.search(m[3])):
                links.append((stack[-1].node, href[1] or href[2] or href[3] or ""))
            continue
        flush()
        if ends:
            if open_names[name]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            continue
        if name in CLOSES_P and open_names["p"]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == "p" or stack[i].name in LISTS), 0)
            if depth and stack[depth].name == "p":
                close(depth)
        if name in ITEMS:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name in ITEMS[name] or stack[i].name in LISTS), 0)
            if depth and stack[depth].name in ITEMS[name]:
                close(depth)
        style, noise = _attributes(m[3])
        parent = stack[-1]
        label = f"{name}.{style}" if style else name
        noise |= name in NOISE_ELEMENTS or (name == "header" and not parent.marked)
        noise &= name not in ("html", "body", "article", "main")
        parent.children.append(label)
        if name not in VOID:
            node = crc32(f"{parent.node}>{label}".encode())
            above.setdefault(node, parent.node)
            stack.append(_Open(name, node, parent.noise or noise, parent.marked or name in ("article", "main"), []))
            open_names[name] += 1
    flush()
    close(1)
    return Page(blocks, links, above, styles)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, weight, html) -> (host, node, kind, value, n): in pages, the styles, features and levels above of each node.

    Counted within the task, so that what many pages share leaves it as one row.
    """
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def summed() -> pa.RecordBatch:
        host, node, kind, value, weight = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        _, at, group = np.unique(_joint(host, node, kind, value), return_index=True, return_inverse=True)
        order = np.lexsort((value[at], kind[at], node[at], host[at]))  # rows that are alike compress well side by side
        return pa.RecordBatch.from_arrays([pa.array(x[at][order]) for x in (host, node, kind.astype(np.int32), value)] + [pa.array(np.bincount(group, weight)[order])], ["host", "node", "kind", "value", "n"])

    def hold(page: np.ndarray, host: np.ndarray, weight: np.ndarray, node: np.ndarray, kind: np.ndarray, value: np.ndarray) -> int:
        held.append((host[page], node, kind, value, weight[page]))
        return len(node)

    for batch in batches:
        host, weight = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        rows: list[tuple[int, int, int, int]] = []
        texts: list[bytes] = []
        owners: list[tuple[int, int]] = []
        waiting = 0
        last = len(host) - 1
        for i, source in enumerate(batch.column(2)):
            page = parsed(source.as_py() or "")
            rows += {(i, node, _STYLE, style) for node, style in page.styles}
            for node in page.above:
                up, levels = node, 0
                while up and levels <= LEVELS:
                    rows.append((i, node, _ABOVE, levels << 32 | up))
                    up, levels = page.above[up], levels + 1
            texts += [b.text.encode("utf-8", "surrogatepass") for b in page.blocks]
            texts += [b"href=" + b"_".join(x.encode("utf-8", "surrogatepass").split()) for _, x in page.links]
            owners += [(i, b.node) for b in page.blocks] + [(i, n) for n, _ in page.links]
            waiting += sum(map(len, texts[len(texts) - len(page.blocks) - len(page.links) :]))
            if rows and (i == last or waiting > SLAB):
                at, node, kind, value = np.array(rows, np.int64).T
                size += hold(at, host, weight, node, kind, value)
                bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
                found = words(np.frombuffer(b"\n".join([*texts, b""]), np.uint8), bounds, lower=True)
                at, node = np.repeat(np.array(owners, np.int64).reshape(-1, 2), np.diff(found.first), axis=0).T
                value = found.hash.view(np.int64)
                once = np.unique(_joint(at, node, value), return_index=True)[1]
                size += hold(at[once], host, weight, node[once], np.full(len(once), _FEATURE), value[once])
                rows, texts, owners, waiting = [], [], [], 0
                if size > 1_000_000:
                    yield summed()
                    size = 0
    if held:
        yield summed()


def _joint(*columns: np.ndarray) -> np.ndarray:
    """One 64-bit hash of a row's values."""
    out = np.zeros(len(columns[0]), np.uint64)
    for x in columns:
        out = mix(out ^ mix(x.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    return out


def importances(pages: DataFrame) -> DataFrame:
    """pages (host: long, weight: double, html) -> (host, node, pages, importance) of the hosts' style trees.

    A page counts by its weight. Entropies need more than one page with a node;
    a node of one page has importance 1.
    """
    counted = pages.mapInArrow(_features, "host long, node long, kind int, value long, n double")
    counted = counted.groupBy("host", "node", "kind", "value").agg(F.greatest(F.sum("n"), F.lit(1.0)).alias("n"))
    counted = written(counted.groupBy("host", "node", "kind", F.when(F.col("kind") == _ABOVE, F.col("value")).alias("above")).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.log("n")).alias("spread"),
        F.max(F.col("value") != crc32(b"")).alias("inner"),
    ), "nodes")
    levels = F.shiftright("above", 32)
    shown = counted.filter((F.col("kind") == _ABOVE) & (levels == 0)).select("host", "node", F.col("n").alias("pages"))
    style = counted.filter(F.col("kind") == _STYLE).select("host", "node", F.log("n").alias("style_m"), (F.col("spread") / F.col("n")).alias("style_log"), "inner")
    text = counted.filter(F.col("kind") == _FEATURE).select("host", "node", F.col("n").alias("occurs"), (F.col("spread") / F.col("n")).alias("text_log"))

    def own(log: str, most: Column) -> Column:
        """1 less an entropy to the base of its number of cases; 1 where there is one case alone."""
        return F.when(most > 0, F.greatest(F.lit(0.0), 1 - F.col(log) / most)).otherwise(1.0)

    nodes = shown.join(style, ["host", "node"], "left").join(text, ["host", "node"], "left").select(
        "host",
        "node",
        "pages",
        F.when(F.col("inner"), F.col("pages")).otherwise(0.0).alias("built"),
        own("style_log", F.col("style_m")).alias("style"),
        F.coalesce("occurs", F.lit(0.0)).alias("occurs"),
        own("text_log", F.log("pages")).alias("content"),
    )
    above = counted.filter(F.col("kind") == _ABOVE).select("host", "node", F.col("above").bitwiseAND((1 << 32) - 1).alias("up"), levels.alias("levels"))
    branches = nodes.join(above, ["host", "node"]).groupBy("host", F.col("up").alias("node")).agg(
        F.max(F.when(F.col("levels") == 0, F.col("pages"))).alias("pages"),
        F.sum("occurs").alias("occurs"),
        (F.sum(F.col("built") * F.col("style")) / F.nullif(F.sum("built"), F.lit(0.0))).alias("style"),
        (F.sum(F.col("occurs") * F.col("content")) / F.nullif(F.sum("occurs"), F.lit(0.0))).alias("content"),
        (F.sum(F.col("occurs") * F.col("levels")) / F.nullif(F.sum("occurs"), F.lit(0.0))).alias("levels"),
    )
    weight = F.pow(F.lit(DAMPING), F.coalesce("levels", F.lit(0.0)))
    mixed = (1 - weight) * F.coalesce("style", F.lit(0.0)) + weight * F.coalesce("content", F.lit(0.0))
    judged = branches.join(nodes.groupBy("host").agg(F.sum("occurs").alias("all")), "host").withColumn("mixed", F.when(2 * F.col("occurs") > F.col("all"), 1.0).otherwise(mixed))
    return judged.select("host", "node", "pages", ((F.col("pages") * F.col("mixed") + PRIOR) / (F.col("pages") + PRIOR)).alias("importance"))


def _article(page: str, low: frozenset[int], declared: bool = True) -> str:
    """The main text of a page without the branches of ``low``; ``declared``: heed what elements are called."""
    page = parsed(page)
    gone: dict[int, bool] = {0: False}
    for node, up in page.above.items():  # parents come first
        gone[node] = node in low or gone[up]
    kept = [b for b in page.blocks if not (declared and b.noise)]
    marked = declared and any(b.marked for b in kept)
    return "\n".join(b.text for b in kept if (b.marked or not marked) and not gone[b.node])


def article(declared: bool = True):
    """Column function: (html, style nodes of low importance) -> main text, blocks joined by newlines."""

    @F.arrow_udf("string")
    def article(pages: pa.Array, low: pa.Array) -> pa.Array:
        return pa.array([_article(p.as_py() or "", frozenset(x.as_py() or ()), declared) for p, x in zip(pages, low, strict=True)], pa.string())

    return article


def weights(pages: DataFrame) -> DataFrame:
    """pages (host, html, ..) with ``weight``: 1 by the number of the host's pages with the same main part or article."""
    low = F.lower("html")
    begin = F.least(*(F.nullif(F.locate(tag, low), F.lit(0)) for tag in ("<main", "<article")))
    behind = F.least(*(F.length(F.substring_index(low, tag, -1)) for tag in ("</main", "</article")))
    part = F.col("html").substr(begin, F.length("html") - behind - begin)
    keyed = pages.withColumn("part", F.xxhash64(F.coalesce(F.nullif(part, F.lit("")), "html")))
    copies = keyed.groupBy("host", "part").agg(F.count("*").alias("copies")).filter("copies > 1")
    return keyed.join(small_keys(written(copies, "copies")), ["host", "part"], "left").withColumn("weight", 1.0 / F.coalesce("copies", F.lit(1))).drop("part", "copies")


def extract(pages: DataFrame, threshold: float = 1 / 3, declared: bool = True) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, url, text, n_chars).

    Style trees are those of the hosts of ``url``. Null, empty and text-free
    pages give an empty text; a null url is the host "". Rows that repeat come
    back as often. Without ``declared``, names, roles and classes of elements
    are not heeded, and the trees alone decide.
    """
    pages = pages.select("page_id", "url", F.xxhash64(host_of(F.col("url"))).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    poor = written(importances(weights(pages.select("host", "html")).select("host", "weight", "html")).filter(F.col("importance") < threshold).select("host", "node"), "styles")
    low = poor.groupBy("host").agg(F.collect_list("node").alias("low"))
    # a check of all nodes, not of hosts, bounds the lists
    low = F.broadcast(low) if poor.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else low
    found = pages.join(low, "host", "left").select("page_id", "url", article(declared)("html", "low").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
