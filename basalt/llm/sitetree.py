"""Main text of web pages by a site style tree.

The DOMs of all pages of a host are merged: elements of one path of tags and classes are one node of
the tree. Over the pages that have it, a node's presentation (the shape of the subtree: children,
and the size of each text as a power of two) and its content (the text below it) each have a
distribution; their entropies, in units of the logarithm of the page count, make its importance,
presentation x content. A menu looks alike everywhere even if its links differ; a notice reads alike;
an article does neither. A second tree over all hosts stands behind those of small hosts.

Every element of a page has log odds of being content, from the top down:

    prior of its names + GAIN * trust * (importance - CENTRE) + what its parent hands down

A branch goes when its odds turn negative. ``trust`` is m / (m + BACKOFF) for m pages; a page on its own is
judged by the priors, which names (``nav``, ``article``, ``sidebar`` ...) give and measured importance
overrules, except where importance can't tell (reader comments vary as articles do). An element of
positive odds is content, unless one of its inner elements holds most of its text: then it only wraps
that one. Inside content only repetition counts: a branch that reads alike on all pages goes,
unless its parent does so too: then the pages are copies, and repetition tells nothing. On pages
that have an ``article`` or ``main`` that stays, only text below one counts.

Statistics are sums by (host, path, feature), pre-aggregated in each task; a host with a third of
all pages is one more group of sums. Paths are 64-bit hashes, so depth costs nothing. A host's
tree is sent to its pages without paths on fewer than one of ``RARE`` of its pages (and the tree of all
hosts likewise), which leaves at most RARE times the paths of a mean page.

Defined cases: null or empty html gives an empty text; a null url is the host ""; broken markup is
read as far as it goes, an unclosed tag at the end is dropped; repeated pages each count.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import checkpoint, configure, map_arrow

#: Weight and neutral point of importance, pages at which it is half trusted, most odds that a parent hands down.
GAIN, CENTRE, BACKOFF, INHERIT = 8.0, 0.5, 8, 1.0
#: Share of an element's words above which an inner element makes it a wrapper.
WRAPPED = 0.5
#: Paths on fewer than one of so many pages give no evidence.
RARE = 1000
#: Log odds by name: content, furniture, and what varies like content but is none.
CONTENT_PRIOR, FURNITURE_PRIOR, OTHER_PRIOR = 3.0, -3.0, -8.0
#: Most (host, path) rows to broadcast; more are joined by a salted shuffle.
BROADCAST_ROWS = 100_000
SALTS = 32

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|svg|iframe|select|button|object"
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "head"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Names of furniture, of text that is no part of the article though it varies like one, and of content roots.
FURNITURE_TAGS = frozenset("nav footer aside form dialog menu".split())
HEADERS = frozenset("header masthead banner".split())
FURNITURE = frozenset("nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer topbar toolbar pagination pager skip login signup subscribe subscription search".split())
OTHER = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent notice alert popup modal overlay "
    "newsletter share sharing related recommended comment comments commentlist disqus replies".split()
)
ROOTS = frozenset(["article", "main"])
#: Parts of a class that say how a page is laid out, not what an element is.
LAYOUT = frozenset("with has no without hide show is".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9-]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9-]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: (pages, presentation, content, share of the largest inner element) by path.
Tree = dict[int, tuple[int, float, float, float]]


def kind_of(name: str) -> str:
    """What a class, id or role says of an element: furniture, header, other or nothing; its first or last part counts."""
    parts = [x.lower() for x in _PARTS.findall(name)]
    if not parts or LAYOUT & set(parts):
        return ""
    for p in (parts[-1], parts[0]):
        for kind, known in (("other", OTHER), ("furniture", FURNITURE), ("header", HEADERS)):
            if p in known and (kind != "header" or p == parts[-1]):
                return kind
    return ""


def prior(tag: str, names: list[str], inside: bool) -> float:
    """Log odds of content that the names of an element give; a header inside content is a part of it."""
    kinds = {kind_of(x) for x in names} if tag not in ("body", "html") else set()
    if "other" in kinds:
        return OTHER_PRIOR
    if tag in ROOTS or "main" in names:
        return CONTENT_PRIOR
    if tag in FURNITURE_TAGS or "furniture" in kinds:
        return FURNITURE_PRIOR
    if not inside and (tag == "header" or "header" in kinds):
        return FURNITURE_PRIOR
    return 0.0


class Evidence:
    """Importance of paths on one host, backed by that of all hosts."""

    def __init__(self, host: Tree | None = None, every: Tree | None = None) -> None:
        self.host, self.every = host or {}, every or {}

    def __call__(self, path: int) -> tuple[float, float, float, bool]:
        """(trust, importance, content, only a wrapper) of a path; no trust without a row."""
        own, all_of = self.host.get(path), self.every.get(path)
        if own is None and all_of is None:
            return 0.0, CENTRE, CENTRE, False
        if own is None or all_of is None:
            m, p, c, inner = own or all_of
        else:
            m, share = max(own[0], all_of[0]), own[0] / (own[0] + BACKOFF)
            p, c, inner = (share * x + (1 - share) * y for x, y in zip(own[1:], all_of[1:], strict=True))
        return m / (m + BACKOFF), p * c, c, inner > WRAPPED


class Element:
    __slots__ = ("content", "first", "holder", "inner", "key", "odds", "path", "root", "shape", "tag", "words")

    def __init__(self, tag: str, key: str, path: int, holder: Element | None, first: int) -> None:
        self.tag, self.key, self.path, self.first = tag, key, path, first
        self.holder = holder or self  # the block that this element is or lies in
        self.odds, self.root, self.content = 0.0, False, CENTRE
        self.shape: list[str] = []
        self.words, self.inner = 0, False

    @property
    def block(self) -> bool:
        return self.holder is self


def _judged(up: Element, e: Element, names: list[str], evidence: Evidence) -> None:
    """Log odds of an element below its parent; html and body are neither content nor furniture."""
    if up.odds < 0:
        e.odds = up.odds
        return
    named = prior(e.tag, names, up.odds > 0)
    if not e.block:  # inline elements are a part of their block, unless a name says otherwise
        e.odds, e.root, e.content = (named if named < 0 else up.odds), up.root, up.content
        return
    trust, importance, e.content, wrapper = evidence(e.path)
    e.root = up.root or named > 0
    if e.tag in ("html", "body"):
        return
    if up.odds > 0:
        e.odds = named + GAIN * trust * min(0.0, e.content - min(CENTRE, up.content)) + min(up.odds, INHERIT)
    else:
        e.odds = named + GAIN * trust * (importance - CENTRE)
        if wrapper and named <= 0 < e.odds:
            e.odds = 0.0


#: An element of a page: path, that of its parent, presentation, content, words, whether it has inner elements.
Node = tuple[int, int, int, int, int, bool]


def read(html: str, evidence: Evidence | None = None) -> tuple[list[tuple[str, bool]], list[Node]]:
    """Blocks (text, below a content root) and nodes of a page.

    With ``evidence`` only the blocks that stay are made, and no nodes.
    """
    blocks: list[tuple[str, bool]] = []
    nodes: list[Node] = []
    stack = [Element("", "", 0, None, 0)]
    opened: Counter = Counter()
    text: list[str] = []

    def flush() -> None:
        if text:
            words = entities.unescape("".join(text)).split()
            text.clear()
            if words:
                at = stack[-1].holder
                blocks.append((" ".join(words), at.root))
                at.shape.append(str(len(words).bit_length()))
                at.words += len(words)

    def close() -> None:
        e = stack.pop()
        opened[e.tag] -= 1
        if evidence is None and e.block:
            shape = zlib.crc32(" ".join(e.shape).encode())
            content = 0
            for line, _ in blocks[e.first :]:
                content = zlib.crc32(line.encode("utf-8", "replace"), content) + 1
            up = stack[-1].holder
            nodes.append((e.path, up.path, shape, content, e.words, e.inner))
            up.shape.append(f"{e.key}:{shape}")
            up.words += e.words
            up.inner = True

    def close_to(tags: tuple[str, ...], stops: tuple[str, ...]) -> None:
        if not any(opened[x] > 0 for x in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                flush()
                while len(stack) > i:
                    close()
                return
            if stack[i].tag in stops:
                return

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at and stack[-1].odds >= 0:
            text.append(html[at : m.start()])
        at = m.end()
        name = m[3] or m[6]
        if not name:
            if m[1] and m[1].lower() in ("button", "select", "svg", "object", "title"):
                text.append(" ")
            continue
        tag, ends, rest = name.lower(), m[2] or m[5], m[4] or m[7] or ""
        block = tag in BLOCK
        if ends:
            if block:
                flush()
            if opened[tag] > 0:
                while True:
                    if stack[-1].block:
                        flush()
                    last = stack[-1].tag
                    close()
                    if last == tag:
                        break
            continue
        if tag == "br":
            text.append(" ")
            continue
        if block:
            flush()
            if tag in CLOSES_P:
                close_to(("p",), ("table", "td", "th", "button"))
            if tag in SIBLINGS:
                close_to(SIBLINGS[tag], STOPS[tag])
        up = stack[-1]
        if tag in VOID:
            if evidence is None:
                up.holder.shape.append(tag)
            continue
        said = {k.lower(): (a or b or c) for k, a, b, c in _NAMES.findall(rest)} if rest else {}
        key = tag + "".join("." + x for x in sorted(said.get("class", "").lower().split()))
        path = xxhash.xxh64_intdigest(key.encode("utf-8", "replace"), up.path) if block else up.path
        e = Element(tag, key, path, None if block else up.holder, len(blocks))
        if evidence is not None:
            _judged(up, e, [x for v in said.values() for x in v.split()], evidence)
        opened[tag] += 1
        stack.append(e)
    if at < len(html) and stack[-1].odds >= 0:
        text.append(html[at:])
    flush()
    while len(stack) > 1:
        close()
    return blocks, nodes


def main_text(html: str | None, evidence: Evidence | None = None) -> str:
    """Blocks of the article, in page order, one a line."""
    blocks, _ = read(html or "", evidence or Evidence())
    if any(root for _, root in blocks):
        blocks = [(x, root) for x, root in blocks if root]
    return "\n".join(x for x, _ in blocks)


def host_of(url):
    """Host of a url, lower case; "" if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


_FEATURES = pa.schema([("host", pa.string()), ("path", pa.int64()), ("up", pa.int64()), ("kind", pa.int32()), ("feature", pa.int64()), ("n", pa.int64()), ("words", pa.int64()), ("inner", pa.bool_())])
_FEATURES_DDL = "host string, path long, up long, kind int, feature long, n long, words long, inner boolean"


def page_features(html: str) -> dict[int, list]:
    """By path (signed): parent, presentation and content over all elements of the path, words, inner elements."""
    own: dict[int, list] = {}
    for path, up, shape, content, words, inner in read(html)[1]:
        p = own.setdefault(path - (path >> 63 << 64), [up - (up >> 63 << 64), 0, 0, 0, False])
        p[1], p[2] = zlib.crc32(shape.to_bytes(4, "big"), p[1]), zlib.crc32(content.to_bytes(8, "big"), p[2])
        p[3] += words
        p[4] |= inner
    return own


def _importance(features: DataFrame, *by: str) -> DataFrame:
    """(by, path, pages, presentation, content, inner) of every node of the trees of ``by``."""
    m, part = F.sum("n"), F.sum(F.col("n") * F.log(F.col("n").cast("double")))
    entropy = features.groupBy(*by, "path", "kind").agg(
        # -sum(p log p) / log(m), with p = n / m; nothing is known of a path that one page has
        F.when(m > 1, 1 - part / (m * F.log(m.cast("double")))).otherwise(F.lit(CENTRE)).alias("h"),
        m.alias("m"), F.max("up").alias("up"), F.sum("words").alias("words"), F.max("inner").alias("inner"),
    )
    kind = F.col("kind")
    nodes = entropy.groupBy(*by, "path").agg(
        F.max("m").alias("pages"), F.max(F.when(kind == 0, F.col("h"))).alias("presentation"), F.max(F.when(kind == 1, F.col("h"))).alias("content"),
        F.max("up").alias("up"), F.max("words").alias("words"), F.max("inner").alias("inner"),
    )
    nodes = checkpoint(nodes)
    largest = nodes.where("inner").groupBy(*by, F.col("up").alias("path")).agg(F.max("words").alias("most"))
    joined = nodes.join(largest, [*by, "path"], "left")
    share = F.coalesce(F.try_divide(F.col("most").cast("double"), F.col("words").cast("double")), F.lit(0.0))
    return joined.select(*by, "path", "pages", "presentation", "content", share.alias("wrapped"))


def style_trees(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> tuple[DataFrame, DataFrame]:
    """Trees (host, path, pages, presentation, content, wrapped) of every host, and the one of all hosts without ``host``."""
    configure(pages.sparkSession)
    room = 200_000

    def rows(seen: dict[tuple, list]):
        keys, values = list(seen), list(seen.values())
        columns = {name: [k[i] for k in keys] for i, name in enumerate(("host", "path", "up", "kind", "feature"))}
        return columns | {name: [v[i] for v in values] for i, name in enumerate(("n", "words", "inner"))}

    def work(batches):
        seen: dict[tuple, list] = {}
        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for path, (up, shape, content, words, inner) in page_features(page or "").items():
                    for kind, feature in enumerate((shape, content)):
                        v = seen.setdefault((host, path, up, kind, feature), [0, 0, False])
                        v[0] += 1
                        v[1] += words
                        v[2] |= inner
            if len(seen) > room:
                yield rows(seen)
                seen.clear()
        yield rows(seen)

    narrow = pages.select(host_of(pages[url_col]).alias("host"), pages[html_col].alias("html"))
    counted = map_arrow(narrow, work, _FEATURES_DDL, _FEATURES)
    merged = [F.sum("n").alias("n"), F.sum("words").alias("words"), F.max("inner").alias("inner"), F.max("up").alias("up")]
    features = checkpoint(counted.groupBy("host", "path", "kind", "feature").agg(*merged))
    every = features.groupBy("path", "kind", "feature").agg(*merged)
    return _importance(features, "host"), _importance(every)


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    spark = configure(pages.sparkSession)
    hosts, every = style_trees(pages, html_col, url_col)
    narrow = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"), host_of(pages[url_col]).alias("host"))
    total = narrow.count()
    # on average a page has a bounded number of paths, so at most RARE times that many reach the driver
    common = every.where((F.col("pages") > 1) & (F.col("pages") * RARE >= total)).select("path", "pages", "presentation", "content", "wrapped")
    sent = spark.sparkContext.broadcast({r[0]: tuple(r[1:]) for r in common.collect()})

    sizes = narrow.groupBy("host").agg(F.count("*").alias("of"))
    known = hosts.where("pages > 1").join(sizes, "host").where(F.col("pages") * RARE >= F.col("of"))
    known = checkpoint(known.groupBy("host").agg(F.collect_list(F.struct("path", "pages", "presentation", "content", "wrapped")).alias("tree")))
    size = known.agg(F.coalesce(F.sum(F.size("tree")), F.lit(0))).first()[0]
    if size <= BROADCAST_ROWS:
        joined = narrow.join(F.broadcast(known), "host", "left")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = narrow.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def work(batches):
        mask = (1 << 64) - 1
        every = {path & mask: row for path, row in sent.value.items()}
        trees: dict[str, Tree] = {}
        for batch in batches:
            texts = []
            hosts = batch.column("host").to_pylist()
            for i, (host, page) in enumerate(zip(hosts, batch.column("html").to_pylist(), strict=True)):
                if host not in trees:
                    if len(trees) >= 64:
                        trees.clear()
                    rows = batch.column("tree")[i].as_py() or []
                    trees[host] = {r["path"] & mask: (r["pages"], r["presentation"], r["content"], r["wrapped"]) for r in rows}
                texts.append(main_text(page, Evidence(trees[host], every)))
            yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(x) for x in texts]}

    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    return map_arrow(joined.select("page_id", "url", "html", "host", "tree"), work, "page_id long, url string, text string, n_chars long", out)


def op_query(pages: DataFrame) -> DataFrame:
    return extract(pages)
