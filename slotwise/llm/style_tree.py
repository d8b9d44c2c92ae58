"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: element nodes that agree in tag and style (tag, class,
id and role, from the root down) are one node, however often and in how many pages they occur. Marks
that differ from page to page are left out of the style: digits, long hexadecimal words, and whatever
class or id ``html``, ``body``, ``main`` and ``article`` carry. The texts right in a node are its content nodes.

* Content importance: over the m pages that hold a node, a text that occurs in k of them has the normalised
  entropy log k / log m, and the importance 1 - log k / log m: 1 for a text of one page, 0 for one of all.
* Presentation importance: the normalised entropy of a node's child layouts over the same pages; where
  layouts vary, the node is not a template's fixed part. It counts ``LAYOUT_SHARE``, the content the rest.
* Prior: what a page says about itself is added. In ``article`` and ``main`` a text gains ``KEPT_PRIOR``;
  beside them, on a page that has text in such an element, it loses ``BESIDE_PRIOR``.

A content node whose importance is low is removed from each page, so a branch goes when all its texts go.
Pages count once per distinct main text: copies of an article over a whole site are one page of the tree and
don't turn into a menu. Elements that are menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles or comments by tag, role, class or id go at any importance, since adverts that change with
every page look like content to an entropy.

A node is a 64-bit hash of its parent's hash and its style, so a page yields one number per block and its
work is linear in its length. Statistics are DataFrame aggregations keyed by (host, node, value), so a host with a third of all pages
is no hot spot. The removed content nodes of a host (texts of at least m ** 0.7 pages each, so few) meet its pages in one equi-join.

Defined cases: a null or empty html, and one without text, gives an empty text; a text in a node held by fewer
than ``LEAST_PAGES`` distinct pages of a host stays; unclosed tags end with their parent; elements nested deeper than
``DEEPEST`` are siblings; a null url is a host of its own; repeated rows get equal texts; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from slotwise.llm.common import kept
from slotwise.llm.url_filter import host_of

LEAST_PAGES = 5
LEAST_IMPORTANCE = 0.3
LAYOUT_SHARE = 0.1
KEPT_PRIOR = 0.2  # a text in an article goes only where about m ** 0.9 of its m pages hold it
BESIDE_PRIOR = 1.0  # beside an article, even a text of its own is of low importance
DEEPEST = 512
ROOT = 0

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td textarea tfoot th thead title tr ul video audio canvas iframe object".split()
)
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp", "template")
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section table ul".split()
)
ENDS_ALIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("article aside body div dl footer form header html main nav ol section table ul".split())
DROPPED_TAGS = frozenset(
    "script style noscript template iframe nav header footer aside form button select option textarea input dialog menu head title "
    "svg canvas object embed noembed noframes search".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar status note".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner popup modal overlay nav navbar "
    "navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets cookie cookies consent gdpr notice "
    "alert newsletter subscribe subscription signup login form search share sharing social comment comments disqus reply replies respond "
    "discussion related recommended pagination pager toolbar copyright".split()
)
KEPT_TAGS = ("article", "main")
PAGE_TAGS = frozenset(("html", "body", *KEPT_TAGS))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
RAW_END = {t: re.compile(rf"</{t}\s*[^>]*>|\Z", re.I) for t in RAW}
ATTRIBUTES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|\baria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
NAME_PARTS = re.compile(r"[a-z]+|\d+")
# What differs from page to page in a class or id: hexadecimal words with a digit, and digits.
PAGE_MARK = re.compile(r"(?<![a-z0-9])(?=[a-f]*\d)[0-9a-f]{8,}(?![a-z0-9])|\d+")
SPACE = re.compile(r"\s+")


def hashed(value: str, seed: int = 0) -> int:
    """64 bits, signed, as Spark's long."""
    bits = xxhash.xxh64_intdigest(value.encode("utf-8", "replace"), seed & (1 << 64) - 1)
    return bits - (1 << 64) if bits >> 63 else bits


class Page:
    """Blocks of a page in order: (node, text, inside a kept element, inside a dropped one); layouts: node -> hash of its children."""

    __slots__ = ("blocks", "layouts")

    def __init__(self, source: str):
        self.blocks: list[tuple[int, str, bool, bool]] = []
        self.layouts: dict[int, int] = {}
        stack: list[tuple[str, int, bool, bool]] = [("", ROOT, False, False)]
        opened: Counter[str] = Counter()
        parts: list[str] = []
        at, size = 0, len(source)

        def flush():
            if parts:
                # references are decoded after the markup is gone, so a decoded < is text
                text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
                parts.clear()
                if text:
                    self.blocks.append((stack[-1][1], text, stack[-1][2], stack[-1][3]))

        def end(depth: int):
            if any(x[0] in BLOCK for x in stack[depth:]):
                flush()
            opened.subtract(x[0] for x in stack[depth:])
            del stack[depth:]

        def close(tag: str, until: frozenset[str] | None = None):
            if opened[tag] <= 0:
                return
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    end(depth)
                    return
                if until and stack[depth][0] in until:
                    return

        while at < size:
            found = TOKEN.search(source, at)
            if not found:
                parts.append(source[at:])
                break
            if found.start() > at:
                parts.append(source[at : found.start()])
            at = found.end()
            closing, opening, attributes = found.groups()
            if closing:
                tag = closing.lower()
                if tag == "br" or tag == "p" and opened["p"] <= 0:
                    flush()
                else:
                    close(tag)
                continue
            if not opening:
                if found.group().startswith("<![CDATA["):
                    parts.append(found.group()[9:-3])
                continue
            tag = opening.lower()
            if tag in BLOCK:
                flush()
            if tag in VOID:
                continue
            if tag in ENDS_P:
                close("p", SCOPES)
            for alike in ENDS_ALIKE.get(tag, ()):
                close(alike, SCOPES)
            if attributes.endswith("/") and tag not in BLOCK:
                continue
            if tag in RAW:
                at = RAW_END[tag].search(source, at).end()
                continue
            if len(stack) > DEEPEST:
                end(DEEPEST)
            _, parent, *inside = stack[-1]
            name, keeps, drops = self.style(tag, attributes, inside)
            node = parent
            if tag in BLOCK or drops != inside[1]:
                flush()
                node = hashed(name, parent)
                self.layouts[parent] = hashed(name, self.layouts.get(parent, 0))
            stack.append((tag, node, keeps, drops))
            opened[tag] += 1
        flush()

    @staticmethod
    def style(tag: str, attributes: str, inside) -> tuple[str, bool, bool]:
        """(tag with its classes, id and role; inside a kept element; inside a dropped one)."""
        keeps, drops = inside[0] or tag in KEPT_TAGS, inside[1] or tag in DROPPED_TAGS
        if not attributes or attributes.isspace():
            return tag, keeps, drops
        marks = []
        for m in ATTRIBUTES.finditer(attributes):
            kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if kind == "role" or tag not in PAGE_TAGS:
                marks.append(f"{kind}={PAGE_MARK.sub('#', value)}")
            if kind == "role":
                keeps, drops = keeps or value in ("main", "article"), drops or value in DROPPED_ROLES
            elif tag not in ("html", "body") and not drops:
                drops = any(dropped_name(word) for word in value.split())
        drops = drops or HIDDEN.search(attributes) is not None
        return f"{tag}[{' '.join(marks)}]" if marks else tag, keeps, drops

    def candidates(self) -> list[tuple[int, int, str, int]]:
        """(node, hash of the text, text, place) of the blocks that aren't dropped; place: 1 inside a kept element,
        -1 beside one, 0 on a page without text in one."""
        left = [(node, text, keeps) for node, text, keeps, drops in self.blocks if not drops]
        beside = -1 if any(keeps for _, _, keeps in left) else 0
        return [(node, hashed(text), text, 1 if keeps else beside) for node, text, keeps in left]

    def main_text(self, removed: dict[tuple[int, int], float] | None = None) -> str:
        """The blocks of enough importance; ``removed`` holds that of the content nodes the site repeats, all others have 1."""
        prior = (0.0, KEPT_PRIOR, -BESIDE_PRIOR)
        value = lambda node, text: (removed or {}).get((node, text), 1.0)
        return " ".join(text for node, h, text, place in self.candidates() if value(node, h) + prior[place] >= LEAST_IMPORTANCE)

    def main_id(self) -> int:
        """Equal for pages of equal main text: that inside kept elements, or all where there are none."""
        seed = 0
        for _, _, text, place in self.candidates():
            seed = hashed(text, seed) if place >= 0 else seed
        return seed


def dropped_name(word: str) -> bool:
    """Whether a class or id names boilerplate: as a whole, or by its first or last part (``site-footer``)."""
    parts = NAME_PARTS.findall(word)
    return word in DROPPED_NAMES or bool(parts) and (parts[0] in DROPPED_NAMES or parts[-1] in DROPPED_NAMES or len(parts) > 1 and parts[-1].isdigit() and parts[-2] in DROPPED_NAMES)


def observations(pages: DataFrame) -> DataFrame:
    """(host, page, node, value, layout): the content nodes of each distinct page, once each.

    ``pages`` has host and html; ``page`` identifies the main text, so copies of a page are one.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["host", "page", "node", "value", "layout"]
        kinds = (pa.string(), *[pa.int64()] * 4)
        for batch in batches:
            rows: set[tuple] = set()
            for host, source in zip(batch["host"].to_pylist(), batch["html"], strict=True):
                page = Page(source.as_py() or "")
                main = page.main_id()
                rows.update((host, main, node, value, page.layouts.get(node, 0)) for node, value, _, place in page.candidates() if place >= 0)
                if len(rows) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return pages.select("host", "html").mapInArrow(read, "host string, page long, node long, value long, layout long")


def low_nodes(seen: DataFrame, least_pages: int = LEAST_PAGES, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """(host, node, value, importance): content nodes of low importance, before priors.

    ``seen`` is what ``observations`` gives. All groups are counted by partial sums.
    """
    once = kept(seen.groupBy("host", "page", "node", "value").agg(F.min("layout").alias("layout")), "style-seen")
    # Of a page's layouts in a node the smallest stands for all; copies of the page agree in it.
    pages = once.groupBy("host", "page", "node").agg(F.min("layout").alias("layout"))
    layouts = pages.groupBy("host", "node", "layout").agg(F.count(F.lit(1)).alias("n"))
    nodes = layouts.groupBy("host", "node").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    most = F.log("m")
    nodes = nodes.where(F.col("m") >= max(least_pages, 2)).select(
        F.col("host").alias("of_host"), F.col("node").alias("of_node"), "m", ((most - F.col("nlogn") / F.col("m")) / most).alias("layout")
    )
    # A text of one page has importance 1 whatever its node: only repeated ones go on.
    texts = once.groupBy("host", "node", "value").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    joined = texts.join(nodes, texts.host.eqNullSafe(F.col("of_host")) & (texts.node == F.col("of_node")))
    importance = (1 - LAYOUT_SHARE) * (1 - F.log("k") / F.log("m")) + LAYOUT_SHARE * F.col("layout")
    return joined.select("host", "node", "value", importance.alias("importance")).where(F.col("importance") < least)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    low = low_nodes(observations(rows)).groupBy("host").agg(F.collect_list(F.struct("node", "value", "importance")).alias("removed"))
    removed = kept(low, "style-low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                low_of = {}  # one table per host of the batch
                texts = []
                for host, source, nodes in zip(batch["host"].to_pylist(), batch["html"], batch["removed"], strict=True):
                    if host not in low_of:
                        low_of[host] = {(x["node"], x["value"]): x["importance"] for x in nodes.as_py() or ()}
                    texts.append(Page(source.as_py() or "").main_text(low_of[host]))
                yield pa.RecordBatch.from_arrays(
                    [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    joined = rows.join(removed.withColumnRenamed("host", "of_host"), F.col("host") == F.col("of_host"), "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "host", "html", "removed").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
