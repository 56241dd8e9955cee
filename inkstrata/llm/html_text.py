"""Main text of web pages by site template removal.

Every element subtree of a page has a hash of its tag, its class and id, and
what is inside.  Spark counts, for each host, on how many different pages a
subtree occurs; subtrees that recur on many pages of their host are template
and are deleted first, whatever they are called.  Then goes what is template by
its kind but filled differently on every page (menus, adverts, forms, comments
and the like): by its tag, role, class or id.  A class or id tells only where
all of its words do (``cookie-notice``, not ``notice-board``), and never takes
headings or running text out of an article.

The list of recurring subtrees of a host is bounded by what one page holds
(subtrees of a page / ``SHARE``), so it travels with the host's pages: as a
broadcast while the whole list is small, else by a join on the host, its rows
dealt to ``SALTS`` parts, so that no host's pages meet in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstrata.llm.common import materialise

#: A subtree is template if at least this share of its host's different pages, and this many, have it.
SHARE = 0.2
LEAST_PAGES = 5
#: Hashes (8 bytes each) that may be sent to every task; parts that a host's pages are dealt to beyond that.
BROADCAST_HASHES = 2_000_000
SALTS = 64

# Elements by what they are in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Running text of an article, never template inside it: many articles may quote the same passage.
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr tbody thead caption figcaption a b i em strong span u s code cite q sub sup small mark abbr time".split())
DROPPED = frozenset("head title nav footer aside form button select option input textarea script style noscript template iframe svg math object applet canvas audio video menu dialog noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices notification notifications alert alerts "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars footer header masthead topbar toolbar comment comments commentlist disqus respond replies reply discussion share sharing social related recommended "
    "recommendations newsletter subscribe subscription signup login popup modal overlay widget widgets pagination pager skip search searchbox".split()
)
#: Words that say nothing of their own beside one of NAMES.
BESIDE = frozenset("site page global main primary secondary top bottom left right inner outer wrap wrapper container box block section area bar list item items group row column col unit slot zone panel content links link buttons button icons form posts post articles stories thread text message sticky fixed mobile desktop js x s m l".split())
#: NAMES that an article's own parts bear as well.
OWN_PARTS = frozenset("header notice notices alert alerts search discussion respond promotion".split())
CLOSES_P = BLOCK - frozenset("body html head option optgroup caption tbody td tfoot th thead tr li dd dt legend summary figcaption title".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"), "thead": ("tbody",), "tfoot": ("tbody", "tr", "td", "th"), "optgroup": ("option", "optgroup")}
SCOPE = frozenset("ul ol dl table select menu article section main body html".split())
_P_ENDS = SCOPE | {"div", "td", "th", "li", "button"}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
#: What can still begin where no tag ends any more.
_LAST = re.compile(r"<!--.*|<[!?][^>]*", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_SPLIT = re.compile(r"[^a-z0-9]+")
_USED = frozenset(("class", "id", "role", "hidden", "aria-hidden", "style", "itemprop"))


def attributes(text: str) -> dict[str, str]:
    """The attributes of a tag that decide what it is."""
    if not text or text.isspace():
        return {}
    found = {}
    for m in _ATTRIBUTE.finditer(text):
        name = m[1].lower()
        if name in _USED and name not in found:
            found[name] = (m[2] or m[3] or m[4] or "").strip().lower()
    return found


class Node:
    """An open or closed element: hash of its subtree once closed."""

    __slots__ = ("block", "hash", "inside", "inline", "landmark", "open_p", "parent", "parts", "removable", "scope", "siblings", "tag", "unwanted")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent = tag, parent
        self.parts: list[str] = []
        self.hash = 0
        self.landmark = self.unwanted = self.removable = self.inside = False
        #: nearest block and nearest scope around the element, and whether an open paragraph is in reach
        self.block: Node = parent.block if parent and parent.tag not in BLOCK else parent or self
        self.scope: Node = parent.scope if parent and parent.tag not in SCOPE else parent or self
        self.open_p = tag == "p" or (parent is not None and parent.open_p and tag not in _P_ENDS)
        #: open elements by tag: inline ones of a block, list and table parts of a scope
        self.inline: dict[str, int] = {}
        self.siblings: dict[str, int] = {}


def is_unwanted(tag: str, own: dict[str, str], inside: bool) -> bool:
    """Menus, headers, footers, sidebars, notices, adverts, forms, comments and what is never shown."""
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if not own:
        return False
    if own.get("role", "") in ROLES or "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", ""):
        return tag not in ("html", "body")
    if tag in ("html", "body", "main") or (inside and tag in CONTENT):
        return False
    known = frozenset(("comment", "comments", "reply")) if tag == "article" else NAMES - OWN_PARTS if inside else NAMES
    for name in f"{own.get('class', '')} {own.get('id', '')}".split():
        words = [w for w in _SPLIT.split(name) if w and not w.isdigit()]
        if not known.isdisjoint(words) and all(w in known or w in BESIDE for w in words):
            return True
    return False


def parse(html: str) -> tuple[list[Node], list[tuple[Node, str | None]]]:
    """The elements of a page, and its texts in page order with their elements; None is a block's edge.

    Counts of open elements tell whether an end tag has something to close, so
    the work is linear in the page however deep it is.
    """
    root = Node("", None)
    top, nodes, runs, at, end = root, [], [], 0, len(html)
    blocks: dict[str, int] = {}
    last = html.rfind(">")

    def count(node: Node, by: int) -> None:
        for table in (blocks,) if node.tag in BLOCK else (node.block.inline,):
            table[node.tag] = table.get(node.tag, 0) + by
        if node.tag in SIBLINGS:
            node.scope.siblings[node.tag] = node.scope.siblings.get(node.tag, 0) + by

    def close(node: Node) -> Node:
        node.hash = xxhash.xxh3_64_intdigest("\x1f".join(node.parts)) - (1 << 63)
        count(node, -1)
        up = node.parent
        up.parts.append(str(node.hash))
        if node.tag in BLOCK:
            runs.append((up, None))
        return up

    def text(a: int, b: int) -> None:
        if a < b:
            value = html[a:b]
            runs.append((top, unescape(value) if "&" in value else value))
            if not value.isspace():
                top.parts.append(value)

    while at < end:
        m = (_TAG if at <= last else _LAST).search(html, at)
        if m is None:
            text(at, end)
            break
        text(at, m.start())
        at = m.end()
        tag = m.re is _TAG and (m[2] or m[5])
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            here = top if top.tag in BLOCK or top is root else top.block
            # an inline end tag doesn't close blocks
            if (blocks if tag in BLOCK else here.inline).get(tag, 0) > 0:
                while top.tag != tag:
                    top = close(top)
                top = close(top)
            elif tag == "p":
                runs.append((top, None))
            continue
        given = m[3] if m[2] else m[6]
        if tag in VOID:
            if tag == "hr":
                runs.append((top, None))
            elif tag == "br":
                runs.append((top, " "))
            top.parts.append(f"<{tag}>")
            continue
        if tag in CLOSES_P:
            if top.open_p:
                while top.tag != "p":
                    top = close(top)
                top = close(top)
        elif tag in SIBLINGS:
            scope = top if top.tag in SCOPE or top is root else top.scope
            left = sum(scope.siblings.get(t, 0) for t in SIBLINGS[tag])
            while left:
                left -= top.tag in SIBLINGS[tag]
                top = close(top)
        own = attributes(given)
        node = Node(tag, top)
        node.landmark = tag in ("article", "main") or own.get("role") == "main" or own.get("itemprop") == "articlebody"
        node.unwanted = is_unwanted(tag, own, top.inside)
        node.inside = top.inside or (node.landmark and not node.unwanted)
        node.removable = tag not in ("html", "body") and not node.landmark and not (top.inside and tag in CONTENT)
        node.parts += [tag, own.get("class", ""), own.get("id", "")]
        nodes.append(node)
        count(node, 1)
        if tag in BLOCK:
            runs.append((top, None))
        top = node
        if tag in RAW and not given.rstrip().endswith("/"):
            stop = _RAW_ENDS[tag].search(html, at)
            a, b = (stop.start(), stop.end()) if stop else (end, end)
            node.parts.append(html[at:a])
            at, top = b, close(node)
        elif given.endswith("/") and tag not in BLOCK:
            top = close(node)
    while top is not root:
        top = close(top)
    return nodes, runs


def template_hashes(html: str) -> list[int]:
    """Hashes of the subtrees with text that could be template, each once; what they are called plays no part."""
    nodes, runs = parse(html)
    shown = set()
    for node, value in runs:
        while value and node not in shown and node.parent is not None and not value.isspace():
            shown.add(node)
            node = node.parent
    return list({n.hash for n in nodes if n.removable and n in shown})


def main_text(html: str, templates: frozenset[int] = frozenset()) -> str:
    """Blocks of the page's article (of its body if it marks none) that are neither template nor unwanted.

    A form stays where it is the frame of the page: around an article, or
    around more than half of the text that is left.
    """
    nodes, runs = parse(html)
    # the method first: recurring subtrees go, by their counts alone
    gone = set()
    for n in nodes:  # parents come before their children
        if n.parent in gone or (n.removable and n.hash in templates):
            gone.add(n)
    size, holds = dict.fromkeys(nodes, 0), set()
    for node, value in runs:
        if value and node.parent is not None and node not in gone and not value.isspace():
            size[node] += len(value)
    for n in reversed(nodes):
        if n not in gone and (n.landmark or n in holds):
            holds.add(n.parent)
        if n.parent.parent is not None and not (n.unwanted and n.tag != "form"):
            size[n.parent] += size[n]
    most = sum(size[n] for n in nodes if n.parent.parent is None) / 2
    for n in nodes:
        frame = n.tag == "form" and not n.parent.inside and (n in holds or size[n] > most)
        if n.parent in gone or (n.unwanted and not frame):
            gone.add(n)
    marked = any((n.inside or n.landmark) and n not in gone for n in nodes)
    blocks, words = [], []
    for node, value in runs:
        if value is None:
            if words and (joined := " ".join("".join(words).split())):
                blocks.append(joined)
            words = []
        elif node not in gone and (node.inside or not marked):
            words.append(value)
    if words and (joined := " ".join("".join(words).split())):
        blocks.append(joined)
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    """Lower-cased host of a url; empty for null or a url without ``://``."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)), F.lit(""))


def templates(pages: DataFrame, share: float = SHARE, least: int = LEAST_PAGES) -> DataFrame:
    """(host, templates): the hashes of subtrees that recur on many different pages of a host.

    Copies of a page count once, so a page that a host serves many times does
    not turn its own article into template.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [template_hashes(h) for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), pa.array(found, pa.list_(pa.int64()))], ["host", "page", "hashes"])

    rows = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), F.coalesce("html", F.lit("")).alias("html"))
    # pages of one host and hash are copies: one of them is enough, and the counts below fold before they are shuffled
    seen = materialise(rows.mapInArrow(run, "host string, page long, hashes array<long>").groupBy("host", "page").agg(F.first("hashes").alias("hashes")), "subtrees")
    counts = seen.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    sizes = seen.groupBy("host").agg(F.count("*").alias("pages"))
    often = counts.join(sizes, "host").where(F.col("n") >= share * F.col("pages"))
    return materialise(often.groupBy("host").agg(F.collect_set("hash").alias("templates")), "templates")


def extract(pages: DataFrame, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null html counts as empty and has the empty text; a null url belongs to the
    empty host.  Repeated rows each get their row, an empty table gives none,
    other columns are not looked at, and the work is linear in a page's length.
    """
    found = templates(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = []
                for html, marks in zip(batch.column("html").to_pylist(), batch.column("templates").to_pylist(), strict=True):
                    texts.append(main_text(html, frozenset(marks or ())))
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    size = found.agg(F.coalesce(F.sum(F.size("templates")), F.lit(0))).first()[0]
    if size <= broadcast_hashes:
        joined = rows.join(F.broadcast(found), "host", "left")
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("html", "page_id"), F.lit(SALTS)))
        joined = salted.join(found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "templates").mapInArrow(run, "page_id long, url string, text string, n_chars long")
