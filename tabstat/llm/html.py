"""HTML extraction with site template removal.

A page is cut into its elements, and every element's subtree (tags and text) is
hashed. Subtrees are counted per host in Spark; those on many pages of a host,
in different articles, are its template and are deleted: near copies of one article
share their paragraphs too, and keep them. Elements that say
what they are (menus, headers, footers, notices, adverts, forms, comments) are
deleted on any page. Inside an element marked as the main article, boxes (sections,
lists, tables) that recur are deleted too; its headings and paragraphs are its text.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.llm import spread as S
from tabstat.llm.urls import host_of

#: A subtree is template on at least so many pages of a host: MIN_SHARE of a small host's, MANY, or MANY_SHARE of a large one's.
MIN_PAGES = 5
MIN_SHARE = 0.3
MANY = 50
MANY_SHARE = 0.02
#: ... and in different articles: as many (by a sketch of 64 bits) as half of its pages, and at least so many.
MIN_ARTICLES = 4
#: Templates of all hosts are broadcast up to this size, and joined by host beyond it.
BROADCAST_BYTES = 8 << 20

# Elements of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
FOREIGN = frozenset("svg math".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
BOXES = frozenset("aside blockquote center details dir div dl fieldset figure footer form header menu nav ol section table ul".split())
JUNK = frozenset("nav footer aside form head script style noscript template iframe button select input textarea dialog menu svg math object embed audio video canvas map xmp title noembed noframes".split())
JUNK_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
# Names by which boxes (never paragraphs, headings or cells) say what they are, as whole class names or ids ...
JUNK_NAMES = frozenset("ad ads advert adverts advertisement banner sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent notice gdpr popup modal newsletter subscribe signup login share sharing social related recommended comment comments comment-list comment-form disqus_thread replies respond pagination pager toolbar widget skip-link disclaimer copyright".split())
# ... and as the last part of one.
JUNK_ENDS = frozenset("ad ads advert advertisement banner nav navbar menu breadcrumbs sidebar footer newsletter popup modal pagination comments".split())
LAST_PART = re.compile(r"[-_]([a-z]+)$")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
_TITLE = re.compile(r"<title[^>]*>([^<]*)", re.I)



def says_junk(names: str) -> bool:
    """Whether a class or id names a box that is no part of the text."""
    return any(x in JUNK_NAMES or ((m := LAST_PART.search(x)) is not None and m[1] in JUNK_ENDS) for x in names.lower().split())


class Node:
    """An element: its children are nodes and strings. heading: a header, which is junk outside an article."""

    __slots__ = ("tag", "junk", "main", "heading", "children", "print")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children, self.print = tag, [], 0
        self.junk, self.main, self.heading = tag in JUNK, tag in ("article", "main"), tag == "header"
        if attributes and "=" in attributes or "hidden" in attributes:
            found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
            role = found.get("role", "").lower()
            self.main = self.main or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"
            if tag in BOXES:
                names = f"{found.get('class', '')} {found.get('id', '')}"
                self.heading = self.heading or any(x.rpartition("-")[2] == "header" for x in names.lower().split())
                self.junk = self.junk or (not self.main and says_junk(names))
            self.junk = self.junk or role in JUNK_ROLE or "hidden" in found or found.get("aria-hidden") == "true"


def parse(text: str) -> Node:
    """A tolerant tree of the page: end tags may be missing, crossed or extra. Takes time in proportion to the text."""
    root = Node("html")
    stack, at = [root], 0
    # Places in the stack of the open elements of each name, and of the open blocks.
    open_: dict[str, list[int]] = {}
    blocks: list[int] = []

    def cut(depth: int) -> None:
        while len(stack) > depth:
            tag = stack.pop().tag
            open_[tag].pop()
            if tag in BLOCKS:
                blocks.pop()

    while m := _TOKEN.search(text, at):
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            # An inline end tag never closes the block around it.
            if open_.get(tag) and (tag in BLOCKS or not blocks or open_[tag][-1] > blocks[-1]):
                cut(open_[tag][-1])
            continue
        if tag in BLOCKS:
            for own in FOREIGN:
                if open_.get(own):
                    cut(open_[own][-1])
            # A block ends an open paragraph, with whatever inline elements hang in it.
            if blocks and stack[blocks[-1]].tag == "p":
                cut(blocks[-1])
        if tag in ("li", "dd", "dt", "tr", "td", "th", "option") and stack[-1].tag == tag:
            cut(len(stack) - 1)
        node = Node(tag, m[3] or "")
        stack[-1].children.append(node)
        closed = (m[3] or "").endswith("/")
        if tag in RAW:
            # Without an end the element is empty, and what follows is the page's.
            end = None if closed else re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(text, at)
            at = end.end() if end else at
        elif tag not in VOID and not closed:
            open_.setdefault(tag, []).append(len(stack))
            if tag in BLOCKS:
                blocks.append(len(stack))
            stack.append(node)
    if at < len(text):
        stack[-1].children.append(text[at:])
    return root


def walk(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out = [root]
    for node in out:
        out += [x for x in node.children if isinstance(x, Node)]
    return out


def subtrees(root: Node) -> set[int]:
    """Hashes of the elements that a template may have; sets each node's print.

    Those are elements with text and without junk or a main element, outside of
    main elements all of them, inside only boxes without the h1.
    """
    order = [(root, False)]
    for node, inside in order:
        if not node.junk and (inside or not node.heading):
            order += [(x, inside or node.main) for x in node.children if isinstance(x, Node)]
    found, sizes, clear_, titled = set(), {}, {}, set()
    for node, inside in reversed(order):
        skip = node.junk or (node.heading and not inside)
        h, size, clear = xxhash.xxh64(node.tag), 0, not skip
        if clear:
            for child in node.children:
                if isinstance(child, Node):
                    h.update(b"\x01%d" % child.print)
                    size += sizes.pop(id(child))
                    clear &= clear_.pop(id(child))
                    if id(child) in titled:
                        titled.add(id(node))
                else:
                    plain = _SPACE.sub(" ", child).strip()
                    h.update(b"\x02" + plain.encode("utf-8", "surrogatepass"))
                    size += len(plain)
            node.print = h.intdigest() & 0x7FFFFFFFFFFFFFFF
        if node.tag == "h1":
            titled.add(id(node))
        sizes[id(node)], clear_[id(node)] = size, skip or (clear and not node.main)
        if clear and size and not node.main and node.tag not in ("html", "body") and (node.tag in BOXES and id(node) not in titled if inside else True):
            found.add(node.print)
    return found


def _plain(node: Node) -> str:
    return _SPACE.sub(" ", " ".join(x for n in walk(node) for x in n.children if isinstance(x, str))).strip()


def context_of(root: Node, text: str, url: str) -> int:
    """A hash of what tells articles apart: title, h1 and the first paragraph inside a marked element; the url, if the page has none of them."""
    m = _TITLE.search(text)
    parts, order, heads = [_SPACE.sub(" ", m[1]).strip() if m else "", "", ""], [(root, False)], []
    while order:
        node, inside = order.pop()
        if node.tag == "h1":
            heads.append(_plain(node))
        elif inside and node.tag == "p" and not parts[2]:
            parts[2] = _plain(node)
        if not (node.junk or (inside and node.tag in BOXES)):
            order += [(x, inside or node.main) for x in reversed(node.children) if isinstance(x, Node)]
    parts[1] = heads[0] if heads else ""
    return xxhash.xxh64_intdigest("\n".join(parts if any(parts) else ["", "", "", url]).encode("utf-8", "surrogatepass"))


def main_text(root: Node, template: set[int] | frozenset[int] = frozenset()) -> str:
    """Blocks of the main elements (of the page, if it has none), joined by an empty line."""
    mains: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node.main and not node.junk:
            mains.append(node)
        elif not (node.junk or node.heading):
            todo += [x for x in reversed(node.children) if isinstance(x, Node)]
    # <main> may wrap the article with other things: the innermost marked elements count.
    inner = []
    for node in mains:
        articles = [x for x in walk(node)[1:] if x.tag == "article"] if node.tag != "article" else []
        inner += articles if len(articles) == 1 else [node]
    blocks: list[str] = []
    piece: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(piece))).strip()
        if text:
            blocks.append(text)
        piece.clear()

    for top in inner or [root]:
        steps: list = [top]
        while steps:
            item = steps.pop()
            if item is None:
                end()
            elif isinstance(item, str):
                piece.append(item)
            elif item is not top and (item.junk or (item.heading and not inner) or (item.print in template and (not inner or item.tag in BOXES) and not item.main)):
                if item.tag in BLOCKS:
                    end()
            elif item.tag == "br":
                piece.append(" ")
            else:
                block = item.tag in BLOCKS
                if block:
                    end()
                    steps.append(None)
                steps += reversed(item.children)
        end()
    return "\n\n".join(blocks)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many: int = MANY, many_share: float = MANY_SHARE, min_articles: int = MIN_ARTICLES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Main text of every page: ``id``, ``url``, ``text``, one row per input row.

    Character references are decoded, white space inside a block becomes one space,
    and blocks are joined by an empty line. Template subtrees are looked up by host:
    those on min_pages pages, on min_share of a host's pages (or on ``many`` of them,
    or many_share of a host with more), in at least min_articles articles and half as
    many as pages. What tells articles apart is context_of.

    Null or empty html gives an empty text. Pages without a host share the empty
    host. Repeated rows each get their row and each count as a page. Pages of any
    length are parsed whole. Other columns are not read.
    """
    S.tune(pages.sparkSession)
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html")).withColumn("host", host_of(F.col("url")))

    def count(batches):
        for batch in batches:
            host, text, url = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
            found: dict[tuple[str, int], list[int]] = {}
            for i, h in enumerate(host):
                page = text[i].as_py() or ""
                root = parse(page)
                bit = 1 << (context_of(root, page, url[i] or "") & 63)
                # -1 counts the pages themselves.
                for p in subtrees(root) | {-1}:
                    own = found.setdefault((h, p), [0, 0])
                    own[0] += 1
                    own[1] |= bit
            articles = np.array([v[1] for v in found.values()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"host": pa.array([k[0] for k in found], pa.string()), "subtree": pa.array([k[1] for k in found], pa.int64()), "n": pa.array([v[0] for v in found.values()], pa.int64()), "articles": pa.array(articles)})

    scratch = S.Scratch(pages.sparkSession)
    counts = rows.select("host", "html", "url").mapInArrow(S.lean(count), "host string, subtree bigint, n bigint, articles bigint").groupBy("host", "subtree").agg(F.sum("n").alias("n"), F.bit_count(F.bit_or("articles")).alias("bits"))
    # So many bits of 64 mean some 177 articles, near all that the sketch can tell.
    differ = (F.col("bits") >= 60) | ((F.col("bits") >= min_articles) & (-128 * F.log(1 - F.col("bits") / 64) >= F.col("n")))
    counts = scratch.table(counts.where((F.col("subtree") == -1) | ((F.col("n") >= min_pages) & differ)))
    hosts = counts.where("subtree = -1").select("host", F.col("n").alias("pages"))
    bound = F.greatest(F.lit(float(min_pages)), F.least(F.col("pages") * min_share, F.greatest(F.lit(float(many)), F.col("pages") * many_share)))
    # A subtree of the list is on many_share of its host's pages at least, or on `many`: a host's list is bounded by a page's elements over that share.
    lists = counts.where("subtree <> -1").join(hosts, "host").where(F.col("n") >= bound).groupBy("host").agg(F.collect_list("subtree").alias("template"))
    lists = scratch.keep(scratch.table(lists))
    scratch.free()
    total = lists.agg(F.sum(F.size("template") * 8 + F.octet_length("host"))).first()[0] or 0
    rows = rows.join(F.broadcast(lists) if total <= broadcast_bytes else lists.hint("merge"), "host", "left").select("id", "url", "html", "template")

    def strip(batches):
        for batch in batches:
            out, templates = [], batch.column(3)
            for i, text in enumerate(batch.column(2)):
                page, own = parse(text.as_py() or ""), templates[i].as_py()
                if own:
                    subtrees(page)
                out.append(main_text(page, frozenset(own or ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["id", "url", "text"])

    return rows.mapInArrow(S.lean(strip), f"id {rows.schema['id'].dataType.simpleString()}, url string, text string")
