"""Main text of web pages by site template removal.

A page is read into a tree of elements. Every element with text gets a hash of its subtree (tags, class, id, texts; no scripts).
Spark counts, for each host, on how many different pages a subtree stands (pages with the same content count once, so that
copies don't make a template); subtrees on many pages of the host are its template and are deleted. Blocks of text inside the
page's article (paragraphs, headings, lists, tables, quotes) are kept though they recur: a passage that several articles quote is no template. What is left of the article,
or of the body where there is none, is the text, without elements that are boilerplate by their nature (menus, forms, adverts,
comments ...), as tags, roles, classes and ids name them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

MIN_PAGES = 4
SHARE = 0.1
#: Rows of the table of templates up to which it is sent to all executors (some 16 bytes each); beyond, it is joined.
BROADCAST_ROWS = 200_000

_TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)[^>]*>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Elements by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl li dd dt blockquote pre table tbody thead tfoot tr td th caption figure figcaption hgroup".split())
CLOSES_P = BLOCK - {"body", "head", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend"}
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
HOLDS = {"li": frozenset(("ul", "ol", "menu")), "dd": frozenset(("dl",)), "dt": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("table", "tr")), "th": frozenset(("table", "tr")), "option": frozenset(("select",)), "body": frozenset(("html",))}
NOISE = frozenset("nav footer aside form script style noscript template iframe button select textarea title head svg canvas dialog object audio video menu input".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
NOISE_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo sidebar menu navbar nav navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice banner popup modal comment comments disqus replies share sharing social related newsletter subscribe signup widget toolbar pagination pager masthead".split())


@dataclass
class Page:
    """Elements in page order (an element's parent stands before it) and blocks of text with the element they stand in."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    noise: list[bool] = field(default_factory=list)
    digest: list[int] = field(default_factory=list)
    blocks: list[tuple[str, int]] = field(default_factory=list)


def _noise(tag: str, attrs: str) -> tuple[bool, str]:
    """Whether an element is boilerplate by its nature, and its class and id."""
    if tag in NOISE:
        return True, ""
    if not attrs:
        return False, ""
    named, noisy = "", False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            named += f" {name}={value}"
            if tag not in ("html", "body", "article", "main") or name == "class":
                noisy |= not NOISE_NAMES.isdisjoint(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()))
        elif name == "role":
            noisy |= value.lower() in NOISE_ROLES
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            noisy = True
    return noisy and tag not in ("html", "body"), named


def read_page(html: str | None) -> Page:
    """The tree of a page, however broken: unknown ends are ignored, open elements end with what holds them."""
    page = Page([-1], ["#"], [False], [0], [])
    stack, sums = [0], [[b"#"]]
    text: list[str] = []
    block_at = 0

    def flush() -> None:
        nonlocal text
        if text:
            block = " ".join("".join(text).split())
            text = []
            if block:
                page.blocks.append((block, block_at))
                sums[-1].append(block.encode("utf-8", "surrogatepass"))

    def close(to: int) -> None:
        """Ends all elements from place ``to`` of the stack on."""
        while len(stack) > to:
            if page.tag[stack[-1]] in BLOCK or page.noise[stack[-1]]:
                flush()
            node, parts = stack.pop(), sums.pop()
            if page.tag[node] in BLOCK and len(parts) > 1:
                page.digest[node] = xxhash.xxh64_intdigest(b"\0".join(parts)) - (1 << 63)
                sums[-1].append(page.digest[node].to_bytes(8, "big", signed=True))
            elif page.tag[node] not in BLOCK:
                sums[-1] += parts[1:]

    def find(tags: tuple[str, ...] | frozenset[str], until: frozenset[str]) -> int:
        """The lowest place of the stack with one of the tags above any of ``until``; 0 if none."""
        best = 0
        for k in range(len(stack) - 1, 0, -1):
            t = page.tag[stack[k]]
            if t in until:
                break
            if t in tags:
                best = k
        return best

    scope = frozenset("article main section div aside nav footer header td th table ul ol dl body html form".split())
    at, source = 0, html or ""
    for m in _TAG.finditer(source):
        if m.start() < at:
            continue
        if m.start() > at:
            part = source[at : m.start()]
            if not text:
                block_at = stack[-1]
            text.append(unescape(part) if "&" in part else part)
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if m[1]:
            if tag == "br":
                text.append(" ")
            for k in range(len(stack) - 1, 0, -1):
                t = page.tag[stack[k]]
                if t == tag:
                    close(k)
                    break
                if tag not in BLOCK and t in scope:
                    break
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P and (k := find(("p",), scope)):
                close(k)
            if tag in CLOSES and (k := find(CLOSES[tag], HOLDS[tag])):
                close(k)
        elif tag == "br":
            text.append(" ")
        if tag in VOID:
            continue
        noise, named = _noise(tag, m[3])
        if noise and tag not in BLOCK:
            # its text must not join that around it
            flush()
        page.parent.append(stack[-1])
        page.tag.append(tag)
        page.noise.append(noise)
        page.digest.append(0)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}", re.I).search(source, at)
            at = end.start() if end else len(source)
            if end:
                at = (source.find(">", at) + 1) or len(source)
            continue
        if m[3].endswith("/") and tag in ("svg", "path", "rect", "circle", "use", "g"):
            continue
        stack.append(len(page.tag) - 1)
        sums.append([f"{tag}{named}".encode("utf-8", "surrogatepass")])
    if at < len(source):
        if not text:
            block_at = stack[-1]
        text.append(unescape(source[at:]))
    flush()
    close(1)
    return page


def _marks(page: Page) -> tuple[list[bool], list[bool], bool]:
    """For each element: whether it is in boilerplate, whether it is in an article; whether there is an article."""
    noisy, inside = [False], [False]
    for k in range(1, len(page.tag)):
        p = page.parent[k]
        header = page.tag[k] == "header" and not inside[p]
        noisy.append(noisy[p] or page.noise[k] or header)
        inside.append(inside[p] or page.tag[k] in ("article", "main") and not noisy[k])
    return noisy, inside, any(inside)


def subtrees(page: Page) -> tuple[int, list[int]]:
    """A hash of the page's own content, and the different subtrees that may be template."""
    noisy, inside, article = _marks(page)
    own = xxhash.xxh64_intdigest("\n".join(t for t, k in page.blocks if not noisy[k] and (inside[k] or not article)).encode("utf-8", "surrogatepass"))
    holds = set()
    for k in range(len(page.tag) - 1, 0, -1):
        if page.tag[k] in ("article", "main", "body", "html") or k in holds:
            holds.add(page.parent[k])
    found = {page.digest[k] for k in range(1, len(page.tag)) if page.digest[k] and k not in holds and page.tag[k] not in ("article", "main", "body", "html") and not (inside[k] and page.tag[k] in TEXT and not noisy[k])}
    return own - (1 << 63), sorted(found)


def main_text(page: Page, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The blocks that are left, in page order, one a line."""
    noisy, inside, article = _marks(page)
    gone = [False]
    for k in range(1, len(page.tag)):
        keep = inside[k] and page.tag[k] in TEXT and not noisy[k]
        gone.append(gone[page.parent[k]] or noisy[k] or (page.digest[k] in template and not keep))
    return "\n".join(t for t, k in page.blocks if not gone[k] and (inside[k] or not article))


def host(url: str | None) -> str:
    """The host of an address in lower case, without user, port and a leading www."""
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower().removeprefix("www.") if m else ""


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, own, trees = [], [], []
        for u, h in zip(batch.column(0), batch.column(1)):
            content, found = subtrees(read_page(h.as_py()))
            hosts.append(host(u.as_py()))
            own.append(content)
            trees.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(own, pa.int64()), pa.array(trees, pa.list_(pa.int64()))], ["host", "content", "trees"])


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value if shared else {}
        for batch in batches:
            marks = batch.column(3) if batch.num_columns > 3 else [None] * batch.num_rows
            out = []
            for u, h, own in zip(batch.column(1), batch.column(2), marks):
                template = known.get(host(u.as_py()), frozenset()) if shared else set(own.as_py() or ())
                out.append(main_text(read_page(h.as_py()), template))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["id", "url", "text", "n_chars"])

    return run


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE, scratch: Scratch | None = None) -> DataFrame:
    """``(host, tree)``: subtrees on at least ``min_pages`` different pages and ``share`` of the different pages of a host."""
    scratch = scratch or Scratch(pages.sparkSession)
    rows = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(_read, "host string, content long, trees array<long>")
    rows = scratch.save(rows)
    each = rows.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    found = rows.select("host", "content", F.explode("trees").alias("tree")).distinct().groupBy("host", "tree").agg(F.count(F.lit(1)).alias("n"))
    return found.filter(F.col("n") >= min_pages).join(each, "host").filter(F.col("n") >= share * F.col("pages")).select("host", "tree")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE, broadcast_rows: int = BROADCAST_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """A row for each page: id, url, ``text`` (blocks joined by line feeds, empty if there are none) and ``n_chars``.

    Null html is an empty page; pages without a host are a host of their own. Rows that repeat pass as they are. Extra columns
    are ignored; an empty table gives an empty one.
    """
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, url string, text string, n_chars long"
    found = scratch.save(templates(rows, "url", "html", min_pages, share, scratch))
    if found.count() <= broadcast_rows:
        known: dict[str, set[int]] = {}
        for r in found.collect():
            known.setdefault(r["host"], set()).add(r["tree"])
        out = rows.mapInArrow(_extract(spark.sparkContext.broadcast(known)), kind)
    else:
        key = F.xxhash64("url", "html").alias("key")
        trees = rows.select(key, "url", "html").mapInArrow(_trees, "key long, host string, trees array<long>").select("key", "host", F.explode("trees").alias("tree"))
        marks = trees.distinct().join(found, ["host", "tree"]).groupBy("key").agg(F.collect_list("tree").alias("marks"))
        out = rows.select("id", "url", "html", key).join(marks, "key", "left").select("id", "url", "html", "marks").mapInArrow(_extract(None), kind)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(_read(iter([batch.select([1, 2])])))[0]
        yield pa.RecordBatch.from_arrays([batch.column(0), found.column(0), found.column(2)], ["key", "host", "trees"])
