"""Main text of web pages, with the templates of their sites removed.

A page is read once, by one pass over its tags. Blocks of text inside an article are the main text; what
stands in menus, headers, footers, side bars, notices, adverts, forms, comments, scripts or styles is
not. The element subtrees of every page, inside articles too, are hashed and counted per host in
Spark: those that recur across many different texts of a host are its template, and their blocks go. A
page whose article has nothing left, or that has none, keeps the blocks that no rule and no template takes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import materialize

#: Different page texts of a host that must hold a subtree for it to be template; a subtree of prose must be in this share of them besides, in percent.
MIN_PAGES, MIN_PERCENT = 10, 20

# What HTML says of elements.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption b i em strong a span u s q cite code small sub sup mark abbr time label font".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
_DROP = frozenset("head script style template noscript svg math canvas iframe object video audio select button form nav footer aside dialog menu textarea title datalist noembed noframes xmp".split())
_BLOCK = frozenset("address article aside blockquote body br center caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - frozenset("br caption option tbody td tfoot th thead tr body html legend summary".split())
_ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("table", "tr")), "th": frozenset(("table", "tr")), "option": frozenset(("select", "datalist"))}
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split())
# Whole class names of page furniture, and whole class names and ids of reader comments. A name that merely holds such a word
# ("ads-and-society") says nothing; the counts tell.
_FURNITURE = frozenset("ad ads advert adverts advertisement sponsored cookie-notice cookie-banner cookie-consent gdpr popup newsletter newsletter-signup subscribe sidebar side-bar navbar breadcrumb breadcrumbs site-nav site-footer site-header masthead login-form signup-form".split())
_COMMENTS = frozenset("comment comments comment-list commentlist comment-body comment-thread comment-section comments-area comments-section user-comment user-comments reader-comment reader-comments disqus disqus_thread respond".split())
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")


def _dropped(tag: str, attrs: str, in_article: bool) -> bool:
    """By its tag, role or visibility, or as a reader comment by the name that its class, id or microdata give it. Other names inside count only where they are one of _FURNITURE as a whole."""
    if tag in _DROP or (tag == "header" and not in_article):
        return True
    if "=" not in attrs and "hidden" not in attrs:
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.strip() in _ROLES):
            return True
        if tag in ("main", "body", "html"):
            continue
        if name in ("class", "id") and not _COMMENTS.isdisjoint(value.split()) or name == "itemprop" and "comment" in value.split() or name == "itemtype" and value.endswith("/comment"):
            return True
        if name == "class" and tag != "article" and not _FURNITURE.isdisjoint(value.split()):
            return True
    return False


def parse(page: str) -> tuple[list[tuple[str, bool, list[int]]], list[int]]:
    """(blocks, subtree hashes). A block is its text, whether it is in an article, and the indexes
    of the subtrees that hold it. Dropped elements are not blocks, and subtrees are hashed without them. The hashes' work is linear in the page, at any depth."""
    blocks: list[tuple[str, bool, list[int]]] = []
    hashes: list[xxhash.xxh3_64 | None] = []
    stack: list[tuple[str, bool, bool, int]] = []  # tag, dropped, in article, subtree
    prose: list[bool] = []
    words: list[str] = []
    drop = article = False

    def flush() -> None:
        if words:
            said = _SPACE.sub(" ", html.unescape("".join(words))).strip()
            words.clear()
            if said:
                trees = [s[3] for s in stack if s[3] >= 0]
                blocks.append((said, article, trees))

    def text(said: str) -> None:
        if said and not drop:
            words.append(said)
            if stack and stack[-1][3] >= 0 and not said.isspace():
                hashes[stack[-1][3]].update(said)

    def pop_to(k: int) -> None:
        nonlocal drop, article
        if not drop and any(s[0] in _BLOCK for s in stack[k:]):
            flush()
        for own, above in zip(reversed(stack[k:]), reversed([None, *stack][k:-1]), strict=True):  # what holds a subtree knows it by its hash
            if own[3] >= 0 and above and above[3] >= 0:
                hashes[above[3]].update(hashes[own[3]].digest())
        del stack[k:]
        drop, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)

    def end_of(tags: tuple[str, ...] | frozenset, scope: frozenset) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                return pop_to(k)
            if stack[k][0] in scope:
                return None

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        if lt > at:
            text(page[at:lt])
        m = _TOKEN.match(page, lt)
        if not m:
            text("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
            else:
                if tag in ("p", "br") and not drop:
                    flush()
            continue
        if tag in _CLOSES_P:
            end_of(("p",), frozenset(("button", "td", "th", "table", "article", "section", "div", "li")))
        if tag in _ENDS_SAME:
            end_of(_ENDS_SAME[tag], _SCOPE[tag])
        if tag in _BLOCK and not drop:
            flush()
        if tag in _VOID:
            continue
        inside = article or tag in ("article", "main")
        gone = drop or _dropped(tag, m[3], article) or (tag == "article" and any(s[0] == "article" for s in stack))  # inside an article stand readers' comments
        tree = -1
        if not gone and tag not in ("html", "body"):
            tree = len(hashes)
            hashes.append(xxhash.xxh3_64(tag))
            prose.append(tag in _PROSE)
        if tag in _RAW:  # up to its own end tag, whatever is inside
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else n
            continue
        if not m[3].rstrip().endswith("/") or tag not in ("svg", "math", "path"):
            stack.append((tag, gone, inside, tree))
            drop, article = gone, inside
    pop_to(0)
    flush()
    # The last bit of a hash tells what the subtree is: 1 for prose.
    return blocks, [(h.intdigest() >> 1 << 1 | p) - (1 << 63) for h, p in zip(hashes, prose, strict=True)]


_PARSED = pa.schema([("row_id", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("said", pa.int64()), ("blocks", pa.list_(pa.struct([("text", pa.string()), ("article", pa.bool_()), ("trees", pa.list_(pa.int64()))])))])
_TYPES = "row_id long, page_id long, url string, host string, said long, blocks array<struct<text:string,article:boolean,trees:array<long>>>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part, said, all_ = batch.slice(at, 500), [], []
            for page in part["html"]:
                blocks, hashes = parse(page.as_py() or "")
                main = [t for t, article, _ in blocks if article] or [t for t, _, _ in blocks]
                # What tells copies of an article from other pages: its text alone, not what stands around it.
                said.append(xxhash.xxh3_64_intdigest("\n".join(main).encode("utf-8", "surrogatepass")) - (1 << 63))
                all_.append([{"text": t, "article": article, "trees": sorted({hashes[k] for k in trees})} for t, article, trees in blocks])
            yield pa.RecordBatch.from_arrays([part["row_id"], part["page_id"], part["url"], part["host"], pa.array(said, pa.int64()), pa.array(all_, _PARSED.field("blocks").type)], schema=_PARSED)


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_percent: int = MIN_PERCENT) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages; text is empty if a page has none.

    The text: what articles hold without the parts that are never main text, one line a block, white
    space inside a block made one space, and without the blocks of which an enclosing subtree, inside the
    article or around it, recurs in min_pages different texts of their host, at any size of it. A subtree that is but prose (a paragraph, heading, list item,
    cell or inline element) must be in min_percent of the host's texts as well: articles quote
    passages from one another, and the more of them a host has the more often. Copies of an article are one text, so they stay. Pages without such a block in an
    article: the same of all their blocks. Reader comments go by structure (an article inside an article), microdata, or the whole name of
    their class or id.
    Null and empty html give an empty text; a null or odd url counts as one host; repeated rows
    each give a row. Broken markup is read as far as it goes.

    What is shuffled are hashes, counted by (host, hash, text) and then (host, hash), in parts: a host with
    a third of all pages is spread by its hashes. Pages meet only the hashes that they lose, by row;
    their texts are not shuffled while these are few enough to be broadcast.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    read = pages.select(F.monotonically_increasing_id().alias("row_id"), F.col("page_id").cast("long").alias("page_id"), F.col("url"), host.alias("host"), "html")
    rows = materialize(read.mapInArrow(_parsed, _TYPES), "pages")
    trees = rows.select("row_id", "host", "said", F.explode(F.array_distinct(F.flatten("blocks.trees"))).alias("hash"))
    sizes = rows.select("host", "said").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    template = (
        trees.select("host", "hash", "said").distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
        .join(sizes, "host").where((F.col("hash") % 2 == 0) | (100 * F.col("n") >= min_percent * F.col("texts"))).select("host", "hash")
    )
    template = materialize(template, "templates")
    gone = materialize(trees.join(template, ["host", "hash"], "left_semi").groupBy("row_id").agg(F.collect_list("hash").alias("gone")), "gone")
    left = F.filter("blocks", lambda b: F.col("gone").isNull() | ~F.arrays_overlap(b["trees"], F.col("gone")))
    main = F.filter("_left", lambda b: b["article"])
    text = F.array_join(F.when(F.size(main) > 0, F.transform(main, lambda b: b["text"])).otherwise(F.transform("_left", lambda b: b["text"])), "\n")
    kept = rows.join(gone, "row_id", "left").select("page_id", "url", left.alias("_left"))
    return kept.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
