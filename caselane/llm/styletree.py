"""Main text of web pages by site style trees.

The pages of a host are merged into one tree whose nodes are paths of presentation styles (tag, role, class words). For
each node the tree counts pages, contents and child sequences. Its importance combines the entropy of its presentation and of its
contents, 1 - sum(n log n) / (N log N), over the pages that have it: what looks and reads the same everywhere is low, what
differs from page to page is high. Pages of a host whose main content is the same count once, so copies of an article do not
make it boilerplate. Styles that declare themselves (nav, footer, adverts, comments, scripts, ...) have importance 0. A prior
of 1 have the declared main element (article, main), what holds it, the page title in it (h1) and its bulk: a style that
holds half or more of the main text on half or more of its pages. Everything else, inside main content as outside, is judged by its
entropy; a node that fewer than ``FEW`` distinct pages have proves nothing and keeps the importance of a neutral style. Each page is
then cut at its low nodes, and the text of what is left is read, only of declared main content where the page has some.

Pages are folded by host and hash of their main content (of the html where none is declared). Counting is a two-level aggregate over (host, node, content) with map-side folding, so a host with a third of all pages is
no hot task. Only the low nodes of each host are joined to its pages: the table has been written, so Spark broadcasts it
below its own size limit and joins by shuffle, splitting hot hosts, above.

Defined cases: null html is an empty page, whose text is empty; a null url is a host of its own; repeated rows are pages
of their own; text cut off in the middle of a tag is left out; an empty table gives an empty result. A page without
declared main content gives all its blocks that are not low. A line break within a block is white space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from caselane.llm.rows import objects
from caselane.session import written

FEW = 8  # pages that a node must have to be judged by its entropy
LOW = 0.3  # importance below which a branch goes
BULK = 0.5  # share of a page's main text from which on a style is its bulk; share of its pages on which it must be
CONTENT = 0.9  # weight of contents against presentation

# How styles declare themselves.
RAW = ("script", "style", "template", "noscript", "svg", "math", "iframe", "object", "canvas", "textarea", "title")
NOISE_TAGS = frozenset((*RAW, "head", "nav", "footer", "header", "aside", "menu", "dialog", "form", "button", "select", "input", "label", "option", "audio", "video"))
NOISE_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar", "form", "toolbar"))
NOISE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promotion
    nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar sidebars aside widget widgets
    notice notices cookie cookies consent gdpr popup modal alert comment comments discussion disqus reply replies respond
    share sharing social related recommended newsletter subscribe signup login search pagination pager""".split())
NOISE_ARTICLES = frozenset("comment comments reply replies ad ads advert advertisement sponsored promo related".split())
ONLY_SAID = frozenset("has with no without is".split())  # "has-sidebar" is no sidebar
MAIN_TAGS, MAIN_ROLES = frozenset(("article", "main")), frozenset(("article", "main"))
TITLE = "h1"
ROOTS = frozenset(("html", "body"))  # never a branch to cut
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rt rp s samp
    small span strike strong sub sup time tt u var wbr""".split())
CLOSES_P = frozenset("""address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5
    h6 header hr main menu nav ol p pre section table ul""".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*>|<|[^<]+", re.S)
CUT_OFF = re.compile(r"<[/!?a-zA-Z]")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
NEUTRAL, NOISE, MAIN = 0, 1, 2
NODES = pa.list_(pa.struct([("node", pa.int64()), ("kind", pa.int64()), ("content", pa.int64()), ("children", pa.int64()), ("first", pa.bool_()), ("bulk", pa.bool_())]))


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


def style(tag: str, source: str) -> tuple[str, int]:
    """The presentation style of an element and what it declares itself to be."""
    if tag in NOISE_TAGS:
        return tag, NOISE
    if not source.strip():
        return tag, MAIN if tag in MAIN_TAGS else NEUTRAL
    found = attributes(source)
    named = re.sub(r"\d+", "0", f"{found.get('class', '')} {found.get('id', '')}".lower()).split()
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    parts = [re.split(r"[^a-z]+", name) for name in named]
    words = {w for part in parts if part[0] not in ONLY_SAID for w in part}
    is_main = tag in MAIN_TAGS or role in MAIN_ROLES
    if tag in ROOTS:
        kind = NEUTRAL
    elif hidden or role in NOISE_ROLES or words & (NOISE_ARTICLES if is_main else NOISE_WORDS):
        kind = NOISE
    else:
        kind = MAIN if is_main else NEUTRAL
    return f"{tag}.{'.'.join(sorted(named))}#{role}", kind


def events(html: str) -> Iterator[tuple]:
    """("open", tag, path, kind), ("text", text) and ("close", tag) of a page, with unclosed elements closed as browsers do."""
    stack: list[tuple[str, int]] = []
    at, size = 0, html.rfind(">") + 1  # what follows the last tag is text, up to a tag that is cut off
    rest = CUT_OFF.split(html[size:], maxsplit=1)[0]

    def closing(until: int):
        while len(stack) > until:
            yield "close", stack.pop()[0]

    while at < size:
        found = TOKEN.match(html, at, size)
        at = found.end()
        tag = found[2]
        if tag is None:
            if html[found.start()] != "<":
                yield "text", found[0]
            elif found[0] == "<":
                yield "text", "<"
            elif found[0].startswith("<!--") and not found[0].endswith("-->"):
                rest = ""
            continue
        tag = tag.lower()
        if found[1]:
            names = [t for t, _ in stack]
            if tag in names:
                yield from closing(len(names) - 1 - names[::-1].index(tag))
            continue
        if tag == "body" and any(t == "head" for t, _ in stack):
            yield from closing([t for t, _ in stack].index("head"))
        if tag in CLOSES_P or tag == "li":
            names = [t for t, _ in stack]
            same = ("p",) if tag != "li" else ("li",)
            for k in range(len(names) - 1, -1, -1):
                if names[k] in same:
                    yield from closing(k)
                    break
                if names[k] not in INLINE:
                    break
        look, kind = style(tag, found[3])
        path = crc32(look.encode("utf-8", "replace"), stack[-1][1] if stack else 0)
        yield "open", tag, path, kind
        if tag in VOID or found[3].endswith("/"):
            yield "close", tag
        elif tag in RAW_END:
            end = RAW_END[tag].search(html, at)
            at, rest = (end.end(), rest) if end else (size, "")
            yield "close", tag
        else:
            stack.append((tag, path))
    if rest:
        yield "text", rest
    yield from closing(0)


def page_nodes(html: str) -> tuple[list[tuple[int, int, int, int]], frozenset[int], bytes]:
    """(path, kind, hash of the content, hash of the child styles) of each branch down to the first that declares itself noise;
    the paths that are the bulk of the main content; a digest of the main content, empty if none is declared.

    Of kind MAIN are the declared main elements, what holds them and the title in them.
    """
    out, open_, depth, within, total = [], [], 0, 0, 0
    sizes: dict[int, int] = {}
    digest = blake2b(digest_size=8)
    for event in events(html):
        if event[0] == "open":
            _, tag, path, kind = event
            if open_ and not depth:
                open_[-1][3] = crc32(path.to_bytes(4, "little"), open_[-1][3])
            if depth or kind == NOISE:
                if not depth and tag not in INLINE:
                    out.append((path, kind, 0, 0))
                depth += 1
            elif tag not in INLINE and tag not in ROOTS:
                declared = kind == MAIN
                if declared:
                    for entry in open_:
                        entry[1] = MAIN
                elif within and tag == TITLE:
                    kind = MAIN
                open_.append([path, kind, 0, 0, tag, declared])
                within += declared
        elif event[0] == "close":
            if depth:
                depth -= 1
            elif open_ and open_[-1][4] == event[1]:
                path, kind, content, children, _, declared = open_.pop()
                out.append((path, kind, content, children))
                within -= declared
        elif not depth:
            code = " ".join(event[1].split()).encode("utf-8", "replace")
            if code:
                for entry in open_:
                    entry[2] = crc32(code, entry[2])
                if within:
                    digest.update(code + b"\n")
                    total += len(code)
                    for path in {entry[0] for entry in open_}:
                        sizes[path] = sizes.get(path, 0) + len(code)
    return out, frozenset(p for p, size in sizes.items() if size >= BULK * total), digest.digest() if total else b""


def page_text(html: str, low: frozenset[int]) -> str:
    """The blocks of a page outside its low branches, of declared main content where there is some."""
    all_blocks, main_blocks, current = [], [], []
    depth = main = 0
    kinds: list[bool] = []

    def ended():
        block = " ".join(unescape("".join(current)).split())
        current.clear()
        if block:
            all_blocks.append(block)
            if main:
                main_blocks.append(block)

    for event in events(html):
        if event[0] == "text":
            if not depth:
                current.append(event[1])
            continue
        tag = event[1]
        if event[0] == "open":
            if depth or event[3] == NOISE or event[2] in low:
                if not depth and tag not in INLINE:
                    ended()
                depth += 1
                continue
            if tag in INLINE:
                if tag == "br":
                    current.append(" ")
                kinds.append(False)
                continue
            ended()
            kinds.append(event[3] == MAIN)
            main += kinds[-1]
        elif depth:
            depth -= 1
        else:
            if tag not in INLINE:
                ended()
            main -= kinds.pop()
    ended()
    return "\n".join(main_blocks or all_blocks)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, node, kind, pages, importance: the merged trees of all hosts."""
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, marks = [], []
            for html in objects(batch.column(1)):
                branches, bulk, mark = page_nodes(html or "")
                seen, rows = set(), []
                for path, kind, content, children in branches:
                    first = path not in seen
                    rows.append({"node": path, "kind": kind, "content": content, "children": children, "first": first, "bulk": first and path in bulk})
                    seen.add(path)
                found.append(rows)
                marks.append(mark or blake2b((html or "").encode("utf-8", "replace"), digest_size=8).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary()), pa.array(found, NODES)], ["host", "mark", "nodes"])

    marked = pages.select(host(F.col("url")).alias("host"), "html")
    whole = marked.mapInArrow(nodes, "host string, mark binary, nodes array<struct<node:long,kind:long,content:long,children:long,first:boolean,bulk:boolean>>")
    once = whole.groupBy("host", "mark").agg(F.min("nodes").alias("nodes"))  # a page and its copies on a host
    found = once.select("host", F.explode("nodes").alias("n")).select("host", "n.*")
    each = found.select("host", "node", "kind", "first", "bulk", F.explode(F.array(F.struct(F.lit(True).alias("is_content"), F.col("content").alias("value")),
                                                                           F.struct(F.lit(False).alias("is_content"), F.col("children").alias("value")))).alias("f"))
    alike = each.groupBy("host", "node", "f.is_content", "f.value").agg(
        F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind"), F.sum(F.col("first").cast("long")).alias("firsts"),
        F.sum(F.col("bulk").cast("long")).alias("bulks"))
    n = F.col("n").cast("double")
    tree = alike.groupBy("host", "node").agg(
        F.max("kind").alias("kind"), F.sum(F.when(F.col("is_content"), F.col("firsts"))).alias("pages"), F.sum(F.when(F.col("is_content"), n)).alias("times"),
        F.sum(F.when(F.col("is_content"), F.col("bulks"))).alias("bulks"),
        F.sum(F.when(F.col("is_content"), n * F.log(n))).alias("repeats"), F.sum(F.when(~F.col("is_content"), n * F.log(n))).alias("shapes"))
    most = F.col("times") * F.log("times")
    contents, presentation = 1 - F.col("repeats") / most, 1 - F.col("shapes") / most
    judged = F.when(F.col("pages") < FEW, F.lit(1.0)).otherwise(CONTENT * contents + (1 - CONTENT) * presentation)
    known = (F.col("kind") == MAIN) | (F.col("bulks") >= BULK * F.col("pages"))
    importance = F.when(F.col("kind") == NOISE, F.lit(0.0)).when(known, F.lit(1.0)).otherwise(judged)
    return tree.select("host", "node", "kind", "pages", importance.alias("importance"))


def main_text(pages: DataFrame, low: float = LOW) -> DataFrame:
    """page_id, url, text: the main text of every page after pruning the low branches of its host's tree."""
    cut = written(style_tree(pages).filter(F.col("importance") < low).groupBy("host")
                  .agg(F.collect_set("node").alias("low")), "low-branches")  # styles of one host, not pages

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(html or "", frozenset(nodes or ())) for html, nodes in zip(objects(batch.column(2)), objects(batch.column(3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    return rows.join(cut, "host", "left").select("page_id", "url", "html", "low").mapInArrow(read, "page_id long, url string, text string")


def report(pages: DataFrame) -> DataFrame:
    return main_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
