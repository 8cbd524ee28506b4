"""Style trees against a plain merge of the pages, and their effect inside declared main content."""

import re
from collections import Counter, defaultdict
from math import log

import pytest

from caselane.llm import styletree
from tests.llm.cases import pages

BOX = "<div class=box>Read more of our stories here</div>"


def plain_host(url):
    return re.match(r"(?:[a-z]+://(?:[^/?#@]*@)?([^/?#:]*))?", (url or "").lower())[1] or ""


def plain_tree(rows):
    """(host, node) -> importance, by merging page after page."""
    once = {}
    for _, url, html in rows:
        branches, bulk, mark = styletree.page_nodes(html or "")
        once[plain_host(url), mark or html] = branches, bulk
    contents, shapes, held, bulks, kinds = defaultdict(Counter), defaultdict(Counter), Counter(), Counter(), {}
    for (host, _), (branches, bulk) in once.items():
        for node, kind, content, children in branches:
            contents[host, node][content] += 1
            shapes[host, node][children] += 1
            kinds[host, node] = max(kind, kinds.get((host, node), 0))
        for node in {b[0] for b in branches}:
            held[host, node] += 1
            bulks[host, node] += node in bulk

    def entropy(counts):
        n = sum(counts.values())
        return -sum(c / n * log(c / n) for c in counts.values()) / log(n)

    out = {}
    for at, kind in kinds.items():
        if kind == styletree.MAIN or kind != styletree.NOISE and bulks[at] >= styletree.BULK * held[at]:
            out[at] = 1.0
        elif kind == styletree.NOISE:
            out[at] = 0.0
        elif held[at] < styletree.FEW:
            out[at] = 1.0
        else:
            out[at] = styletree.CONTENT * entropy(contents[at]) + (1 - styletree.CONTENT) * entropy(shapes[at])
    return out


@pytest.mark.parametrize("injected", [False, True])
def test_tree_equals_plain_merge(spark, injected):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    if injected:
        rows = [(k, u, h.replace("</h1>", "</h1>" + BOX)) for k, u, h in rows]
    got = {(r.host, r.node): r.importance for r in styletree.style_tree(pages(spark, rows)).collect()}
    want = plain_tree(rows)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_boilerplate_in_articles_goes(spark, folder):
    """Boxes put into the articles of every large host go and nothing else does; where few pages prove nothing they stay."""
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in table.collect()]
    plain = {r.page_id: r.text for r in styletree.report(table).collect()}
    boxed = [(k, u, h.replace("</article>", BOX + "</article>")) for k, u, h in rows]
    got = {r.page_id: r.text for r in styletree.report(pages(spark, boxed)).collect()}
    hosts = Counter(plain_host(u) for _, u, _ in rows)
    bare = {k: styletree.page_text(h, frozenset()) for k, _, h in boxed}
    large = {k for k, u, _ in rows if hosts[plain_host(u)] >= styletree.FEW}
    assert len(large) > 50 and all(got[k] == plain[k] != bare[k] for k in large)
    assert all(got[k] == bare[k] for k in plain.keys() - large)


def test_near_copies_keep_their_text(spark):
    """Pages that differ in one of ten paragraphs: the shared ones are the bulk of the article and stay; the byline goes."""
    body = "".join(f"<p>Paragraph {i} of the story that all of them tell.</p>" for i in range(9))
    rows = [(k, f"http://n.example/{k}", f"<body><article><h1>One title</h1><div class=byline>By us</div>{body}<p>Edition {k}</p></article></body>") for k in range(40)]
    got = {r.page_id: r.text.split("\n") for r in styletree.report(pages(spark, rows)).collect()}
    assert all(len(v) == 11 and v[0] == "One title" and v[-1] == f"Edition {k}" for k, v in got.items())


def test_copies_with_other_menus_count_once(spark):
    page = "<body><div class=top>Menu {0}</div><article><h1>Same</h1><div class=lead>A lead</div><p>The same words in all copies</p></article></body>"
    rows = [(k, "http://h.example/", page.format(k)) for k in range(40)]
    assert {r.text for r in styletree.report(pages(spark, rows)).collect()} == {"Same\nA lead\nThe same words in all copies"}
