"""Main text: what is in an article, what is not, templates of sites, broken markup."""

import random
from collections import defaultdict

import pytest

from millrace.llm.html_main import main_text, parse


def article(page):
    return "\n".join(t for t, inside, _ in parse(page)[0] if inside)


@pytest.mark.parametrize(("page", "want"), [
    ("<article><h1>A  b</h1><p>c&amp;d\n e<p><b>f<br>g</article><footer>no</footer>", "A b\nc&d e\nf\ng"),
    ("<article><p>x<script>var t='</p>';</script>y</p><style>p{}</style><!-- <p>no</p> --></article>", "xy"),
    ("<main><div class='sidebar'>no</div><p>yes</p><form>no<input></form><section id=comments><p>no</p></section></main>", "yes"),
    ("<article><p>cut off &am", "cut off &am"),
    ("<article><p>a &lt;b&gt; &#233; &nbsp; c</p><p hidden>no</p><div class=\"ad\">no</div></article>", "a <b> é c"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>1<td>2</table></article>", "one\ntwo\n1\n2"),
    ("<article><header><h1>t</h1></header><p title=\"a > b\">x</p></article>", "t\nx"),
    ("<div class='site-header'>no</div><article><div class='post-header'><h1>t</h1></div><p class='cookie-notice'>no</p>x</article>", "t\nx"),
    ("<article><p>1 < 2 and 3</p></article>", "1 < 2 and 3"),
    ("<header>no</header><nav><ul><li>no</ul></nav><article>yes</article><aside>no</aside>", "yes"),
    ("<article><section id='login-systems'>a</section><section id='consent-in-medicine'>b</section><section id='ads-and-society'>c</section><div class='newsletter-history'>d</div><div class='comments-on-plato'>e</div></article>", "a\nb\nc\nd\ne"),
    ("<article><p data-role='navigation'>a</p><p data-hidden='x'>b</p><p data-class='ad'>c</p><p title='role=navigation hidden'>d</p></article>", "a\nb\nc\nd"),
    ("<article>x<div class='comment'>no</div><section class='user-comment'>no</section><ol class='commentlist'><li>no</ol><article class='comment'>no</article><article>no</article></article><article class='comment'>no</article>", "x"),
    ("<article>x<div itemprop='comment'>no</div><div itemscope itemtype='https://schema.org/Comment'>no</div><div id=disqus_thread>no</div></article>", "x"),
    ("<main><article>a</article><article>b</article></main>", "a\nb"),
    ("", ""),
])
def test_articles(page, want):
    assert article(page) == want


def test_templates_and_odd_rows(spark):
    bar = "<div><p>About us</p><p>All rights reserved</p></div>"
    rows = [(k, f"https://a.example/{k}", f"<body>{bar}<div><p>Story {k}</p></div></body>") for k in range(30)]
    rows += [(100 + k, f"https://b.example/{k}", f"<body>{bar}<div><p>Tale {k}</p></div></body>") for k in range(3)]
    rows += [(200 + k, "https://c.example/x", "<article><p>Copied everywhere</p></article>") for k in range(40)]
    rows += [(300, None, None), (301, "", ""), (302, "odd", "plain text"), (302, "odd", "plain text"), (303, "https://a.example/l", "<p>" + "long " * 50000), (None, None, "<article>x</article>")]
    df = spark.createDataFrame([(i, u, h, "z") for i, u, h in rows], "page_id long, url string, html string, text string")
    got = main_text(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    assert all(text[k] == f"Story {k}" for k in range(30))
    assert all(text[100 + k] == f"About us\nAll rights reserved\nTale {k}" for k in range(3))
    assert all(text[200 + k] == "Copied everywhere" for k in range(40))
    assert (text[300], text[301], text[302], text[None]) == ("", "", "plain text", "x")
    assert text[303] == ("long " * 50000).strip()


def test_templates_inside_articles(spark):
    hint = "<div><p>Get our app</p><p>Rate this page</p></div>"
    rows = [(k, f"https://a.example/{k}", f"<article><p>Story {k}</p>{hint}</article>") for k in range(30)]
    rows += [(100 + k, f"https://b.example/{k}", f"<div>Seen {k}</div><main><p>Mirrored</p>{hint}</main>") for k in range(30)]
    rows += [(200, "https://c.example/", "<article><div class='discussion'>Results hold</div></article>")]
    rows += [(300 + k, f"https://d.example/{k}", f"<main><p>Skip to content</p></main><div><p>Tale {k}</p></div>") for k in range(30)]
    rows += [(400 + k, f"https://d.example/x{k}", f"<main><p>Skip to content</p><p>Note {k}</p></main>") for k in range(30)]
    text = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(text[k] == f"Story {k}" for k in range(30))
    assert all(text[100 + k] == "Mirrored\nGet our app\nRate this page" for k in range(30))
    assert text[200] == "Results hold"
    assert all(text[300 + k] == f"Tale {k}" and text[400 + k] == f"Note {k}" for k in range(30))


def written(node):
    tag, inside = node
    return f"<{tag}>{inside if isinstance(inside, str) else ''.join(map(written, inside))}</{tag}>"


def subtrees(node, above=()):
    """(written subtree, ...) from the root down to each paragraph, with its text."""
    tag, inside = node
    path = (*above, written(node))
    if isinstance(inside, str):
        yield path, inside
    else:
        for child in inside:
            yield from subtrees(child, path)


def test_templates_against_brute_force(spark):
    unit = random.Random(8)
    shared = [("div", [("p", f"Note {k}"), ("div", [("p", f"Deep {k % 3}"), ("p", "Same everywhere")])]) for k in range(8)]
    rows, trees = [], {}
    for k in range(150):
        host = f"{unit.choice('aaaabbc')}.example"
        own = [("p", f"Story {unit.randrange(60)} of {host}")] + [s for j, s in enumerate(shared) if unit.random() < j / 12]
        unit.shuffle(own)
        trees[k] = (host, ("article", own))
        rows.append((k, f"https://{host}/{k}", f"<html><body>{written(trees[k][1])}</body></html>"))
    texts, holders = defaultdict(set), defaultdict(set)
    for host, tree in trees.values():
        text = "\n".join(t for _, t in subtrees(tree))
        texts[host].add(text)
        for path, _ in subtrees(tree):
            for sub in path:
                holders[host, sub].add(text)
    gone = {(host, sub) for (host, sub), of in holders.items() if len(of) >= 10 and (not sub.startswith("<p>") or 100 * len(of) >= 20 * len(texts[host]))}
    want = {k: "\n".join(t for path, t in subtrees(tree) if not any((host, sub) in gone for sub in path)) for k, (host, tree) in trees.items()}
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    assert {host for host, _ in gone} >= {"a.example", "b.example"} and any("Note" in t for t in want.values())


def test_boxes_go_on_hosts_of_every_size(spark):
    """A box in 12 of 400 pages goes as it does in 12 of 30; a paragraph that 12 of 400 articles quote stays."""
    box, quote = "<div class='x'><p>Get our app</p></div>", "<p>As the saying goes</p>"
    rows = [(k, f"https://{h}/{k}", f"<article><p>Story {k}</p>{box if k % 100 < 12 and k % 1000 < 400 else ''}{quote if 50 <= k % 100 < 53 else ''}</article>") for h, n, b in (("large", 400, 0), ("small", 30, 1000)) for k in range(b, b + n)]
    text = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(text[k] == f"Story {k}" + ("\nAs the saying goes" if 50 <= k % 100 < 53 else "") for k, _, _ in rows)


def test_deep_and_long_pages_are_read_in_linear_time():
    deep = "<article>" + "<div>" * 20_000 + "x" + "</div>" * 20_000 + "</article>"
    blocks, hashes = parse(deep)
    assert [b[0] for b in blocks] == ["x"] and len(hashes) == 20_001


def test_empty_table(spark):
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
