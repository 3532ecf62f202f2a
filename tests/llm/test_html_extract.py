"""Extraction against known articles, tree matching against exhaustive matching, damage and empty input."""

import html as htmllib
import itertools
import random
import re

from pyspark.sql import functions as F

from gaugeline.llm import html_extract as hx

SHELL = """<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script><style>p{{}}</style></head><body>
<header><h2>Site name</h2></header><nav><ul><li><a href="/a">{nav}</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
{main}<aside class="sidebar">Other stories {nav}</aside><div class="ad">{ad}</div><section id="comments"><p>Nice one {ad}</p></section>
<form><label>Mail</label><input name=q></form><footer>&copy; site {nav}</footer></body></html>"""


def test_article_pages(spark):
    rnd = random.Random(1)
    word = lambda: rnd.choice(["alpha", "be<ta", "gam&ma", "delta", "é", "x > y", '"q"'])
    rows, want = [], {}
    for i in range(60):
        paragraphs = [" ".join(word() for _ in range(rnd.randint(3, 30))) for _ in range(rnd.randint(1, 8))]
        body = "".join(f"<p>{htmllib.escape(p)}</p>" if rnd.random() < 0.7 else f"<p><b>{htmllib.escape(p)}<br>" for p in paragraphs)
        explicit = i % 2 == 0
        main = f"<article><h1>Title {i}</h1>{body}</article>" if explicit else f"<div class=wrap><div class=x1><h1>Title {i}</h1>{body}</div><div class=x2><p>Always the same line</p></div></div>"
        rows.append((i, f"https://{'a' if explicit else 'b'}.example.com/{i}", SHELL.format(nav=word().replace("<", ""), ad=word().replace("<", ""), main=main)))
        want[i] = "\n".join([f"Title {i}", *(re.sub(r"\s+", " ", p).strip() for p in paragraphs)])
    rows += [(100, "https://a.example.com/z", None), (101, None, ""), (102, "nourl", "<p>just <i>one</i> line"), (103, "http://c.example.com", "no markup & <b>bold</b>text")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in hx.extract_pages(df).collect()}
    assert len(got) == len(rows)
    for i, t in want.items():
        assert got[i]["text"] == t, i
        assert got[i]["n_chars"] == len(t)
    assert (got[100]["text"], got[101]["text"], got[102]["text"], got[103]["text"]) == ("", "", "just one line", "no markup & boldtext")
    assert hx.extract_pages(df.limit(0)).count() == 0


def test_template_counts(spark):
    rows = [(i, "http://h.example.com/x", f"<div class=top>Fixed</div><div class=main><p>{'text ' * (i + 3)}{i}</p></div>") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", hx.host_of(F.col("url")))
    (r,) = hx.induce(df).collect()
    import json

    t = hx.Template(r["tree"], [tuple(x) for x in json.loads(r["counts"])])
    assert t.root.nodes[0].id in t.constant and t.root.nodes[1].nodes[0].id not in t.constant
    assert t.region == t.root.nodes[1].id


def test_copies_are_not_template(spark):
    body = lambda i: f"<h1>Title {i}</h1><p>{f'word{i} ' * 30}end</p>"
    page = lambda i: f"<div class=wrap><div class=x1>{body(i)}</div><div class=x2><p>Always the same line</p></div></div>"
    text = lambda i: f"Title {i}\n{f'word{i} ' * 30}end"
    mixed = [0] * 12 + [1, 2]
    rows = [(k, "http://mixed.example.com/", page(i)) for k, i in enumerate(mixed)]
    rows += [(100 + k, "http://copies.example.com/", f"<div class=wrap>{body(9)}</div>") for k in range(3)]
    rows += [(200 + k, "http://named.example.com/", f"<div class=post>{body(7)}</div><div class=x2><p>Line {k}</p></div>") for k in range(4)]
    got = {r["page_id"]: r["text"] for r in hx.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == {k: text(i) for k, i in enumerate(mixed)} | {100 + k: text(9) for k in range(3)} | {200 + k: text(7) for k in range(4)}


def test_what_belongs_to_an_article():
    for page, text in (
        ("<article><p>main</p></article><article class='comment'><p>reader</p></article>", "main"),
        ("<article><p>main</p><article class='comment-body'><p>reader</p></article><div id=comments><p>r</p></div></article>", "main"),
        ("<article><p>main text of some length</p></article><article itemprop='comment'><p>a reader's text of some length and more</p></article>", "main text of some length"),
        ("<article><p>main text</p><section><h3>3 Comments</h3><p>reader one</p><p>reader two</p></section></article>", "main text"),
        ("<article class='post has-comments'><p>main</p></article>", "main"),
        ("<article><p class='legal'>a</p><p class='search-results'>b</p><p class='cookie-recipe'>c</p><div class='cookie-recipe'>d</div></article>", "a\nb\nc\nd"),
        ("<article><p class=ad>x</p><div class='ad-slot'>x</div><p>E=<math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math></p></article>", "E=mc2"),
        ("<article><p>a</p><figure><img src=x><figcaption>The <b>caption</b></figcaption></figure><object>table as text</object></article>", "a\nThe caption\ntable as text"),
        ("<article><h2>Teaser one</h2></article><article><h1>T</h1><p>a whole long article of many words</p></article>", "T\na whole long article of many words"),
    ):
        assert hx.extract(page) == text, page


def test_the_template_decides(spark):
    """Constant blocks go by counts, whatever their names, within article elements too; articles that hold little of the varying
    text aren't the region; near copies don't make a template."""
    rnd = random.Random(3)
    prose = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    rows, want = [], {}
    for i in range(12):
        a, b = prose(30), prose(40)
        rows.append((i, "http://inside.example.com/", f"<article><h1>T{i}</h1><p>{a}</p><p>Buy our paper today</p><p>{b}</p><div class=box>All rights reserved by us</div></article>"))
        want[i] = f"T{i}\n{a}\n{b}"
        rows.append((100 + i, "http://cards.example.com/", f"<div class=a1><article><p>Card {i}</p></article></div><div class=b7><p>{a}</p><p>{b}</p></div>"))
        want[100 + i] = f"{a}\n{b}"
    paragraphs = [prose(20) for _ in range(6)]
    for i in range(10):  # near copies of one article
        mine = [*paragraphs[:5], paragraphs[5] + f" end{i}"]
        rows.append((200 + i, "http://near.example.com/", "<article>" + "".join(f"<p>{p}</p>" for p in mine) + "</article>"))
        want[200 + i] = "\n".join(mine)
    got = {r["page_id"]: r for r in hx.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert {r["region"] for k, r in got.items() if k < 100} == {"article"} and {r["region"] for k, r in got.items() if 100 <= k < 200} == {"template"}
    assert all(r["constant_blocks"] == 2 for k, r in got.items() if k < 100)


def test_pages_of_the_table(spark):
    """The template is counted on the table's hosts, confirms their articles and takes nothing out of them."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in hx.extract_pages(pages).collect()}
    assert len(got) == pages.count() and {r["region"] for r in got.values()} == {"article"}
    assert {k: r["text"] for k, r in got.items()} == {r["page_id"]: hx.extract(r["html"]) for r in pages.collect()}


def test_named_content():
    page = "<div id=wrap><div class=top>Site and a few words more</div><div class='post-content'><h2>T</h2><p>one two three four five six seven</p><div class=share>Share</div></div><p>After</p></div>"
    assert hx.extract(page) == "T\none two three four five six seven"


def exhaustive(a, b):
    if a.label != b.label:
        return 0
    x, y = a.nodes, b.nodes
    best = 0
    for k in range(min(len(x), len(y)) + 1):
        for p in itertools.combinations(range(len(x)), k):
            for q in itertools.combinations(range(len(y)), k):
                if all(x[i].label == y[j].label for i, j in zip(p, q, strict=True)):
                    best = max(best, sum(exhaustive(x[i], y[j]) for i, j in zip(p, q, strict=True)))
    return 1 + best


def test_matching_of_leaves_is_best():
    rnd = random.Random(4)
    for _ in range(200):
        a, b = hx.Node("d"), hx.Node("d")
        for n in (a, b):
            n.children = [hx.Node(rnd.choice("pqr")) for _ in range(rnd.randint(0, 5))]
        pairs = []
        assert hx.match(a, b, pairs) == exhaustive(a, b) == len(pairs)


def test_damaged_markup_ends():
    rnd = random.Random(7)
    bits = ["<p", ">", "<", "'", '"', "</", "div", "<div class=\"", "<!--", "-->", "text", "&amp", "&#x", "<script>", "</script", "<article>", "</p>", "=", " "]
    for _ in range(400):
        hx.extract("".join(rnd.choice(bits) for _ in range(60)))
    assert len(hx.extract("<p>" + "<a href='" * 20000)) < 400_000
    assert hx.extract("<div>" * 30000 + "deep") == "deep"
    assert hx.extract("<article>" + "<div>" * 3000 + "a<p>b" + "</div>" * 3000 + "c</article>") == "a\nb\nc"
    hx.Template(hx.skeleton("<div>" * 3000))
