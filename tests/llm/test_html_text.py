"""Main text: single pages, templates of hosts, and the usual odd tables."""

import random

import pytest

from chunkloom.llm import html_text
from chunkloom.llm.html_text import events, extract_text, main_text, templates, valid_tokens

PAGES = {
    "": "",
    "plain text only": "plain text only",
    "<p": "",
    "a < b and <3": "a < b and <3",
    "<article>one <b>two</b>three<br>four<p>five</article>": "one twothree four\nfive",
    "<article><p>&lt;b&gt; &amp;amp; &eacute;&#233; &nosuch; x&nbsp;y</p></article>": "<b> &amp; éé &nosuch; x\xa0y",
    "<head><title>t<p>x</title><style>p{}</style><p>free": "free",
    "<nav>menu<article>text<aside>side<article>no</article></aside>tail</article><footer>foot": "text\ntail",
    "<article>a<div class='comments'><article>c</article></div>b<section id=comments>d</section></article>": "a\nb",
    "<article><header><h1>Title</h1></header><form>f<input></form>x</article>": "Title\nx",
    "<header>top</header><main><h1>H</h1><div class='cookie-notice'>c</div><div class='ad'>a</div><p>p</main>": "H\np",
    "<div id=menu><a href=x>m</a></div><div>text <a>l</a> more</div><ul><li><a>only a link</a></ul>": "text l more",
    "<body class='has-sidebar no-header'><div role=main>a</div><div role='contentinfo'>b</div>": "a",
    "<article><p>a <span class=ad>x</span> b<script>var t='</p>'</script>c</article>": "a bc",
    "<article><table><tr><td>1<td>2<tr><td>3</table><ul><li>x<li>y</ul><dl><dt>t<dd>d</dl></article>": "1\n2\n3\nx\ny\nt\nd",
    "<article>a<!-- <p>b</p> -->c<!doctype x>d<p title='a>b'>e</article>after": "acd\ne",
    "<article>a</article><p>between</p><article>b</article>": "a\nb",
    "<article> \n\t </article><p>other": "",
    "<ARTICLE><P>A</P\n><P>B</ARTICLE>": "A\nB",
}


@pytest.mark.parametrize("page", PAGES)
def test_single_pages(page):
    text, slots = main_text(page, {})
    assert text == PAGES[page]
    assert slots >= bool(text)


def site(n, container, rng):
    """Pages of a host with a menu, a constant notice in a plain division, and texts of their own."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    out = []
    for i in range(n):
        own = [" ".join(word() for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(1, 5))]
        body = "".join(f"<p>{x}</p>" for x in own)
        body = f"<{container}>{body}</{container}>"
        page = f"<html><head><title>{word()}</title></head><body><div class=top>Our site, since 1990</div>{body}<div class=end>All rights, no duties</div></body></html>"
        out.append((i, f"http://{container}.example.org/{i}", page, "\n".join(own)))
    return out


def test_constant_texts_are_template(spark):
    rng = random.Random(4)
    rows = site(40, "div", rng) + site(30, "article", rng)
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, html string").repartition(5)
    got = {(r["url"], r["text"], r["n_chars"]) for r in extract_text(pages).collect()}
    assert got == {(r[1], r[3], len(r[3])) for r in rows}
    found = {r["host"]: r["tokens"] for r in templates(pages).collect()}
    assert set(found) == {"div.example.org", "article.example.org"}
    # html, head, title, body, two constant divisions with their texts, one division of the text: one class
    sizes = {h: max(sum(t["class"] == c for t in ts) for c in {t["class"] for t in ts}) for h, ts in found.items()}
    assert sizes["div.example.org"] == 16


def test_vectors_agree_with_counting(spark):
    """Classes are the sets of tokens with one count on every page, by brute force."""
    rng = random.Random(5)
    rows = site(12, "div", rng) + site(9, "section", rng)
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, html string").repartition(4)
    found = {r["host"]: r["tokens"] for r in templates(pages).collect()}
    for container in ("div", "section"):
        mine = [r[2] for r in rows if f"//{container}." in r[1]]
        counts = [html_text.vector_rows(p) for p in mine]
        vectors = {}
        for t in set().union(*counts):
            v = tuple(c.get(t, (0, 0))[0] for c in counts)
            if 2 * sum(x > 0 for x in v) >= len(mine):
                vectors.setdefault(v, set()).add(t)
        want = {frozenset(ts) for ts in vectors.values() if len(ts) > 1}
        got = {}
        for t in found[f"{container}.example.org"]:
            got.setdefault(t["class"], set()).add(t["token"])
        assert {frozenset(ts) for ts in got.values()} == want


def test_copies_and_small_hosts_keep_their_text(spark):
    same = [(i, "http://copies.example.com/", "<div>all of it</div><div>again</div>") for i in range(50)]
    few = [(100 + i, f"http://h{i}.example.com/", f"<body><p>text of {i}</p></body>") for i in range(20)]
    rows = same + few
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted((r["page_id"], r["text"]) for r in extract_text(pages).collect())
    assert got == [(i, "all of it\nagain") for i in range(50)] + [(100 + i, f"text of {i}") for i in range(20)]


def test_valid_classes():
    order = [1, 2, 5, 6, 5, 6, 3, 7, 4]
    classes = {1: (10, 0), 2: (10, 1), 3: (10, 2), 4: (10, 3), 5: (20, 0), 6: (20, 1)}
    assert valid_tokens(order, classes) == {1, 2, 3, 4, 5, 6}
    assert valid_tokens([1, 3, 2, 4], classes) == set()  # out of order
    assert valid_tokens([1, 2, 5, 3, 6, 4], classes) == {1, 2, 3, 4}  # the class of 5 and 6 is cut


def test_events_keep_every_visible_run():
    page = "<body>a<p>b<i>c</i></p>d<nav>e</nav></body>"
    assert [e[1] for e in events(page) if e[1]] == ["a", "b", "c", "d"]


def test_odd_tables(spark):
    schema = "page_id bigint, url string, html string, host string, tokens string, text int"
    rows = [(1, None, "<article>x</article>", "h", "t", 1), (1, None, "<article>x</article>", "h", "t", 1), (None, "no scheme", None, None, None, None),
            (2, "http://a.b/", "", None, None, 5), (3, "http://a.b/", "<p>" + "long " * 200_000, None, None, None), (4, "x://", "<b>" * 5000 + "deep", None, None, 0)]
    got = [(r["page_id"], r["url"], r["n_chars"]) for r in extract_text(spark.createDataFrame(rows, schema)).collect()]
    want = [(1, None, 1), (1, None, 1), (None, "no scheme", 0), (2, "http://a.b/", 0), (3, "http://a.b/", 999_999), (4, "x://", 4)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert extract_text(spark.createDataFrame([], schema)).collect() == []
