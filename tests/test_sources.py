import random

import pytest

from pyspark.sql import functions as F

import json
import unicodedata

from chunkloom.operators.chunking import chunk_blocks
from chunkloom.sources.artifacts import best_match, describe_artifacts, latest_artifacts, list_artifacts, nfc, read_artifacts
from chunkloom.operators.chunking import chunk_blocks
from chunkloom.sources.artifacts import best_match
from chunkloom.sources.blocks import blocks_from_json, broken_results, parse_errors
from pyspark.sql import functions as F


def blocks(spark, data, strategy="general"):
    raw = spark.createDataFrame([("d", "T", strategy, json.dumps(data, ensure_ascii=False))], "doc_id string, doc_title string, strategy string, json string")
    return blocks_from_json(raw)


NESTED = [
    [
        {"type": "title", "content": {"title_content": [{"type": "text", "content": "Head"}], "level": 1}, "bbox": [0, 0, 1, 1]},
        {"type": "paragraph", "content": {"paragraph_content": [{"type": "text", "content": "a"}, "b", {"type": "x", "content": ""}]}},
    ],
    [
        {"type": "list", "content": {"list_type": "t", "list_items": [{"item_type": "text", "item_content": [{"type": "text", "content": "first item"}]}, " second "]}},
        {"type": "index", "content": {"list_items": [], "text": "index text"}},
        {"type": "equation", "content": {"math_content": "", "text": "e=mc"}},
        {"type": "table", "content": {"html": "<table></table>", "table_caption": [{"type": "text", "content": "cap"}], "table_footnote": ["note"], "image_source": {"path": "p.png"}}},
        {"type": "paragraph", "content": "bare string"},
    ],
]


def test_nested_blocks(spark):
    got = [(r.page_number, r.block_type, r.text, r.caption, r.footnote) for r in blocks(spark, NESTED).orderBy("block_no").collect()]
    assert got == [
        (1, "title", "Head", "", ""),
        (1, "paragraph", "a b", "", ""),
        (2, "list", "first item\nsecond", "", ""),
        (2, "index", "index text", "", ""),
        (2, "equation", "e=mc", "", ""),
        (2, "table", None, "cap", "note"),
        (2, "paragraph", "bare string", "", ""),
    ]


def test_flat_blocks(spark):
    flat = [
        {"type": "text", "text": "later", "page_idx": 1},
        {"type": "text", "text": "Title", "text_level": 2, "page_idx": 0},
        {"type": "table", "table_body": "", "html": "<table>1</table>", "table_caption": ["c1", "c2"], "table_footnote": "f", "page_idx": 0},
        {"type": "list", "list_items": ["x", "y"], "page_idx": 0},
        {"type": "text", "content": {"paragraph_content": [{"type": "text", "content": "kept"}]}, "page_idx": 2},
    ]
    got = [(r.page_number, r.block_type, r.level, r.text, r.html, r.caption, r.footnote) for r in blocks(spark, flat).orderBy("block_no").collect()]
    assert got == [
        (1, "title", 2, "Title", None, "", ""),
        (1, "table", None, None, "<table>1</table>", "c1 c2", "f"),
        (1, "list", None, "x\ny", None, "", ""),
        (2, "text", None, "later", None, "", ""),
        (3, "text", 1, "kept", None, "", ""),
    ]


def test_list_items_reach_children(spark):
    for strategy in ("general", "legal", "report"):
        text = " ".join(r.text for r in chunk_blocks(blocks(spark, NESTED, strategy), long_docs=False).children.collect())
        assert "first item second" in text and "index text" in text


def test_artifacts(spark, tmp_path):
    for path, body in {
        "mineru_pipeline_ocr_korean/report/auto/report_content_list.json": [{"type": "text", "text": "flat", "page_idx": 0}],
        "mineru_pipeline_ocr_korean/report/auto/report_content_list_v2.json": [[{"type": "paragraph", "content": {"paragraph_content": ["nested"]}}]],
        "other/txt/a_very_long_document_name_cut_content_list.json": [{"type": "text", "text": "cut", "page_idx": 0}],
    }.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(json.dumps(body))
    found = list_artifacts(spark, str(tmp_path))
    meta = {r.stem + str(r.version): (r.backend, r.method) for r in describe_artifacts(found).collect()}
    assert meta == {
        "report1": ("pipeline", "ocr"),
        "report2": ("pipeline", "ocr"),
        "a_very_long_document_name_cut1": (None, "txt"),
    }
    docs = spark.createDataFrame([("report",), ("a_very_long_document_name_cut_off",), ("missing",)], "name string")
    latest = latest_artifacts(docs, found)
    assert {r.name: r.version for r in latest.collect()} == {"report": 2, "a_very_long_document_name_cut_off": 1, "missing": None}
    texts = {r.doc_id: r.text for r in blocks_from_json(read_artifacts(spark, latest.where("path IS NOT NULL"), str(tmp_path))).collect()}
    assert texts == {"report": "nested", "a_very_long_document_name_cut_off": "cut"}


def test_prefix_match_needs_ten_characters(spark):
    names = spark.createDataFrame([("abc",), ("abcdefghijkl",), ("zzz",)], "name string")
    targets = spark.createDataFrame([("abcdefghij", 1), ("abcd", 5), ("zzz", 2)], "key string, v int")
    got = {r.name: r.best for r in best_match(names, targets, F.col("v")).collect()}
    assert got == {"abc": 1, "abcdefghijkl": 1, "zzz": 2}


def test_nfc(spark):
    df = spark.createDataFrame([("한",), (None,)], "n string")
    assert [r.x for r in df.select(nfc("n").alias("x")).collect()] == ["한", None]


def test_artifacts_with_spaces_and_hangul(spark, tmp_path):
    names = ["문서 하나+둘", "100% plain", "a b"]
    for n in names:
        (tmp_path / f"{n}_content_list.json").write_text(json.dumps([{"type": "text", "text": n, "page_idx": 0}]))
    docs = spark.createDataFrame([(unicodedata.normalize("NFD", n),) for n in names], "name string")
    latest = latest_artifacts(docs, list_artifacts(spark, str(tmp_path)))
    got = {r.doc_id: r.text for r in blocks_from_json(read_artifacts(spark, latest, str(tmp_path))).collect()}
    assert got == {unicodedata.normalize("NFD", n): n for n in names}


def test_broken_results_are_told(spark):
    rows = [("ok", "[]"), ("flat", '[{"type": "text", "text": "x", "page_idx": 0}]'), ("cut", '[{"type": "text", "te'), ("none", None), ("blank", " "), ("object", '{"a": 1}')]
    raw = spark.createDataFrame([(d, d, "general", j) for d, j in rows], "doc_id string, doc_title string, strategy string, json string")
    assert {r.doc_id: r.error for r in broken_results(raw).collect()} == {"cut": "not a list of blocks", "none": "empty", "blank": "empty", "object": "not a list of blocks"}


def test_unreadable_results_keep_their_documents(spark):
    good = '[{"type":"text","text":"fine","page_idx":0}]'
    cases = {"good": good, "cut": good[:-8], "none": None, "blank": " \n", "object": '{"a": 1}', "list": "[]", "pages": "[[]]", "words": "not json"}
    raw = spark.createDataFrame([(k, k.upper(), "general", v) for k, v in cases.items()], "doc_id string, doc_title string, strategy string, json string")
    found = blocks_from_json(raw)
    errors = {r.doc_id: (r.doc_title, r.error) for r in parse_errors(found).collect()}
    unread = "not a list of blocks"
    reasons = {"cut": unread, "none": "empty", "blank": "empty", "object": unread, "list": "no blocks", "pages": "no blocks", "words": unread}
    assert errors == {k: (k.upper(), v) for k, v in reasons.items()}
    chunked = chunk_blocks(found)
    assert {r.doc_id for r in chunked.sections.collect()} == set(cases)
    assert [(r.doc_id, r.text) for r in chunked.children.collect()] == [("good", "fine")]


def test_prefix_sweep_agrees_with_trying_all(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(0, 16)))
    names = [(word(),) for _ in range(300)] + [(None,), ("",), ("é" * 12,), ("é" * 11 + "x",)]
    targets = [(word(), rng.randrange(1000)) for _ in range(200)] + [("é" * 11, 5), ("a" * 30, None), (None, 3)]
    n = spark.createDataFrame(names, "name string").repartition(3)
    t = spark.createDataFrame(targets, "key string, r int").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = {r.name: r.best and (r.best.r, r.best.key) for r in best_match(n, t, F.struct("r", "key")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    want = {}
    for (name,) in names:
        fit = [(-1 if r is None else r, k, r) for k, r in targets if name is not None and k is not None and (name == k or len(k) >= 10 and name and (k.startswith(name) or name.startswith(k)))]
        if fit:
            best = max(fit)
            want[name] = (best[2], best[1])
    assert got == want and len(want) > 50


def test_pages_without_end_tags_keep_their_text():
    from chunkloom.functions.tables import _page_blocks

    def found(page):
        return [(b["block_type"], b["text"] or b["html"]) for b in _page_blocks(page)]

    cell = "<table><tr><td>a</td></tr>"
    assert found(f"<p>one{cell}<p>two<h2>three</h2>four") == [("paragraph", "one"), ("table", cell + "</table>"), ("paragraph", "two"), ("title", "three"), ("paragraph", "four")]
    assert found("<table><tr><td>a<p>b") == [("table", "<table><tr><td>a<p>b</table>")]
    assert found(f"{cell}</table>after") == [("table", cell + "</table>"), ("paragraph", "after")]
    assert found("<html><head><title>t</title><style>p{}</style><body><p>kept") == [("paragraph", "kept")]
    assert found("<head><title>t</title><p>kept</p><h1>x</h1>") == [("paragraph", "kept"), ("title", "x")]
    assert found("<table><tr><td><table><tr><td>in</td></tr></table></td></tr></table>")[0][0] == "table"


def test_malformed_pages_keep_their_text(monkeypatch):
    from chunkloom.functions import tables

    def found(page):
        return [b["text"] for b in tables._page_blocks(page)]

    for mark in ("<![unknown[x]>", "<![ [x]>", "<![CDATA[ open>", "<!x>", "<![if IE]>"):
        assert found(f"<h1>one</h1>{mark}<p>two</p>") == ["one", "two"], mark
    assert found("<p>one</p>two & three AT&T") == ["one", "two & three AT&T"]
    assert found("<p>one</p>2 &lt") == ["one", "2 <"]
    assert found("<p>one</p>1 <") == ["one", "1 <"]
    assert found("<p>one</p><!-- open > comment") == ["one"]
    zeros, nines = "0" * 5000, "9" * 5000
    assert found(f"<p>one &#{zeros}65; &#{nines}; &#{zeros};</p><p>two</p>") == ["one A \ufffd \ufffd", "two"]
    assert tables._cells("<table><![x y]><tr><td>&amp;</td></tr></table>") == [["&"]]

    def fails(self, data):
        raise ValueError("not read")

    monkeypatch.setattr(tables._Events, "feed", fails)
    with pytest.raises(ValueError):  # a failure is no empty page
        found("<p>one</p>")


def test_heading_tags_declare_levels(spark):
    from chunkloom.sources.blocks import blocks_from_html

    page = "<h1>20.118.157.107 Betz</h1><p>x</p><h2>1. Part</h2><p>y</p><h3>I. Mark</h3><p>z</p>"
    pages = spark.createDataFrame([("d", page)], "doc_id string, html string")
    found = chunk_blocks(blocks_from_html(pages, "doc_id", "html")).sections.orderBy("section_pos").collect()
    assert [(s.title, s.level) for s in found] == [("d", 0), ("20.118.157.107 Betz", 1), ("1. Part", 2)]


def test_only_references(spark):
    from chunkloom.functions.tables import only_references
    from chunkloom.sources.blocks import blocks_from_html

    pages = spark.createDataFrame([("d", "<h1>a &amp; &quot;b&quot; &amp;lt; c&amp</h1>")], "doc_id string, html string")
    text = lambda html: blocks_from_html(pages, "doc_id", html).first().text
    assert text(only_references("html", "amp")) == "a & &quot;b&quot; &lt; c&amp"
    assert text("html") == 'a & "b" &lt; c&'


def test_pages_are_parsed_once(spark):
    from chunkloom.operators.chunking import chunk_blocks
    from chunkloom.sources.blocks import blocks_from_html

    pages = spark.createDataFrame([("p", "<h1>A</h1><p>text</p><table><tr><td>x</td></tr></table>")], "doc_id string, html string")
    c = chunk_blocks(blocks_from_html(pages, "doc_id", "html"))
    for t in (c.sections, c.parents, c.children):
        assert "page_blocks" not in t._jdf.queryExecution().toString()
    assert c.children.count() == 2
