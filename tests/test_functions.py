import uuid

from pyspark.sql import functions as F

import plain
from chunkloom.functions import ids, meta
from chunkloom.functions import text as tx
from chunkloom.functions.tables import page_blocks, table_rows, table_search_text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", make("v").alias("x")).orderBy("i").collect()]


def test_token_estimate(spark):
    texts = ["", None, "a", "one two three", "한국어 토큰 추정", "x" * 11, " tab\tnbsp\xa0end "]
    assert column(spark, texts, tx.token_estimate) == [plain.tokens(t or "") for t in texts]


def test_embedding_text(spark):
    got = column(spark, ["This is a multi-\nlingual embedding model test.", " a\t\nb\xa0c ", None, "a-\nb-\nc"], tx.embedding_text)
    assert got == ["This is a multilingual embedding model test.", "a b c", "", "ab-\nc".replace("\n", " ")]


def test_context_text(spark):
    text = "[A > B]\n\n첫 줄이\n이어진다.\n① 항\n- 점\n제1조 조문\n\n \n\n다음 문단\nmulti-\nline\n"
    assert column(spark, [text, ""], tx.context_text) == [
        "[A > B]\n\n첫 줄이 이어진다.\n① 항\n- 점\n제1조 조문\n\n다음 문단 multiline",
        "",
    ]


def test_forced_split(spark):
    text = ", ".join(f"clause number {i} here" for i in range(100))
    units = column(spark, [text], lambda c: tx.text_units(c, max_tokens=100))[0]
    assert len(units) > 1 and all(plain.tokens(u) <= 105 for u in units)
    assert " ".join(units) == text


def test_legal_units(spark):
    text = "제1조(목적) 이 규정은 다음과 같다. ① 첫째 비율은 3.14%로 한다. ② 둘째: 1. 하나 2. 둘"
    units = column(spark, [text], lambda c: tx.text_units(c, legal=True))[0]
    assert any("3.14%" in u for u in units)
    assert any(u.startswith("①") for u in units) and any(u.startswith("②") for u in units)


def test_document_ids(spark):
    full = "doc_" + "0af" * 10 + "xy"
    names = ["보고서.pdf", "simple-id_1", full, "d_1a2b3c", "a.PDF", "x" * 41]
    hashed = lambda n: "doc_" + uuid.uuid5(uuid.NAMESPACE_URL, "urn:mineru:doc:" + n).hex
    assert column(spark, names, ids.doc_id) == [hashed(names[0]), names[1], full, hashed(names[3]), hashed(names[4]), hashed(names[5])]
    a, b = column(spark, [None, ""], ids.doc_id)
    assert a != b and len(a) == len(b) == 36


def test_point_ids(spark):
    u = str(uuid.uuid4())
    names = [u, u.upper(), "{" + u + "}", "doc_c0001"]
    assert column(spark, names, ids.point_id) == [u, u, u, str(uuid.uuid5(uuid.NAMESPACE_DNS, "doc_c0001"))]


def test_display_and_backfill(spark):
    assert column(spark, ["d_x_c0001", "d_p0002", "p7", "d_s03", None, "plain"], ids.display_id) == ["c0001", "P0002", "P7", "s03", "", "plain"]
    r = one(
        spark,
        ids.backfilled_doc_id(F.lit(""), F.array(F.lit(" T "), F.lit("S")), F.lit("a_c1")).alias("a"),
        ids.backfilled_doc_id(F.lit(None).cast("string"), F.array().cast("array<string>"), F.lit("a_c_c12")).alias("b"),
    )
    assert (r.a, r.b) == ("T", "a_c")


def test_fence_and_midpoint(spark):
    assert column(spark, ["```markdown\n inner\ntext \n```", "no fence", "```\nx\n```"], tx.strip_fence) == ["inner\ntext", "no fence", "x"]
    halves = column(spark, ["aa\n\nbbbb\n\ncc", "First one. Second one. Third", "left right", "x", ""], tx.split_midpoint)
    assert [tuple(h) for h in halves] == [("aa", "bbbb\n\ncc"), ("First one", "Second one. Third"), ("left", "right"), ("", "x"), ("", "")]


def test_metadata(spark):
    base = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"), F.lit("image_url"), F.lit("u"))
    new = F.create_map(F.lit("b"), F.lit("3"), F.lit("page"), F.lit("9"))
    r = one(spark, meta.merge_metadata(base, new, F.lit(3), F.lit(2)).alias("m"), meta.page_label(F.lit(3), F.lit(5)).alias("l"))
    assert r.m == {"a": "1", "b": "3", "page": "3", "page_start": "3", "page_end": "3", "pages": "[3]"}
    assert r.l == "p.3~p.5"


def test_table_text(spark):
    html = "<table><tr><th>A</th><th> B\n b</th></tr><tr><td>1&amp;2</td><td>x</td></tr><tr></tr><tr><td>3<td>4</td></tr></table>"
    df = spark.createDataFrame([(html, "cap", "note"), ("<p>no rows</p>", "", None), ("", None, "")], "h string, c string, f string")
    df = df.withColumn("r", table_rows("h"))
    got = [x.t for x in df.select(table_search_text("h", "r", "c", "f").alias("t")).collect()]
    assert got[0].split("\n") == ["[표: cap]", "컬럼: A | B b", "주요 데이터:", "- 1&2 | x", "- 4", "(주: note)"]
    assert got[1:] == ["[표]\n내용 요약: no rows", "[표]"]


def test_table_text_budget(spark):
    rows = "".join(f"<tr><td>{'word ' * 90}{i}</td></tr>" for i in range(8))
    df = spark.createDataFrame([(f"<table><tr><th>h</th></tr>{rows}</table>",)], "h string").withColumn("r", table_rows("h"))
    text = df.select(table_search_text("h", "r", F.lit(""), F.lit("n " * 40)).alias("t")).first().t
    assert plain.tokens(text) <= 512 and 1 <= text.count("\n- ") < 6


def test_page_blocks(spark):
    html = "<head><title>t</title></head><body><h2>Head</h2><p>one<br>two<p>three<ul><li>item</ul><table><tr><td>x</td></tr></table>"
    df = spark.createDataFrame([(html,)], "h string")
    got = [(b.block_type, b.level, b.text) for b in df.select(page_blocks("h").alias("b")).first().b]
    assert got == [("title", 2, "Head"), ("paragraph", None, "one\ntwo"), ("paragraph", None, "three"), ("list", None, "item"), ("table", None, None)]


def test_plain_tables_are_read_alike(spark):
    from chunkloom.functions.tables import PLAIN_TABLE, _cells, _read_cells

    plain = ["<table></table>", "<table><tr></tr><tr><th> a\n b</th><td></td></tr></table>", "<table><tr><td>1 > 0</td></tr></table>"]
    other = ["<table><tr><td>a &amp; b</td></tr></table>", "<table><tr><td>a<br>b</td></tr></table>", "<table><tr><td>open</tr></table>", "<table><tr><td>x</td></tr>", ""]
    assert [bool(PLAIN_TABLE.fullmatch(h)) for h in plain + other] == [True] * 3 + [False] * 5
    assert [_cells(h) for h in plain + other] == [_read_cells(h) for h in plain + other]


def test_worker_output_comes_in_slices(spark):
    import pandas as pd

    from chunkloom.functions.tables import SLICE_ROWS, in_slices

    held = [len(s) for s in in_slices(iter([pd.Series(range(1000)), pd.Series(dtype=object)]), str)]
    assert sum(held) == 1000 and max(held) == SLICE_ROWS
    pages = spark.range(1000).select(F.concat(F.lit("<h1>"), "id", F.lit("</h1>")).alias("h"), "id").coalesce(1)
    assert pages.where(page_blocks("h")[0]["text"] != F.col("id").cast("string")).count() == 0


def test_summaries_at_the_budget(spark):
    rows = [("<table><tr><th>h</th></tr>" + "".join(f"<tr><td>{'x y ' * n}{i}</td></tr>" for i in range(6)) + "</table>",) for n in (1, 5, 12, 13, 14, 30, 60)]
    df = spark.createDataFrame(rows, "html string").withColumn("cells", table_rows("html"))
    got = [r.s for r in df.select(table_search_text("html", "cells", F.lit("c"), F.lit("f"), 200).alias("s")).collect()]

    def plain(html):
        from chunkloom.functions.tables import _read_cells
        from tests.plain import tokens

        head, *data = [" | ".join(r) for r in _read_cells(html)]
        lines, tail = ["[표: c]", "컬럼: " + head, "주요 데이터:"], ["(주: f)"]
        for row in data:
            if tokens("\n".join([*lines, "- " + row, *tail])) > 200:
                break
            lines.append("- " + row)
        return "\n".join(lines + tail)

    assert got == [plain(h) for (h,) in rows]
