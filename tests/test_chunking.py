import random

import pytest
from pyspark.sql import functions as F

import plain
from chunkloom.functions import text as tx
from chunkloom.operators.chunking import chunk_blocks, section_text
from chunkloom.schemas import BLOCKS


def rows_to_blocks(spark, docs):
    """docs: {doc_id: (strategy, [(page, type, level, text, html, caption, footnote)])}"""
    rows = [
        (d, d + " title", s, i, p, t, lv, x, h, c, f, "simple_table" if t == "table" else None)
        for d, (s, blocks) in docs.items()
        for i, (p, t, lv, x, h, c, f) in enumerate(blocks)
    ]
    return spark.createDataFrame(rows, BLOCKS)


def para(page, text, kind="paragraph"):
    return (page, kind, None, text, None, None, None)


def title(page, text, level=1):
    return (page, "title", level, text, None, None, None)


def table(page, html, caption="", footnote=""):
    return (page, "table", None, None, html, caption, footnote)


def html_table(rows, cols=3):
    body = "".join("<tr>" + "".join(f"<td>cell {r} {c}</td>" for c in range(cols)) + "</tr>" for r in range(rows))
    return f"<table>{body}</table>"


def everything(chunked):
    return {
        n: sorted(
            [r.asDict(recursive=True) for r in getattr(chunked, n).collect()],
            key=lambda r: tuple(str(r.get(k)) for k in ("doc_id", "chunk_id", "parent_chunk_id", "section_id")),
        )
        for n in ("sections", "parents", "children")
    }


def random_docs(seed, n_docs=6):
    rng = random.Random(seed)

    def sentence():
        words = [rng.choice(["alpha", "be", "gamma", "여러", "단어"]) for _ in range(rng.randint(1, 12))]
        return " ".join(words).capitalize() + rng.choice([".", "!", "다.", ","])

    docs = {}
    for d in range(n_docs):
        blocks = []
        for i in range(rng.randint(8, 60)):
            page = 1 + i // 7
            r = rng.random()
            if d % 2:  # legal
                if r < 0.12:
                    kind = rng.choice(["편", "장", "절", "관"])
                    blocks.append(para(page, f"제{rng.randint(1, 9)}{kind} {sentence()}"))
                elif r < 0.4:
                    blocks.append(para(page, f"제{rng.randint(1, 3)}조(목적) " + " ".join(sentence() for _ in range(3))))
                elif r < 0.5:
                    blocks.append(table(page, html_table(rng.randint(1, 30)), rng.choice(["", "캡션"]), ""))
                else:
                    blocks.append(para(page, "① " + sentence() + " ② " + sentence()))
            elif r < 0.2:
                mark = rng.choice(["I. ", "1. ", "1.1 ", "가. ", "(1) ", "", "제1장 "])
                blocks.append(title(page, mark + sentence(), rng.randint(1, 4)))
            elif r < 0.3:
                blocks.append(table(page, html_table(rng.randint(1, 30)), rng.choice(["", "cap"]), "note"))
            elif r < 0.35:
                blocks.append(para(page, "running head", "page_header"))
            else:
                blocks.append(para(page, " ".join(sentence() for _ in range(rng.randint(1, 5)))))
        docs[f"doc{d}"] = ("legal" if d % 2 else "general", blocks)
    return docs


def expected_general(doc, blocks, child_budget):
    """(breadcrumbs, text, first page, last page) of the text children of a general document."""
    stack, tail, packs, run = [(0, doc + " title")], [], [], []
    import re

    def flush():
        nonlocal run
        if run:
            ws = [plain.tokens(u) for u, _, _ in run]
            for p in plain.pack(ws, child_budget):
                crumbs = run[p[0]][2]
                text = " ".join(" ".join(run[i][0] for i in p).split())
                packs.append((crumbs, text, run[p[0]][1], run[p[-1]][1]))
            run = []

    for page, kind, level, text, *_ in blocks:
        if kind == "title":
            if re.match(r"[IVXLCDM]+[.\s]|제\d+장", text):
                level = 1
            elif re.match(r"\d+\.\d+|[가-하][.\s]|\(\d+\)", text):
                level = 3
            elif re.match(r"\d+[.\s]", text):
                level = 2 if any(lv == 1 for lv, _ in stack) else min(level, 2)
            flush()
            if level <= 2:
                while stack[-1][0] >= level:
                    stack.pop()
                stack.append((level, text))
                tail = []
            else:
                tail = [text]
        elif kind == "table":
            flush()
            packs.append(([t for _, t in stack], None, page, page))
        elif kind == "paragraph":
            crumbs = [t for _, t in stack] + tail
            run += [(u, page, crumbs) for u in plain.units_of(text, False, child_budget)]
    flush()
    return packs


@pytest.mark.parametrize("seed", [1])
def test_general_children_match_direct_version(spark, seed):
    docs = random_docs(seed)
    out = everything(chunk_blocks(rows_to_blocks(spark, docs), child_tokens=40, parent_tokens=120))
    for doc, (strategy, blocks) in docs.items():
        if strategy == "legal":
            continue
        got = [c for c in out["children"] if c["doc_id"] == doc]
        got.sort(key=lambda c: c["child_pos"])
        want = expected_general(doc, blocks, 40)
        assert [c["breadcrumbs"] for c in got] == [w[0] for w in want]
        assert [(c["page_number"], c["page_end"]) for c in got] == [w[2:] for w in want]
        assert [None if c["is_table"] else c["text"] for c in got] == [w[1] for w in want]


@pytest.mark.parametrize("seed", [3])
def test_parents_follow_children(spark, seed):
    docs = random_docs(seed)
    out = everything(chunk_blocks(rows_to_blocks(spark, docs), child_tokens=40, parent_tokens=120))
    for doc in docs:
        children = sorted((c for c in out["children"] if c["doc_id"] == doc), key=lambda c: c["child_pos"])
        sections = {s["section_id"]: s for s in out["sections"] if s["doc_id"] == doc}
        assert [c["chunk_id"] for c in children] == [f"{doc}_c{i + 1:04d}" for i in range(len(children))]
        want, runs = [], []
        for c in children:
            huge = c["is_table"] and plain.tokens(c["raw_html"]) > 120
            if huge or not runs or runs[-1][0] != c["section_id"] or runs[-1][1]:
                runs.append((c["section_id"], huge, []))
            runs[-1][2].append(c)
        for section, huge, items in runs:
            packs = plain.pack_articles(
                [(c["token_estimate"], None if huge else c["metadata"].get("article_display")) for c in items], 120
            )
            for p, name in packs:
                name = name or sections[section]["title"]
                if huge:
                    name = items[0]["table_caption"] or sections[section]["title"] + " - 대형 표"
                want.append(([items[i]["chunk_id"] for i in p], name))
        got = sorted((p for p in out["parents"] if p["doc_id"] == doc), key=lambda p: p["parent_pos"])
        members = {}
        for c in children:
            members.setdefault(c["parent_chunk_id"], []).append(c["chunk_id"])
        assert [(members[p["parent_chunk_id"]], p["title"]) for p in got] == want
        assert [p["parent_chunk_id"] for p in got] == [f"{doc}_p{i + 1:04d}" for i in range(len(got))]


@pytest.mark.parametrize("seed,size", [(1, 3)])
def test_ranges_give_the_same_chunks(spark, seed, size):
    blocks = rows_to_blocks(spark, random_docs(seed))
    plain_run = chunk_blocks(blocks, 40, 120, long_docs=False)
    cut_run = chunk_blocks(blocks.repartition(7), 40, 120, range_rows=size)
    assert everything(plain_run) == everything(cut_run)


def test_sections_levels_and_links(spark):
    docs = {
        "law": (
            "legal",
            [
                para(1, "제1편 총칙"),
                para(1, "제1장 일반\n이어지는 줄"),
                para(1, "제1조(목적) 이 규정은 목적을 정한다. ① 첫째 항이다. ② 둘째 항이다."),
                para(2, "제2절 세부"),
                para(3, "제2조 본문이다."),
                para(3, "제2장 다음"),
                para(4, "부칙"),
            ],
        )
    }
    out = everything(chunk_blocks(rows_to_blocks(spark, docs)))
    got = [(s["section_id"], s["title"], s["level"], s["parent_section_id"], s["page_start"], s["page_end"]) for s in out["sections"]]
    assert got == [
        ("law_s00", "law title", 0, None, 1, 1),
        ("law_s01", "제1편 총칙", 1, "law_s00", 1, 1),
        ("law_s02", "제1장 일반", 2, "law_s01", 1, 1),
        ("law_s03", "제2절 세부", 3, "law_s02", 3, 3),
        ("law_s04", "제2장 다음", 2, "law_s01", 3, 3),
        ("law_s05", "부칙", 2, "law_s01", 4, 4),
    ]
    first = out["children"][0]
    assert first["chunk_type"] == "article_clause"
    assert first["breadcrumbs"] == ["law title", "제1편 총칙", "제1장 일반", "제1조(목적)"]
    assert first["metadata"]["article_title"] == "목적"


def test_children_span_pages(spark):
    docs = {
        "g": ("general", [title(3, "Head")] + [para(p, f"Short text {p}.") for p in (3, 4, 5)]),
        "l": ("legal", [para(3, "제1장 총칙"), para(3, "제1조(정의) 첫째"), para(4, "② 둘째"), para(5, "③ 셋째")]),
    }
    for c in everything(chunk_blocks(rows_to_blocks(spark, docs)))["children"]:
        assert (c["page_number"], c["page_end"], c["metadata"]["pages"]) == (3, 5, "[3,4,5]")


def test_huge_table_has_its_own_parent(spark):
    docs = {"d": ("legal", [para(1, "제1조 앞"), table(1, html_table(250, 4), "큰 표"), para(2, "제2조 뒤")])}
    out = everything(chunk_blocks(rows_to_blocks(spark, docs)))
    assert [p["title"] for p in out["parents"]] == ["제1조", "큰 표", "제2조"]
    t = out["children"][1]
    assert t["is_atomic_table"] and t["text"].startswith("[표: 큰 표] 컬럼: cell 0 0 | cell 0 1")
    assert plain.tokens(t["text"]) <= 512


def test_section_text_parts_join_to_the_whole(spark):
    parents = spark.createDataFrame(
        [("d", "s", i, f"text {i}") for i in range(1, 11)], "doc_id string, section_id string, parent_pos bigint, text string"
    )
    parts = [r.full_text for r in section_text(parents, part_rows=3).orderBy("part_no").collect()]
    assert len(parts) == 4
    assert "\n\n".join(parts) == "\n\n".join(f"text {i}" for i in range(1, 11))


def test_empty_input_gives_empty_tables(spark):
    out = everything(chunk_blocks(spark.createDataFrame([], BLOCKS)))
    assert out == {"sections": [], "parents": [], "children": []}


def test_units_match_direct_version(spark):
    rng = random.Random(5)
    pieces = ["alpha beta", "word,", "x;", "끝났다.", "End.", "3.14%", "① 항", "1. item", "가. 목", "multi-\nlingual", "\n", "\n\n", "Q?", " ", "A", "longword" * 9]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("t", tx.text_units("t", False, 30).alias("g"), tx.text_units("t", True, 30).alias("l")).collect()
    for r in got:
        assert r.g == plain.units_of(r.t, False, 30)
        assert r.l == plain.units_of(r.t, True, 30)


def test_children_in_context_equal_a_join(spark):
    from chunkloom.operators.chunking import children_in_context
    from chunkloom.operators.index import attach_parent_text

    docs = {
        "a": ("general", [title(1, "One"), *[para(1, f"Some words of line {k}.") for k in range(60)], table(2, html_table(3))]),
        "b": ("general", [para(1, "short")]),
        "c": ("general", [table(1, html_table(90)), para(2, "end")]),
    }
    blocks = rows_to_blocks(spark, docs).repartition(3)
    chunks = chunk_blocks(blocks, 40, 120, long_docs=False)
    want = attach_parent_text(chunks.children, chunks.parents)
    got = children_in_context(blocks, 40, 120, long_docs=False)
    assert got.columns == [*chunks.children.columns, "parent_text"]
    key = lambda df: sorted((r["chunk_id"], r["text"], r["parent_chunk_id"], r["parent_text"]) for r in df.collect())
    assert key(got) == key(want) and len(key(got)) > 10
