import random

from pyspark.sql import functions as F

from chunkloom.operators import edits, tree
from chunkloom.operators.chunking import Chunked
from chunkloom.schemas import CHILDREN, PARENTS, SECTIONS


def sections(spark, rows):
    """rows: (id, title, level, parent, page_start, page_end)"""
    return spark.createDataFrame(
        [("d", i, n, t, lv, p, [t], a, b) for n, (i, t, lv, p, a, b) in enumerate(rows)], SECTIONS
    )


def test_levels_orphans_and_cycles(spark):
    s = sections(
        spark,
        [
            ("d_s00", "Root", 0, None, 1, 1),
            ("a", "A", 1, "d_s00", 1, 1),
            ("b", "B", 5, "a", 1, 1),
            ("c", "C", 9, "b", 1, 1),
            ("o", "Orphan", 2, "gone", 1, 1),
            ("x", "X", 2, "y", 1, 1),
            ("y", "Y", 2, "x", 1, 1),
        ],
    )
    got = {r.section_id: (r.level, r.breadcrumbs, r.parent_section_id) for r in tree.rebuild(s).collect()}
    assert got["d_s00"] == (0, ["Root"], None)
    assert got["c"] == (3, ["Root", "A", "B", "C"], "b")
    assert got["o"] == (1, ["Root", "Orphan"], "d_s00")
    assert got["x"] == (2, ["Root", "Y", "X"], "y")


def test_reindex(spark):
    s = sections(
        spark,
        [
            ("d_s00", "Root", 0, None, 1, 1),
            ("late", "Late", 1, "d_s00", 9, 9),
            ("box", "Container", 1, "d_s00", 1, 1),
            ("sub", "Sub", 2, "box", 1, 1),
            ("early", "Early", 1, "d_s00", 1, 1),
        ],
    )
    parents = spark.createDataFrame(
        [("d", f"P{i}", i, sec, t, "text", 1, p, p, [], False) for i, sec, t, p in [(1, "late", "L", 9), (2, "sub", "Sub", 4), (3, "early", "E", 2)]],
        PARENTS,
    )
    meta = {"image_path": "x", "k": "v"}
    child = lambda i, p, sec, page, end: ("d", f"C{i}", i, p, sec, "paragraph", f"t{i}", None, None, None, None, 3, page, end, [], False, False, False, False, meta)
    children = spark.createDataFrame([child(1, "P1", "late", 9, 9), child(2, "P2", "sub", 4, 6), child(3, "P3", "early", 2, 1), child(4, "gone", "gone", 2, 2)], CHILDREN)
    names = spark.createDataFrame([("d", "file.pdf")], "doc_id string, name string")
    out = tree.reindex(Chunked(s, parents, children), names)
    doc = out.chunked.sections.first().doc_id
    assert doc.startswith("doc_") and len(doc) == 36
    got = {r.title: (r.section_id[len(doc):], r.level, r.page_start, r.page_end) for r in out.chunked.sections.collect()}
    assert got == {
        "Root": ("_s00", 0, 2, 9),
        "Early": ("_s01", 1, 2, 2),
        "Container": ("_s02", 1, 4, 6),
        "Sub": ("_s03", 2, 4, 6),
        "Late": ("_s04", 1, 9, 9),
    }
    kids = {r.text: r for r in out.chunked.children.collect()}
    assert [kids[t].chunk_id[len(doc):] for t in ("t3", "t4", "t2", "t1")] == ["_c0001", "_c0002", "_c0003", "_c0004"]
    assert kids["t2"].parent_chunk_id == f"{doc}_p0002" and kids["t4"].parent_chunk_id == "gone"
    assert kids["t2"].breadcrumbs == ["Root", "Container", "Sub"]
    assert kids["t3"].page_end == 2 and "image_path" not in kids["t3"].metadata and kids["t3"].metadata["k"] == "v"
    crumbs = {r.title: r.breadcrumbs for r in out.chunked.parents.collect()}
    assert crumbs == {"L": ["Root", "Late", "L"], "Sub": ["Root", "Container", "Sub"], "E": ["Root", "Early", "E"]}


def test_children_follow_moved_parents(spark):
    s = sections(spark, [("d_s00", "Root", 0, None, 1, 1), ("a", "A", 1, "d_s00", 1, 1)])
    parents = spark.createDataFrame([("d", f"P{i}", i, "a", f"T{i}", "text", 1, 1, 1, [], False) for i in (1, 2, 3)], PARENTS)
    child = lambda i, p: ("d", f"C{i}", i, p, "a", "paragraph", f"t{i}", None, None, None, None, 3, 1, 1, [], False, False, False, False, {})
    children = spark.createDataFrame([child(1, "P1"), child(2, "P1"), child(3, "P2"), child(4, "P3"), child(5, "gone")], CHILDREN)
    moves = spark.createDataFrame([("d", "P2", 0)], "doc_id string, parent_chunk_id string, ordinal int")
    moved = edits.reorder_parents(Chunked(s, parents, children), moves)
    order = lambda rows, pos, name: [r[name] for r in rows.orderBy(pos).collect()]
    assert order(moved.parents, "parent_pos", "title") == ["T2", "T1", "T3"]
    assert order(moved.children, "child_pos", "text") == ["t3", "t1", "t2", "t4", "t5"]
    # Children that were left behind are brought into order by re-id too.
    out = tree.reindex(Chunked(s, moved.parents, children)).chunked
    assert order(out.parents, "parent_chunk_id", "title") == ["T2", "T1", "T3"]
    assert order(out.children, "chunk_id", "text") == ["t3", "t1", "t2", "t4", "t5"]


def test_parents_follow_moved_sections(spark):
    s = sections(spark, [("d_s00", "Root", 0, None, 1, 1), ("a", "A", 1, "d_s00", 1, 1), ("b", "B", 1, "d_s00", 1, 1)])
    parents = spark.createDataFrame([("d", f"P{i}", i, sec, f"T{i}", "text", 1, 1, 1, [], False) for i, sec in ((1, "a"), (2, "b"))], PARENTS)
    child = lambda i, p, sec: ("d", f"C{i}", i, p, sec, "paragraph", f"t{i}", None, None, None, None, 3, 1, 1, [], False, False, False, False, {})
    children = spark.createDataFrame([child(1, "P1", "a"), child(2, "P2", "b")], CHILDREN)
    moves = spark.createDataFrame([("d", "b", 0)], "doc_id string, section_id string, ordinal int")
    out = tree.reindex(edits.reorder_sections(Chunked(s, parents, children), moves)).chunked
    assert [r.title for r in out.sections.orderBy("section_id").collect()] == ["Root", "B", "A"]
    assert [r.title for r in out.parents.orderBy("parent_chunk_id").collect()] == ["T2", "T1"]
    assert [r.text for r in out.children.orderBy("chunk_id").collect()] == ["t2", "t1"]


def plain_climb(rows):
    """{id: (path, reached)} by walking up; rows: (id, parent), the first is the root."""
    up = dict(rows)
    root = rows[0][0]
    out = {}
    for i, parent in rows:
        path, at = [], None if i == root else parent
        while at is not None and at != root and at in up and at not in path and at != i:
            path.append(at)
            at = up[at]
        out[i] = (path, i != root and at == root)
    return out


def plain_order(rows, pages):
    """{id: place}: depth first, siblings by page and listing; what is cut off behind, by sibling ranks and id."""
    found = plain_climb(rows)
    root = rows[0][0]
    listed = {i: n for n, (i, _) in enumerate(rows)}
    family = {i: p if p is not None else root for i, p in rows}
    rank = {}
    for f in set(family.values()):
        own = sorted((i for i in family if family[i] == f and i != root), key=lambda i: (pages[i], listed[i]))
        rank.update({i: n for n, i in enumerate(own)})
    off = {i: -1 if i == root else 0 if found[i][1] or dict(rows)[i] is None else 1 for i in listed}
    for f in set(family.values()):  # ranks count siblings of one kind
        for kind in (0, 1):
            own = sorted((i for i in family if family[i] == f and off[i] == kind), key=lambda i: (pages[i], listed[i]))
            rank.update({i: n for n, i in enumerate(own)})
    steps = {i: [rank.get(x, 0) for x in [*reversed(found[i][0]), i]] for i in listed}
    return {i: n for n, i in enumerate(sorted(listed, key=lambda i: (off[i], steps[i], i)))}


def table_of(spark, docs):
    """docs: {doc: (rows, pages)}"""
    data = [(d, i, n, i.upper(), 0 if n == 0 else 1, p, [], pages[i], pages[i]) for d, (rows, pages) in docs.items() for n, (i, p) in enumerate(rows)]
    return spark.createDataFrame(data, SECTIONS)


def test_random_trees_agree_with_walking(spark):
    rng = random.Random(3)
    docs = {}
    for d in range(25):
        ids = [f"r{d}_root"] + [f"x{k}" for k in range(rng.randrange(0, 14))]
        rows = [(ids[0], None)]
        for k, i in enumerate(ids[1:], 1):
            above = [*ids[:k], ids[0]] if d % 3 else [*ids, "gone"]  # cycles and missing parents in every third
            rows.append((i, rng.choice([x for x in above if x != i or d % 3 == 0])))
        docs[f"d{d}"] = (rows, {i: rng.randrange(1, 4) for i in ids})
    s = table_of(spark, docs)
    got = {(r["doc_id"], r["section_id"]): ([x["id"] for x in r["path"]], r["reached"]) for r in tree.ancestors(s).collect()}
    assert got == {(d, i): v for d, (rows, _) in docs.items() for i, v in plain_climb(rows).items()}
    order = {(r["doc_id"], r["section_id"]): r["section_no"] for r in tree.reading_order(s).collect()}
    assert order == {(d, i): n for d, (rows, pages) in docs.items() for i, n in plain_order(rows, pages).items()}


def test_a_chain_of_a_thousand_takes_few_rounds(spark):
    rows = [("root", None)] + [(f"c{k}", f"c{k - 1}" if k else "root") for k in range(1000)]
    s = table_of(spark, {"d": (rows, {i: 1 for i, _ in rows})})
    base = s.join(tree.roots(s), "doc_id").withColumn("is_root", F.col("section_id") == F.col("root_id"))
    found, rounds = tree.climb(base)
    assert rounds <= 12
    got = {r["section_id"]: ([x["id"] for x in r["path"]], r["reached"]) for r in found.collect()}
    assert got == plain_climb(rows)


def test_many_sections_under_one_heading(spark):
    n = 30_000
    rows = spark.range(n).select(
        F.lit("d").alias("doc_id"), F.format_string("s%05d", "id").alias("section_id"), F.col("id").alias("section_pos"), F.lit("t").alias("title"),
        F.when(F.col("id") == 0, 0).otherwise(1).alias("level"),
        F.when(F.col("id") == 0, F.lit(None)).when(F.col("id") == 1, "s00000").otherwise("s00001").alias("parent_section_id"),
        F.array().cast("array<string>").alias("breadcrumbs"), (F.lit(n) - F.col("id")).cast("int").alias("page_start"), F.lit(1).alias("page_end"),
    )
    found = tree.reading_order(rows)
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["section_id"]: r["section_no"] for r in found.collect()}
    assert got["s00000"] == 0 and got["s00001"] == 1
    assert all(got[f"s{k:05d}"] == n - k + 1 for k in range(2, n))
