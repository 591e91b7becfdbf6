"""Section trees after edits: ancestors, page ranges, reading order and new ids."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.meta import page_end, page_start, sync_pages, without_image_keys
from ..functions.text import non_empty
from ..session import cut_lineage
from .chunking import Chunked
from .scan import number_rows, page_ranges, ranges_of, running

KEY = ["doc_id", "section_id"]


def roots(sections: DataFrame) -> DataFrame:
    """Root of each document: the first section marked as one, else the first section."""
    marked = (
        (F.coalesce("level", F.lit(1)) == 0)
        | F.col("section_id").rlike("(_s00|_root)$")
        | non_empty("parent_section_id").isNull()
    )
    row = F.struct("section_pos", "section_id", "title")
    found = sections.groupBy("doc_id").agg(F.coalesce(F.min(F.when(marked, row)), F.min(row)).alias("r"))
    return found.select("doc_id", F.col("r.section_id").alias("root_id"), F.col("r.title").alias("root_title"))


def ancestors(sections: DataFrame) -> DataFrame:
    """Add ``path``: the ancestors of each section from nearest to farthest, below the root.

    Each entry is ``struct(id, title)``. ``reached`` tells whether the chain ends at the root; a missing
    parent or a cycle ends it too. Chains double in each round, so the rounds are the logarithm of the depth.
    """
    base = sections.join(roots(sections), "doc_id")
    base = cut_lineage(base.withColumn("is_root", F.col("section_id") == F.col("root_id")))
    return base.join(climb(base)[0], KEY)


def climb(base: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, section_id, path, reached) of sections with ``root_id`` and ``is_root``, and the rounds it took.

    A round joins every open chain with the chain of the section it stops at: 1, 3, 7, ... sections are known. Only
    open chains are written again.
    """
    entry = F.struct(F.col("section_id").alias("id"), "title")
    none = F.array().cast(base.select(F.array(entry).alias("path")).dtypes[0][1])
    start = base.select(
        *KEY, entry.alias("entry"), F.col("root_id"), F.when(~F.col("is_root"), non_empty("parent_section_id")).alias("at"), none.alias("path")
    )
    at_root = F.col("at").isNull() | (F.col("at") == F.col("root_id"))
    start = start.withColumns({"done": at_root, "reached": at_root & F.col("at").isNotNull()}).drop("root_id")
    closed, active = [start.where("done")], cut_lineage(start.where("NOT done"))
    rounds = 0
    while not active.isEmpty():
        rounds += 1
        known = reduce(DataFrame.unionByName, [*closed, active]).select(
            "doc_id", F.col("section_id").alias("at"), F.col("entry").alias("u_entry"), F.col("path").alias("u_path"), F.col("at").alias("u_at"),
            F.col("done").alias("u_done"), F.col("reached").alias("u_reached"),
        )
        step = active.drop("done", "reached").join(known, ["doc_id", "at"], "left")
        gone = F.col("u_entry").isNull()
        longer = step.select(
            *KEY, "entry", F.when(~gone, F.col("u_at")).alias("at"),
            F.when(gone, F.col("path")).otherwise(F.concat("path", F.array("u_entry"), "u_path")).alias("path"),
            (gone | F.col("u_done")).alias("done"), (~gone & F.col("u_reached")).alias("reached"),
        )
        # A chain that comes back to its section, or to one it has passed, is a cycle and is cut there.
        ids = F.transform("path", lambda x: x["id"])
        size = F.size("path")
        turns = F.array_contains(ids, F.col("section_id")) | (F.size(F.array_distinct(ids)) < size) | F.coalesce(
            F.array_contains(ids, F.col("at")) | (F.col("at") == F.col("section_id")), F.lit(False)
        )
        first_again = F.aggregate(
            ids, F.struct(F.lit(0).alias("n"), F.array("section_id").alias("seen"), F.lit(True).alias("open")),
            lambda s, x: F.when(s["open"] & ~F.array_contains(s["seen"], x), F.struct((s["n"] + 1).alias("n"), F.concat(s["seen"], F.array(x)).alias("seen"), F.lit(True).alias("open")))
            .otherwise(F.struct(s["n"].alias("n"), s["seen"].alias("seen"), F.lit(False).alias("open"))),
            lambda s: s["n"],
        )
        turned = longer.withColumn("turns", turns & ~F.col("reached"))
        turned = turned.withColumns(
            {
                "path": F.when(F.col("turns"), F.slice("path", F.lit(1), first_again)).otherwise(F.col("path")),
                "done": F.col("done") | F.col("turns"),
            }
        ).drop("turns")
        # Each round halves what is left of a chain, so open chains alone are stored anew.
        stepped = cut_lineage(turned)
        closed.append(stepped.where("done"))
        active = stepped.where("NOT done")
    return reduce(DataFrame.unionByName, closed).select(*KEY, "path", "reached"), rounds


def rebuild(sections: DataFrame) -> DataFrame:
    """Level, breadcrumbs and parent of every section from its parent links; orphans go under the root."""
    return _rebuilt(ancestors(sections)).select(*sections.columns)


def _rebuilt(closed: DataFrame) -> DataFrame:
    root = F.col("is_root")
    own = F.coalesce("title", F.lit(""))
    trail = F.concat(
        F.array(F.coalesce("root_title", F.lit(""))),
        F.transform(F.reverse("path"), lambda x: F.coalesce(x["title"], F.lit(""))),
        F.array(own),
    )
    nearest = F.get(F.col("path"), F.lit(0))["id"]
    return closed.withColumns(
        {
            "level": F.when(root, 0).otherwise(F.size("path") + 1),
            "breadcrumbs": F.when(root, F.array(own)).otherwise(trail),
            "parent_section_id": F.when(~root, F.coalesce(nearest, F.col("root_id"))),
        }
    )


def descendants(sections: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs (``ancestor_id``, ``section_id``) for the sections listed in ``of`` (doc_id, ancestor_id)."""
    closed = ancestors(sections)
    pairs = closed.select(
        *KEY,
        F.explode(
            F.concat(
                F.transform("path", lambda x: x["id"]),
                F.when(F.col("reached"), F.array("root_id")).otherwise(F.array().cast("array<string>")),
            )
        ).alias("ancestor_id"),
    )
    return pairs.join(of.select("doc_id", "ancestor_id").distinct(), ["doc_id", "ancestor_id"], "left_semi")


def _page_rollup(closed: DataFrame, children: DataFrame) -> DataFrame:
    own = children.groupBy(*KEY).agg(
        F.min(page_start("page_number")).alias("lo"), F.max(page_end("page_number", "page_end")).alias("hi")
    )
    has_sub = closed.where(non_empty("parent_section_id").isNotNull()).select(
        "doc_id", F.col("parent_section_id").alias("section_id"), F.lit(True).alias("has_sub")
    ).distinct()
    base = closed.join(own, KEY, "left").join(has_sub, KEY, "left")
    leaf = F.col("has_sub").isNull()
    base = base.withColumns(
        {
            "lo": F.coalesce("lo", F.when(leaf, F.coalesce("page_start", F.lit(1)))),
            "hi": F.coalesce("hi", F.when(leaf, F.coalesce("page_end", F.lit(1)))),
        }
    )
    up = F.concat(
        F.array("section_id"),
        F.transform("path", lambda x: x["id"]),
        F.when(F.col("reached"), F.array("root_id")).otherwise(F.array().cast("array<string>")),
    )
    ranges = (
        base.where(F.col("lo").isNotNull())
        .select("doc_id", F.explode(up).alias("section_id"), "lo", "hi")
        .groupBy(*KEY)
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    return closed.select(*KEY, "page_start", "page_end").join(ranges, KEY, "left").select(
        *KEY,
        F.coalesce("lo", "page_start", F.lit(1)).alias("page_start"),
        F.coalesce("hi", "page_end", F.lit(1)).alias("page_end"),
    )


def roll_up_pages(sections: DataFrame, children: DataFrame) -> DataFrame:
    """Page range of every section from its chunks and the sections below it."""
    pages = _page_rollup(ancestors(sections), children)
    return sections.drop("page_start", "page_end").join(pages, KEY, "left").select(*sections.columns)


def reading_order(sections: DataFrame) -> DataFrame:
    """(doc_id, section_id, section_no): depth-first order, siblings by first page; sections cut off from the root last."""
    return _reading_order(cut_lineage(ancestors(sections)))


def _reading_order(closed: DataFrame) -> DataFrame:
    """Places by sizes of subtrees: a section comes after its parent and the subtrees of its earlier siblings.

    The place is the sum of these offsets on the way from the root, so no window holds a document or a subtree; siblings
    are summed in ranges.
    """
    way = F.concat(F.transform("path", lambda x: x["id"]), F.array("section_id"))
    cut_off = F.when(F.col("is_root"), -1).when(F.col("reached") | non_empty("parent_section_id").isNull(), 0).otherwise(1)
    rows = closed.select(
        *KEY, "path", cut_off.alias("off"), way.alias("way"),
        F.coalesce(non_empty("parent_section_id"), F.col("root_id")).alias("family"),
        F.coalesce("page_start", F.lit(1)).cast("bigint").alias("page"), "section_pos",
    )
    kept = rows.where("off = 0")
    steps = cut_lineage(kept.select(*KEY, F.explode("way").alias("step")))
    sizes = steps.groupBy("doc_id", F.col("step").alias("section_id")).agg(F.count("*").alias("size"))
    siblings = kept.select(*KEY, "family", "page", "section_pos").join(sizes, KEY)
    offsets = running(
        siblings, ["doc_id", "family"], ["page", "section_pos"], {"before": ("sum", F.col("size"))}, page_ranges("page", "section_pos"), inclusive=False
    ).select("doc_id", F.col("section_id").alias("step"), (F.col("before") + 1).alias("offset"))
    placed = steps.join(offsets, ["doc_id", "step"]).groupBy(*KEY).agg(F.sum("offset").alias("section_no"))
    found = placed.unionByName(rows.where("off = -1").select(*KEY, F.lit(0).cast("bigint").alias("section_no")))
    lost = rows.where("off = 1")
    if lost.isEmpty():
        return found
    return found.unionByName(_lost_order(lost, rows))


def _lost_order(lost: DataFrame, rows: DataFrame) -> DataFrame:
    """Places of sections cut off from the root, behind all others: by the ranks among siblings on the way to them."""
    ranked = number_rows(lost, ["doc_id", "family"], ["page", "section_pos"], "rank", page_ranges("page", "section_pos"))
    ranked = ranked.select("doc_id", F.col("section_id").alias("step"), "rank")
    keyed = (
        lost.select(*KEY, F.posexplode(F.concat(F.reverse(F.transform("path", lambda x: x["id"])), F.array("section_id"))).alias("i", "step"))
        .join(ranked, ["doc_id", "step"])
        .groupBy(*KEY)
        .agg(F.array_sort(F.collect_list(F.struct("i", "rank"))).alias("s"))
        .select(*KEY, F.transform("s", lambda x: x["rank"]).alias("steps"))
    )
    keyed = keyed.withColumns({"top": F.get("steps", F.lit(0)), "second": F.coalesce(F.get("steps", F.lit(1)), F.lit(0))})
    ranges = [[F.col("top"), ranges_of("second")[0]], [ranges_of("top")[0]]]
    numbered = number_rows(keyed, ["doc_id"], ["steps", "section_id"], "n", ranges)
    before = rows.where("off < 1").groupBy("doc_id").agg(F.count("*").alias("kept"))
    return numbered.join(before, "doc_id").select(*KEY, (F.col("n") + F.col("kept") - 1).alias("section_no"))


def sync_positions(rows: DataFrame, listed: DataFrame, id_column: str, position: str) -> DataFrame:
    """New ``position``: listed rows first, in list order, then the others as they stood.

    ``listed`` has doc_id, the id, ``owner_pos`` and ``list_pos``; the first mention of an id counts.
    """
    first = listed.groupBy("doc_id", id_column).agg(F.min(F.struct("owner_pos", "list_pos")).alias("at"))
    keyed = rows.join(first, ["doc_id", id_column], "left").withColumns(
        {
            "__rest": F.col("at").isNull().cast("int"),
            "__owner": F.coalesce("at.owner_pos", F.lit(0)).cast("bigint"),
            "__seq": F.coalesce("at.list_pos", F.col(position)).cast("bigint"),
        }
    )
    ranges = [
        [F.col("__rest"), F.col("__owner"), ranges_of("__seq")[0]],
        [F.col("__rest"), ranges_of("__owner")[0]],
    ]
    out = number_rows(keyed.drop("at", position), ["doc_id"], ["__rest", "__owner", "__seq"], position, ranges)
    return out.select(*rows.columns)


def sync_order(chunked: Chunked) -> Chunked:
    """Parents in the order of their sections, children in the order of their parents; what has no owner comes last."""
    s = chunked.sections.select(*KEY, F.col("section_pos").alias("owner_pos"))
    listed = chunked.parents.select(*KEY, "parent_chunk_id", F.col("parent_pos").alias("list_pos")).join(s, KEY)
    parents = sync_positions(chunked.parents, listed, "parent_chunk_id", "parent_pos")
    return Chunked(chunked.sections, parents, follow_parents(chunked.children, parents))


def follow_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children in the order of their parents, those of one parent as they stood; without a parent last."""
    p = parents.select("doc_id", "parent_chunk_id", F.col("parent_pos").alias("owner_pos"))
    listed = children.select("doc_id", "parent_chunk_id", "chunk_id", F.col("child_pos").alias("list_pos")).join(p, ["doc_id", "parent_chunk_id"])
    return sync_positions(children, listed, "chunk_id", "child_pos")


@dataclass(frozen=True)
class Reindexed:
    chunked: Chunked
    section_map: DataFrame
    parent_map: DataFrame
    child_map: DataFrame


def reindex(chunked: Chunked, names: DataFrame | None = None) -> Reindexed:
    """Dense new ids for all three tables in reading order, with every reference moved along.

    Rows of one page keep the order the user gave their sections and parents (``sync_order``).

    ``names`` (doc_id, name) gives the file name or title that seeds the id of documents with an old-style
    id; the root title is used otherwise.
    """
    parents, children = chunked.parents, chunked.children
    sections = cut_lineage(chunked.sections)
    # Ids, positions and pages, without texts: all orders are worked out on these.
    slim_parents = cut_lineage(parents.select(*KEY, "parent_chunk_id", "parent_pos", "page_start"))
    slim_children = cut_lineage(children.select(*KEY, "parent_chunk_id", "chunk_id", "child_pos", "page_number", "page_end"))
    synced = sync_order(Chunked(sections, slim_parents, slim_children))
    closed = cut_lineage(ancestors(sections))
    pages = _page_rollup(closed, slim_children)
    closed = cut_lineage(closed.drop("page_start", "page_end").join(pages, KEY))

    seed = roots(sections)
    if names is not None:
        seed = seed.join(names.select("doc_id", "name"), "doc_id", "left")
    name = non_empty("name") if names is not None else F.lit(None).cast("string")
    new_doc = F.when(ids.is_full_doc_id("doc_id"), F.col("doc_id")).otherwise(
        ids.doc_id(F.coalesce(name, non_empty("root_title"), non_empty("doc_id"), F.lit("doc")))
    )
    docs = seed.select("doc_id", new_doc.alias("new_doc"))

    smap = cut_lineage(
        _reading_order(closed).join(docs, "doc_id").select(
            *KEY, "section_no", ids.section_id("new_doc", F.col("section_no")).alias("new_section_id")
        )
    )
    page = page_start("page_start").cast("bigint")
    pmap = number_rows(
        synced.parents.select("doc_id", "parent_chunk_id", "parent_pos", page.alias("page")),
        ["doc_id"], ["page", "parent_pos"], "n", page_ranges("page", "parent_pos"),
    ).join(docs, "doc_id")
    pmap = cut_lineage(
        pmap.select("doc_id", "parent_chunk_id", F.col("n").alias("new_pos"), ids.parent_id("new_doc", F.col("n")).alias("new_parent_id"))
    )
    cmap = number_rows(
        synced.children.select("doc_id", "chunk_id", "child_pos", page_start("page_number").cast("bigint").alias("page")),
        ["doc_id"], ["page", "child_pos"], "n", page_ranges("page", "child_pos"),
    ).join(docs, "doc_id")
    cmap = cmap.select("doc_id", "chunk_id", F.col("n").alias("new_pos"), ids.chunk_id("new_doc", F.col("n")).alias("new_chunk_id"))

    above = smap.select("doc_id", F.col("section_id").alias("parent_section_id"), F.col("new_section_id").alias("new_above"))
    new_sections = (
        _rebuilt(closed).join(smap, KEY).join(docs, "doc_id").join(above, ["doc_id", "parent_section_id"], "left")
    )
    owners = new_sections.select(*KEY, "new_section_id", F.col("breadcrumbs").alias("crumbs"), F.col("title").alias("section_title"))
    sections_out = new_sections.withColumns(
        {
            "section_id": F.col("new_section_id"),
            "section_pos": F.col("section_no"),
            "parent_section_id": F.coalesce("new_above", "parent_section_id"),
            "doc_id": F.col("new_doc"),
        }
    ).select(*chunked.sections.columns)

    p = parents.join(docs, "doc_id").join(pmap, ["doc_id", "parent_chunk_id"]).join(owners, KEY, "left")
    crumbs = F.when(
        non_empty("title").isNotNull() & (F.col("title") != F.coalesce("section_title", F.lit(""))),
        F.concat("crumbs", F.array("title")),
    ).otherwise(F.col("crumbs"))
    parents_out = p.withColumns(
        {
            "breadcrumbs": F.coalesce(crumbs, "breadcrumbs"),
            "parent_chunk_id": F.col("new_parent_id"),
            "parent_pos": F.col("new_pos"),
            "section_id": F.coalesce("new_section_id", "section_id"),
            "doc_id": F.col("new_doc"),
        }
    ).select(*chunked.parents.columns)

    owner_parent = pmap.select("doc_id", "parent_chunk_id", "new_parent_id")
    c = (
        children.join(docs, "doc_id")
        .join(cmap, ["doc_id", "chunk_id"])
        .join(owner_parent, ["doc_id", "parent_chunk_id"], "left")
        .join(owners, KEY, "left")
    )
    children_out = c.withColumns(
        {
            "chunk_id": F.col("new_chunk_id"),
            "child_pos": F.col("new_pos"),
            "parent_chunk_id": F.coalesce("new_parent_id", "parent_chunk_id"),
            "section_id": F.coalesce("new_section_id", "section_id"),
            "breadcrumbs": F.coalesce("crumbs", "breadcrumbs"),
            "page_end": page_end("page_number", "page_end"),
            "metadata": sync_pages(without_image_keys("metadata"), "page_number", "page_end"),
            "doc_id": F.col("new_doc"),
        }
    ).select(*chunked.children.columns)
    return Reindexed(Chunked(sections_out, parents_out, children_out), smap, pmap, cmap)
