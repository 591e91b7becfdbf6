"""Blocks to sections, parent chunks and child chunks.

One shuffle by document carries the text: headings are numbered by windows, text is cut into units,
units are packed into children and children into parents inside the same partitions. Documents longer
than one range of blocks are cut into ranges (see ``scan`` and ``packing``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import patterns as P
from ..functions.meta import no_metadata, overlay, sync_pages
from ..functions.tables import table_rows, table_search_text
from ..functions.text import (
    context_text,
    embedding_text,
    non_empty,
    strip,
    token_estimate,
    weighted_units,
)
from ..session import cut_lineage
from .headings import article_display, classify
from .packing import pack
from .scan import RANGE_ROWS, latest, latest_value, number_rows, position_ranges, running

LEVELS = (1, 2, 3, 4)


@dataclass(frozen=True)
class Chunked:
    """The three linked tables of a corpus. Store them before using more than one (``save``)."""

    sections: DataFrame
    parents: DataFrame
    children: DataFrame

    def save(self, path: str, mode: str = "overwrite") -> "Chunked":
        spark = self.sections.sparkSession
        for name in ("sections", "parents", "children"):
            getattr(self, name).write.mode(mode).parquet(f"{path}/{name}")
        return Chunked(*(spark.read.parquet(f"{path}/{n}") for n in ("sections", "parents", "children")))

    def stored(self) -> "Chunked":
        """The same tables cut from their lineage; call it between edits, so that plans do not pile up."""
        return Chunked(*(cut_lineage(t) for t in (self.sections, self.parents, self.children)))


def outline(blocks: DataFrame, long_docs: bool = False, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Classified blocks with section number, run number, breadcrumbs, section parent and open marker."""
    b = classify(blocks)
    # Only table rows pass through Python.
    tables = b.where(F.col("kind") == "table").withColumn("rows", table_rows("html"))
    tables = tables.withColumn("search_text", table_search_text("html", "rows", "caption", "footnote")).drop("rows")
    b = b.where(F.col("kind") != "table").withColumn("search_text", F.lit(None).cast("string")).unionByName(tables)

    ranges = position_ranges("block_no", range_rows) if long_docs else ()
    kind, pos = F.col("kind"), F.col("block_no")
    section, marker = kind == "section", kind == "marker"
    top = section & ~F.col("legal") & (
        (F.col("heading_level") == 1) | ((F.col("heading_level") == 0) & (F.col("declared") == 1))
    )
    one = F.lit(1).cast("bigint")
    b = running(
        b,
        ["doc_id"],
        ["block_no"],
        {
            "section_no": ("sum", F.when(section, one)),
            "breaks": ("sum", F.when(kind != "text", one)),
            "first_top": ("min", F.when(top, pos)),
            "section_at": ("max", F.when(section, pos)),
            "mark": latest(["block_no"], F.when(marker, F.struct("heading", "article_no", "article_title"))),
        },
        ranges,
    )
    level = F.when(
        F.col("heading_level") == 0, F.when(F.col("first_top") < pos, 2).otherwise(F.col("declared"))
    ).otherwise(F.col("heading_level"))
    b = b.withColumn("heading_level", level)
    b = running(
        b,
        ["doc_id"],
        ["block_no"],
        {
            f"at{k}": latest(["block_no"], F.when(section & (F.col("heading_level") == k), F.struct("section_no", "heading")))
            for k in LEVELS
        },
        ranges,
    )
    # The heading of a level is open unless a heading of a lower level came after it.
    entries, above = [], F.lit(0).cast("bigint")
    for k in LEVELS:
        entry = latest_value(f"at{k}")
        number = F.coalesce(entry["section_no"], F.lit(0))
        entries.append(F.when(number > above, entry))
        above = F.greatest(above, number)
    trail = F.filter(F.array(*entries), lambda x: x.isNotNull())
    b = b.withColumn("trail", trail)
    live = F.when(F.col("mark").isNotNull() & (F.col("mark.block_no") > F.coalesce("section_at", F.lit(-1))), latest_value("mark"))
    return b.withColumns(
        {
            "breadcrumbs": F.concat(F.array("doc_title"), F.transform("trail", lambda x: x["heading"])),
            "depth": F.size("trail"),
            "parent_no": F.coalesce(F.try_element_at("trail", F.lit(-2))["section_no"], F.lit(0)),
            "mark": F.when(kind != "table", live),
            "run": F.col("breaks") * 2 + F.when(kind == "table", 0).otherwise(1),
        }
    ).drop("trail", "breaks", "first_top", "section_at", *[f"at{k}" for k in LEVELS])


def child_units(outlined: DataFrame, max_tokens: int = P.CHILD_BUDGET) -> DataFrame:
    """Blocks with text or a table, each with its array of weighted units; a table is one unit."""
    kind = F.col("kind")
    rows = outlined.where(kind.isin("text", "table") | ((kind == "marker") & F.col("legal")))
    table = F.array(F.struct(F.col("search_text").alias("s"), token_estimate("search_text").alias("w")))
    units = (
        F.when(kind == "table", table)
        .when(F.col("legal"), weighted_units("text", True, max_tokens))
        .otherwise(weighted_units("text", False, max_tokens))
    )
    return rows.withColumn("units", units).drop("text", "search_text")


RUN_COLUMNS = (
    "doc_title", "section_no", "breadcrumbs", "mark", "kind", "legal", "html", "caption", "footnote", "table_type",
)


def pack_children(
    outlined: DataFrame, max_tokens: int = P.CHILD_BUDGET, long_docs: bool = False, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Child chunks numbered within their document, with section, article and metadata."""
    units = child_units(outlined, max_tokens)
    seg = position_ranges("block_no", range_rows)[0][0] if long_docs else F.lit(0).cast("bigint")
    block = F.struct("block_no", F.col("page_number").alias("page"), "units")
    keys = ["doc_id", "run"]
    groups = (
        units.withColumn("seg", seg)
        .groupBy("doc_id", "seg", "run")
        .agg(
            F.array_sort(F.collect_list(block)).alias("blocks"),
            *[F.first(c).alias(c) for c in RUN_COLUMNS],
        )
    )
    items = F.transform(
        "blocks",
        lambda b: F.transform(
            b["units"],
            lambda u, i: F.struct(b["block_no"], i.alias("unit_no"), u["w"].alias("w"), b["page"], u["s"].alias("s")),
        ),
    )
    groups = groups.withColumn("items", F.flatten(items)).drop("blocks")
    if long_docs:
        groups = cut_lineage(groups)
    packs = pack(groups, keys, "seg", max_tokens, spans=long_docs)
    first, last = F.col("items")[0], F.element_at("items", -1)
    table = F.col("kind") == "table"
    number, title = F.col("mark.article_no"), F.col("mark.article_title")
    display = article_display(number, title)
    text = embedding_text(F.array_join(F.transform("items", lambda x: x["s"]), " "))
    rows = packs.select(
        "doc_id",
        "doc_title",
        "section_no",
        first["block_no"].alias("b0"),
        first["unit_no"].alias("u0"),
        F.when(table, "table").when(number.isNotNull(), "article_clause").otherwise("paragraph").alias("chunk_type"),
        text.alias("text"),
        F.when(table, F.coalesce("html", F.lit(""))).alias("raw_html"),
        F.when(table, F.coalesce("caption", F.lit(""))).alias("table_caption"),
        F.when(table, F.coalesce("footnote", F.lit(""))).alias("table_footnote"),
        F.when(table, F.coalesce("table_type", F.lit("simple_table"))).alias("table_type"),
        first["page"].alias("page_number"),
        F.greatest(first["page"], last["page"]).alias("page_end"),
        F.element_at("breadcrumbs", -1).alias("section_title"),
        F.concat(
            F.col("breadcrumbs"),
            F.when(table | F.col("mark").isNull(), F.array().cast("array<string>")).otherwise(
                F.array(F.coalesce(display, F.col("mark.heading")))
            ),
        ).alias("breadcrumbs"),
        table.alias("is_table"),
        F.when(~table, display).alias("article"),
        F.when(
            table,
            F.create_map(
                F.lit("type"), F.lit("table"),
                F.lit("is_table"), F.lit("true"),
                F.lit("is_atomic_table"), F.lit("true"),
            ),
        )
        .when(
            number.isNotNull(),
            F.create_map(
                F.lit("type"), F.lit("article"),
                F.lit("article_no"), number,
                F.lit("article_title"), title,
                F.lit("article_display"), display,
            ),
        )
        .when(F.col("mark").isNotNull(), F.create_map(F.lit("heading"), F.col("mark.heading")))
        .otherwise(no_metadata())
        .alias("extra"),
    )
    rows = rows.withColumn("token_estimate", token_estimate("text"))
    ranges = position_ranges("b0", range_rows) if long_docs else ()
    return number_rows(rows, ["doc_id"], ["b0", "u0"], "child_pos", ranges)


CHILD_FIELDS = (
    "child_pos", "chunk_type", "text", "raw_html", "table_caption", "table_footnote", "table_type",
    "token_estimate", "page_number", "page_end", "breadcrumbs", "is_table", "extra",
)


def pack_parents(
    packed: DataFrame, max_tokens: int = P.PARENT_BUDGET, long_docs: bool = False, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """One row per parent chunk with its children as an array."""
    ranges = position_ranges("child_pos", range_rows) if long_docs else ()
    raw_tokens = F.when(non_empty("raw_html").isNotNull(), token_estimate("raw_html")).otherwise(F.col("token_estimate"))
    huge = F.col("is_table") & (raw_tokens > max_tokens)
    c = packed.withColumn("huge", huge)
    c = running(
        c,
        ["doc_id"],
        ["child_pos"],
        {"huge_no": ("sum", F.when(F.col("huge"), F.lit(1).cast("bigint")))},
        ranges,
    )
    c = running(
        c,
        ["doc_id"],
        ["child_pos"],
        {"before": latest(["child_pos"], F.when(F.col("article").isNotNull(), F.struct("section_no", "article")))},
        ranges,
        inclusive=False,
    )
    before = latest_value("before")
    same = before["section_no"].eqNullSafe(F.col("section_no")) & before["article"].eqNullSafe(F.col("article"))
    c = c.withColumns(
        {
            "ch": ~same,
            "run": F.col("huge_no") * 2 + F.when(F.col("huge"), 0).otherwise(1),
            "seg": position_ranges("child_pos", range_rows)[0][0] if long_docs else F.lit(0).cast("bigint"),
        }
    )
    item = F.struct(
        "child_pos",
        F.col("token_estimate").alias("w"),
        F.col("article").isNotNull().alias("a"),
        "ch",
        "article",
        # Maps cannot be ordered, entries can.
        F.struct(*CHILD_FIELDS[1:-1], F.map_entries("extra").alias("extra")).alias("child"),
    )
    groups = c.groupBy("doc_id", "seg", "section_no", "run").agg(
        F.array_sort(F.collect_list(item)).alias("items"),
        F.first("doc_title").alias("doc_title"),
        F.first("section_title").alias("section_title"),
        F.first("huge").alias("huge"),
    )
    if long_docs:
        groups = cut_lineage(groups)
    packs = pack(groups, ["doc_id", "section_no", "run"], "seg", max_tokens, articles=True, spans=long_docs)

    mark = P.TABLE_MARK

    def body(x: Column) -> Column:
        ch = x["child"]
        caption = non_empty(ch["table_caption"])
        head = F.coalesce(F.concat(F.lit(f"[{mark}: "), caption, F.lit("]\n")), F.lit(f"[{mark}]\n"))
        table = strip(F.concat(head, F.coalesce(non_empty(ch["raw_html"]), ch["text"])))
        return F.when(ch["is_table"], table).otherwise(ch["text"])

    first = F.col("items")[0]["child"]
    crumbs = F.array_join(first["breadcrumbs"], " > ")
    joined = strip(F.array_join(F.transform("items", body), "\n\n"))
    text = context_text(F.concat(F.lit("["), crumbs, F.lit("]\n\n"), joined))
    article = F.get(F.filter("items", lambda x: x["article"].isNotNull()), F.lit(0))["article"]
    title = F.when(
        F.col("huge"),
        F.coalesce(non_empty(first["table_caption"]), F.concat(F.col("section_title"), F.lit(P.BIG_TABLE_SUFFIX))),
    ).otherwise(
        F.coalesce(
            F.concat(article, F.when(F.col("continued"), P.CONTINUED_SUFFIX).otherwise("")), F.col("section_title")
        )
    )
    rows = packs.select(
        "doc_id",
        "doc_title",
        "section_no",
        F.col("items")[0]["child_pos"].alias("first_pos"),
        title.alias("title"),
        text.alias("text"),
        F.array_min(F.transform("items", lambda x: x["child"]["page_number"])).alias("page_start"),
        F.array_max(F.transform("items", lambda x: x["child"]["page_end"])).alias("page_end"),
        F.col("items"),
    )
    rows = rows.withColumn("token_estimate", token_estimate("text"))
    ranges = position_ranges("first_pos", range_rows) if long_docs else ()
    return number_rows(rows, ["doc_id"], ["first_pos"], "parent_pos", ranges)


def by_length(blocks: DataFrame, range_rows: int = RANGE_ROWS, lengths: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Blocks of documents that fit one range, and blocks of longer ones (None if there are none)."""
    numbers = blocks if lengths is None else lengths
    long = cut_lineage(numbers.where(F.col("block_no") >= range_rows).select("doc_id").distinct())
    if long.isEmpty():
        return blocks, None
    return blocks.join(long, "doc_id", "left_anti"), blocks.join(long, "doc_id", "left_semi")


def chunk_blocks(
    blocks: DataFrame,
    child_tokens: int = P.CHILD_BUDGET,
    parent_tokens: int = P.PARENT_BUDGET,
    long_docs: bool | None = None,
    range_rows: int = RANGE_ROWS,
    lengths: DataFrame | None = None,
) -> Chunked:
    """Sections, parents and children of a corpus of blocks.

    ``long_docs`` says whether all documents go through the range path, which a document of over ``range_rows``
    blocks needs; by default exactly those documents do. ``lengths`` (doc_id, block_no: its highest, or more) finds them
    where that is cheaper than making the blocks.
    """
    if long_docs is None:
        short, long = by_length(blocks, range_rows, lengths)
        done = chunk_blocks(short, child_tokens, parent_tokens, False, range_rows)
        if long is None:
            return done
        more = chunk_blocks(long, child_tokens, parent_tokens, True, range_rows)
        return Chunked(
            done.sections.unionByName(more.sections), done.parents.unionByName(more.parents), done.children.unionByName(more.children)
        )
    outlined = outline(blocks, long_docs, range_rows)
    if long_docs:
        outlined = cut_lineage(outlined)
    packed = pack_parents(
        pack_children(outlined, child_tokens, long_docs, range_rows), parent_tokens, long_docs, range_rows
    )
    if long_docs:
        packed = cut_lineage(packed)
    return Chunked(_sections(blocks, outlined, packed), _parents(packed), _children(packed).drop("parent_text"))


def children_in_context(
    blocks: DataFrame,
    child_tokens: int = P.CHILD_BUDGET,
    parent_tokens: int = P.PARENT_BUDGET,
    long_docs: bool | None = None,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """The children of ``chunk_blocks`` with their ``parent_text``, which needs no join while both lie in one row."""
    if long_docs is None:
        short, long = by_length(blocks, range_rows)
        done = children_in_context(short, child_tokens, parent_tokens, False, range_rows)
        return done if long is None else done.unionByName(children_in_context(long, child_tokens, parent_tokens, True, range_rows))
    outlined = outline(blocks, long_docs, range_rows)
    if long_docs:
        outlined = cut_lineage(outlined)
    return _children(
        pack_parents(pack_children(outlined, child_tokens, long_docs, range_rows), parent_tokens, long_docs, range_rows)
    )


def chunk_stats(
    blocks: DataFrame,
    child_tokens: int = P.CHILD_BUDGET,
    parent_tokens: int = P.PARENT_BUDGET,
    long_docs: bool | None = None,
    range_rows: int = RANGE_ROWS,
    documents: DataFrame | None = None,
) -> DataFrame:
    """Counts and token sum per document straight from its blocks, without building the chunk tables.

    The figures equal ``stats.document_stats`` of the chunked blocks. With ``documents`` (doc_id) each of its rows has a
    row, also one without blocks, which has its root section and no chunks.
    """
    if documents is not None:
        found = chunk_stats(blocks, child_tokens, parent_tokens, long_docs, range_rows)
        one = F.coalesce("total_sections", F.lit(1).cast("bigint"))
        return documents.select("doc_id").join(found, "doc_id", "left").withColumn("total_sections", one).na.fill(0)
    if long_docs is None:
        short, long = by_length(blocks, range_rows)
        done = chunk_stats(short, child_tokens, parent_tokens, False, range_rows)
        return done if long is None else done.unionByName(chunk_stats(long, child_tokens, parent_tokens, True, range_rows))
    outlined = outline(blocks, long_docs, range_rows)
    if long_docs:
        outlined = cut_lineage(outlined)
    children = pack_children(outlined, child_tokens, long_docs, range_rows)
    table = F.filter("items", lambda x: x["child"]["is_table"])
    packed = pack_parents(children, parent_tokens, long_docs, range_rows).groupBy("doc_id").agg(
        F.count("*").alias("total_parent_chunks"),
        F.sum(F.size("items")).alias("total_child_chunks"),
        F.sum(F.size("items") - F.size(table)).alias("paragraph_chunks"),
        F.sum(F.size(table)).alias("table_chunks"),
        F.sum(F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + x["w"])).alias("total_tokens"),
    )
    # Every document has a root; headings add sections.
    headings = classify(blocks).where(F.col("kind") == "section").select("doc_id")
    roots = blocks.select("doc_id").distinct()
    sections = roots.unionByName(headings).groupBy("doc_id").agg(F.count("*").alias("total_sections"))
    return sections.join(packed, "doc_id", "left").na.fill(0)


def _sections(blocks: DataFrame, outlined: DataFrame, packed: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    roots = blocks.groupBy("doc_id").agg(F.first("doc_title").alias("title")).select(
        "doc_id",
        zero.alias("section_pos"),
        "title",
        F.lit(0).alias("level"),
        F.lit(None).cast("bigint").alias("parent_no"),
        F.array("title").alias("breadcrumbs"),
        F.lit(1).alias("page"),
    )
    headings = outlined.where(F.col("kind") == "section").select(
        "doc_id",
        F.col("section_no").alias("section_pos"),
        F.col("heading").alias("title"),
        F.col("depth").alias("level"),
        "parent_no",
        "breadcrumbs",
        F.col("page_number").alias("page"),
    )
    pages = packed.groupBy("doc_id", F.col("section_no").alias("section_pos")).agg(
        F.min("page_start").alias("lo"), F.max("page_end").alias("hi")
    )
    return (
        roots.unionByName(headings)
        .join(pages, ["doc_id", "section_pos"], "left")
        .select(
            "doc_id",
            ids.section_id("doc_id", F.col("section_pos")).alias("section_id"),
            "section_pos",
            "title",
            "level",
            F.when(F.col("parent_no").isNotNull(), ids.section_id("doc_id", F.col("parent_no"))).alias("parent_section_id"),
            "breadcrumbs",
            F.coalesce("lo", "page").alias("page_start"),
            F.coalesce("hi", "page").alias("page_end"),
        )
    )


def _parents(packed: DataFrame) -> DataFrame:
    return packed.select(
        "doc_id",
        ids.parent_id("doc_id", F.col("parent_pos")).alias("parent_chunk_id"),
        "parent_pos",
        ids.section_id("doc_id", F.col("section_no")).alias("section_id"),
        "title",
        "text",
        "token_estimate",
        "page_start",
        "page_end",
        F.col("items")[0]["child"]["breadcrumbs"].alias("breadcrumbs"),
        F.lit(False).alias("is_edited"),
    )


def _children(packed: DataFrame) -> DataFrame:
    rows = packed.select(
        "doc_id", "doc_title", "section_no", "parent_pos", F.col("text").alias("parent_text"), F.explode("items").alias("item")
    ).select(
        "doc_id", "doc_title", "section_no", "parent_pos", "parent_text", F.col("item.child_pos").alias("child_pos"), "item.child.*"
    )
    meta = overlay(F.map_from_entries("extra"), F.create_map(F.lit("doc_title"), F.col("doc_title")))
    return rows.select(
        "doc_id",
        ids.chunk_id("doc_id", F.col("child_pos")).alias("chunk_id"),
        "child_pos",
        ids.parent_id("doc_id", F.col("parent_pos")).alias("parent_chunk_id"),
        ids.section_id("doc_id", F.col("section_no")).alias("section_id"),
        "chunk_type",
        "text",
        "raw_html",
        "table_caption",
        "table_footnote",
        "table_type",
        "token_estimate",
        "page_number",
        "page_end",
        "breadcrumbs",
        "is_table",
        F.col("is_table").alias("is_atomic_table"),
        F.lit(False).alias("is_edited"),
        F.lit(False).alias("is_ignored"),
        sync_pages(meta, "page_number", "page_end").alias("metadata"),
        "parent_text",
    )


def section_text(parents: DataFrame, part_rows: int = 1024) -> DataFrame:
    """Full text of sections: their parent texts joined by blank lines, in order.

    A section of more than ``part_rows`` parents comes in several parts, so that no row and no task has
    to hold it whole; the parts joined by a blank line are the full text.
    """
    numbered = number_rows(
        parents.select("doc_id", "section_id", "parent_pos", "text"),
        ["doc_id", "section_id"],
        ["parent_pos"],
        "n",
        position_ranges("parent_pos"),
    )
    part = F.floor((F.col("n") - 1) / part_rows)
    return (
        numbered.groupBy("doc_id", "section_id", part.alias("part_no"))
        .agg(F.array_sort(F.collect_list(F.struct("parent_pos", "text"))).alias("p"))
        .select(
            "doc_id", "section_id", "part_no", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("full_text")
        )
    )
