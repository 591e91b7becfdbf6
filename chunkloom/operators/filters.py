"""Selections over the chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.meta import custom_metadata, page_start
from ..functions.text import non_empty
from .scan import latest, latest_value, number_rows, position_ranges, running
from .stats import is_empty_chunk, is_table_row, tokens_of
from .tree import ancestors


def active(children: DataFrame) -> DataFrame:
    """Chunks that are not ignored."""
    return children.where(~F.coalesce("is_ignored", F.lit(False)))


def resolve_aliases(rows: DataFrame) -> DataFrame:
    """Imported child rows with the older column names resolved."""
    have = set(rows.columns)

    def either(*names: str) -> Column:
        return F.coalesce(*[non_empty(n) for n in names if n in have], F.lit(""))

    out = rows.withColumns(
        {
            "parent_chunk_id": either("parent_chunk_id", "parent_id"),
            "section_id": either("section_id", "parent_section_id", "parent_id"),
            "text": either("text", "content"),
        }
    )
    return out.drop(*[c for c in ("parent_id", "content") if c in have])


def is_lint() -> Column:
    words, table, empty = tokens_of(), is_table_row(), is_empty_chunk()
    return empty | (~table & ((words > P.CHILD_BUDGET) | ((words > 0) & (words < P.MIN_CHILD_TOKENS))))


STATUS = {
    "edited": lambda: F.coalesce("is_edited", F.lit(False)),
    "ignored": lambda: F.coalesce("is_ignored", F.lit(False)),
    "lint": is_lint,
    "empty": is_empty_chunk,
}


def _has(term: str, *names: str) -> Column:
    found = F.lit(False)
    for n in names:
        found = found | F.contains(F.lower(F.coalesce(n, F.lit(""))), F.lit(term.lower()))
    return found


def filter_chunks(
    children: DataFrame,
    section_id: str | None = None,
    chunk_type: str | None = None,
    status: str | None = None,
    query: str | None = None,
) -> DataFrame:
    """Chunks of a section or parent, of a type, in a state, with a search term in text, id or caption."""
    c = children
    if section_id:
        c = c.where((F.col("section_id") == section_id) | (F.col("parent_chunk_id") == section_id))
    if chunk_type:
        c = c.where(F.col("chunk_type") == chunk_type)
    if status:
        c = c.where(STATUS[status]())
    if query and query.strip():
        c = c.where(_has(query, "text", "chunk_id", "table_caption"))
    return c


def filter_documents(docs: DataFrame, query: str | None = None, status: str | None = None) -> DataFrame:
    d = docs
    if query and query.strip():
        d = d.where(_has(query.strip(), "name"))
    return d.where(F.col("status") == status) if status else d


def search_sections(
    sections: DataFrame, parents: DataFrame, children: DataFrame, term: str, with_ancestors: bool = True
) -> DataFrame:
    """Sections whose title, parents or children contain the term, with the sections above them."""
    key = ["doc_id", "section_id"]
    hits = sections.where(_has(term, "title")).select(*key)
    if with_ancestors:
        hits = (
            hits.unionByName(parents.where(_has(term, "title", "parent_chunk_id", "text")).select(*key))
            .unionByName(children.where(_has(term, "chunk_id", "text", "table_caption")).select(*key))
            .distinct()
        )
        closed = ancestors(sections)
        up = F.concat(
            F.array("section_id"),
            F.transform("path", lambda x: x["id"]),
            F.when(F.col("reached"), F.array("root_id")).otherwise(F.array().cast("array<string>")),
        )
        hits = closed.join(hits, key, "left_semi").select("doc_id", F.explode(up).alias("section_id")).distinct()
    return sections.join(hits, key, "left_semi")


def top_sections(sections: DataFrame) -> DataFrame:
    """Sections of level 0, without a parent, or whose parent does not exist."""
    known = sections.select("doc_id", F.col("section_id").alias("parent_section_id"), F.lit(True).alias("__known"))
    joined = sections.join(known, ["doc_id", "parent_section_id"], "left")
    return joined.where((F.col("level") == 0) | F.col("__known").isNull()).select(*sections.columns)


def parent_groups(children: DataFrame, parents: DataFrame) -> DataFrame:
    """One row per parent that has children, and one per missing parent the children still name."""
    c = children.withColumn("parent_chunk_id", F.coalesce(non_empty("parent_chunk_id"), F.lit("unassigned")))
    key = ["doc_id", "parent_chunk_id"]
    sums = c.groupBy(*key).agg(
        F.count("*").alias("children"),
        F.sum(F.coalesce("token_estimate", F.lit(0))).alias("tokens"),
        F.min(page_start("page_number")).alias("page_start"),
        F.max(F.coalesce("page_end", "page_number", F.lit(1))).alias("page_end"),
        F.min(F.struct("child_pos", "section_id"))["section_id"].alias("section_id"),
    )
    named = sums.join(parents.select(*key, F.col("title"), F.col("section_id").alias("own")), key, "left")
    return named.select(
        *key,
        F.coalesce("own", "section_id").alias("section_id"),
        F.when(F.col("own").isNotNull(), F.col("title")).otherwise(P.FALLBACK_GROUP_TITLE).alias("title"),
        "children",
        "tokens",
        "page_start",
        "page_end",
        F.col("own").isNull().alias("is_fallback"),
    )


def drop_dangling(references: DataFrame, rows: DataFrame, id_column: str) -> DataFrame:
    """References (doc_id, id) that have a target."""
    return references.join(rows.select("doc_id", id_column), ["doc_id", id_column], "left_semi")


def first_children(children: DataFrame, parents: DataFrame, limit: int = 50) -> DataFrame:
    """The first ``limit`` children of each document in the order of the parents; the last group is cut.

    Children whose parent is missing come after all others, in the order of their first child.
    """
    pos = parents.select("doc_id", "parent_chunk_id", "parent_pos")
    joined = children.join(pos, ["doc_id", "parent_chunk_id"], "left")
    stale = joined.where(F.col("parent_pos").isNull()).groupBy("doc_id", "parent_chunk_id").agg(F.min("child_pos").alias("__first"))
    ordered = joined.join(stale, ["doc_id", "parent_chunk_id"], "left")
    w = Window.partitionBy("doc_id").orderBy(F.col("parent_pos").asc_nulls_last(), F.col("__first"), "child_pos")
    ranked = ordered.withColumn("n", F.row_number().over(w)).drop("__first")
    return ranked.where(F.col("n") <= limit)


def fallback_members(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Members of the groups ``parent_groups`` marks as fallback: one row per child with its number in the group.

    Joined in this order by blank lines their texts are the text of the group; rows keep a group of any size apart.
    """
    c = children.withColumn("parent_chunk_id", F.coalesce(non_empty("parent_chunk_id"), F.lit("unassigned")))
    lost = c.join(parents.select("doc_id", "parent_chunk_id"), ["doc_id", "parent_chunk_id"], "left_anti")
    numbered = number_rows(lost, ["doc_id", "parent_chunk_id"], ["child_pos"], "ordinal", position_ranges("child_pos"))
    return numbered.select("doc_id", "parent_chunk_id", "ordinal", "chunk_id", F.coalesce("text", F.lit("")).alias("text"))


def metadata_sources(children: DataFrame) -> DataFrame:
    """For each chunk the chunks whose custom metadata it could take over: previous, first of its section
    other than itself, first of its document."""
    c = children.select(
        "doc_id", "section_id", "chunk_id", "child_pos",
        F.when(F.size(custom_metadata("metadata")) > 0, F.col("chunk_id")).alias("usable"),
    )
    here = F.struct("chunk_id", "usable")
    c = running(
        c, ["doc_id"], ["child_pos"], {"__prev": latest(["child_pos"], here)}, position_ranges("child_pos"), inclusive=False
    )
    # The two first chunks of a section: a chunk takes the first that is not itself.
    at = F.struct("child_pos", "chunk_id", "usable")
    doc_first = c.groupBy("doc_id").agg(F.min(at).alias("__doc"))
    sec_first = c.groupBy("doc_id", "section_id").agg(F.min(at).alias("__s1"))
    rest = c.join(sec_first, ["doc_id", "section_id"]).where(F.col("child_pos") > F.col("__s1.child_pos"))
    sec_second = rest.groupBy("doc_id", "section_id").agg(F.min(at).alias("__s2"))
    c = c.join(doc_first, "doc_id").join(sec_first, ["doc_id", "section_id"]).join(sec_second, ["doc_id", "section_id"], "left")
    previous = latest_value("__prev")["usable"]
    in_section = F.when(F.col("__s1.chunk_id") != F.col("chunk_id"), F.col("__s1.usable")).otherwise(F.col("__s2.usable"))
    in_doc = F.when(F.col("__doc.chunk_id") != F.col("chunk_id"), F.col("__doc.usable"))
    return c.select("doc_id", "chunk_id", previous.alias("previous"), in_section.alias("in_section"), in_doc.alias("in_document"))
