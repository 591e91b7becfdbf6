"""Export records and edited overlays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.meta import page_end, page_list, page_start, sync_pages, without_image_keys, overlay
from ..functions.text import breadcrumb_string, non_empty, parent_context, token_estimate
from ..schemas import CHILDREN, PARENTS, SECTIONS
from ..sources.versioned import VersionedTables
from .chunking import Chunked
from .filters import active
from .index import without_documents
from .stats import is_table_row


def export_records(chunked: Chunked) -> DataFrame:
    """One record per active child with its section and the parent text as context.

    ``page_end`` is set only for children over several pages, ``raw_html`` and ``table_caption`` only for tables.
    """
    parents = chunked.parents.select(
        "doc_id", "parent_chunk_id", F.col("text").alias("p_text"), F.col("token_estimate").alias("p_tokens"),
        F.col("section_id").alias("p_section"),
    )
    sections = chunked.sections.select(
        "doc_id", "section_id", F.col("title").alias("s_title"), F.col("breadcrumbs").alias("s_crumbs")
    )
    titles = chunked.sections.where(F.col("section_pos") == 0).select("doc_id", F.col("title").alias("d_title"))
    c = active(chunked.children).join(parents, ["doc_id", "parent_chunk_id"], "left")
    c = c.withColumn("section_id", F.coalesce(non_empty("section_id"), "p_section", F.lit("")))
    c = c.join(sections, ["doc_id", "section_id"], "left").join(titles, "doc_id", "left")
    crumbs = F.when(F.size(F.coalesce("breadcrumbs", F.array().cast("array<string>"))) > 0, F.col("breadcrumbs")).otherwise(
        F.coalesce("s_crumbs", F.array().cast("array<string>"))
    )
    c = c.withColumns(
        {"breadcrumbs": crumbs, "is_table": is_table_row(), "s_title": F.coalesce("s_title", F.lit("")), "p_text": F.coalesce("p_text", F.lit(""))}
    )
    start, end = page_start("page_number"), page_end("page_number", "page_end")
    extra = F.create_map(
        F.lit("doc_title"), F.coalesce("d_title", F.lit("")),
        F.lit("section"), F.col("s_title"),
        F.lit("is_atomic_table"), F.col("is_table").cast("string"),
    )
    return c.select(
        "doc_id",
        F.col("chunk_id").alias("id"),
        "parent_chunk_id",
        "section_id",
        F.col("s_title").alias("section_title"),
        "breadcrumbs",
        breadcrumb_string("breadcrumbs").alias("breadcrumbs_str"),
        "text",
        parent_context("breadcrumbs", "p_text").alias("parent_context_text"),
        F.coalesce("chunk_type", F.lit("paragraph")).alias("chunk_type"),
        F.col("is_table").alias("is_atomic_table"),
        start.alias("page"),
        page_list("page_number", "page_end").alias("pages"),
        F.coalesce("token_estimate", token_estimate("text")).alias("token_estimate"),
        F.coalesce("p_tokens", token_estimate("p_text")).alias("parent_token_estimate"),
        sync_pages(overlay(without_image_keys("metadata"), extra), "page_number", "page_end").alias("metadata"),
        F.when(end > start, end).alias("page_end"),
        F.when(F.col("is_table"), F.coalesce("raw_html", F.lit(""))).alias("raw_html"),
        F.when(F.col("is_table"), F.coalesce("table_caption", F.lit(""))).alias("table_caption"),
        "child_pos",
    )


def write_jsonl(records: DataFrame, path: str) -> None:
    """JSON lines, documents together and children in order; null fields are left out.

    Rows are range-partitioned by document and position, so a large document fills many files.
    """
    ordered = records.repartitionByRange("doc_id", "child_pos").sortWithinPartitions("doc_id", "child_pos")
    ordered.drop("doc_id", "child_pos").write.mode("overwrite").json(path)


def export_documents(chunked: Chunked, docs: DataFrame) -> DataFrame:
    """Records of the listed documents (``doc_id``); unknown documents are skipped.

    An empty list and a list without any known document are errors.
    """
    if docs.isEmpty():
        raise ValueError("no documents to export")
    picked = docs.select("doc_id").distinct()
    tables = (t.join(picked, "doc_id", "left_semi") for t in (chunked.sections, chunked.parents, chunked.children))
    part = Chunked(*tables)
    if part.sections.isEmpty():
        raise ValueError("none of the documents has chunks")
    return export_records(part)


def with_overlay(computed: Chunked, edited: Chunked) -> Chunked:
    """Edited documents replace their computed versions."""
    docs = edited.sections.select("doc_id").distinct()
    return Chunked(
        *(
            without_documents(getattr(computed, n), docs).unionByName(getattr(edited, n))
            for n in ("sections", "parents", "children")
        )
    )


def repair_titles(chunked: Chunked, titles: DataFrame) -> Chunked:
    """Replace the titles of documents (doc_id, doc_title) in root sections, breadcrumbs and metadata."""
    t = titles.select("doc_id", F.col("doc_title").alias("__t"))

    def crumbs(df: DataFrame) -> DataFrame:
        # The first breadcrumb is the document.
        fixed = F.concat(F.array("__t"), F.slice("breadcrumbs", 2, F.greatest(F.size("breadcrumbs") - 1, F.lit(0))))
        return df.withColumn(
            "breadcrumbs", F.when(F.col("__t").isNotNull() & (F.size("breadcrumbs") > 0), fixed).otherwise(F.col("breadcrumbs"))
        )

    s = crumbs(chunked.sections.join(t, "doc_id", "left"))
    s = s.withColumn("title", F.when(F.col("section_pos") == 0, F.coalesce("__t", "title")).otherwise(F.col("title")))
    p = crumbs(chunked.parents.join(t, "doc_id", "left"))
    c = crumbs(chunked.children.join(t, "doc_id", "left"))
    named = overlay("metadata", F.create_map(F.lit("doc_title"), F.col("__t")))
    c = c.withColumn("metadata", F.when(F.col("__t").isNotNull(), named).otherwise(F.col("metadata")))
    return Chunked(
        s.select(*chunked.sections.columns), p.select(*chunked.parents.columns), c.select(*chunked.children.columns)
    )


def edited_store(spark: SparkSession, path: str) -> VersionedTables:
    """The store of saved edits: versions of whole documents, the last save counts."""
    return VersionedTables(
        spark, path, {"sections": SECTIONS, "parents": PARENTS, "children": CHILDREN},
        {"sections": "section_pos", "parents": "parent_pos", "children": "child_pos"},
    )


def save_edited(edited: Chunked, path: str, docs: DataFrame | None = None) -> int:
    """Save edited documents as one commit, which replaces what was saved of them in all three tables.

    A document is saved if a table has rows of it or ``docs`` (doc_id) lists it; tables without rows of it are empty
    for it afterwards. Returns the number of the commit.
    """
    tables = {n: getattr(edited, n) for n in ("sections", "parents", "children")}
    owners = reduce(DataFrame.union, [t.select("doc_id") for t in tables.values()] + ([docs.select("doc_id")] if docs is not None else []))
    return edited_store(edited.sections.sparkSession, path).commit(tables, owners.distinct())


def load_edited(spark: SparkSession, path: str) -> Chunked:
    """The saved edits; documents that were reset are not among them."""
    store = edited_store(spark, path)
    return Chunked(*(store.read(n) for n in ("sections", "parents", "children")))


def reset_saved(spark: SparkSession, path: str, docs: DataFrame) -> int:
    """Drop the saved edits of the listed documents (``doc_id``); they fall back to their computed versions."""
    return edited_store(spark, path).delete(docs.select(F.col("doc_id").alias("name")))


def saved_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id) of the documents that have a saved edit, also one without any chunk left."""
    return edited_store(spark, path).kept_owners().select("doc_id")


def with_saved(computed: Chunked, path: str) -> Chunked:
    """Saved edits replace the computed versions of their documents."""
    spark = computed.sections.sparkSession
    docs, edited = saved_documents(spark, path), load_edited(spark, path)
    return Chunked(*(without_documents(getattr(computed, n), docs).unionByName(getattr(edited, n)) for n in ("sections", "parents", "children")))


def reset_edits(edited: Chunked, docs: DataFrame) -> Chunked:
    """The edited tables without the listed documents, which fall back to their computed versions."""
    return Chunked(*(without_documents(getattr(edited, n), docs) for n in ("sections", "parents", "children")))
