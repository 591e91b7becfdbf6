"""Chunks, points and the index manifest of documents in one store, and cleaning all of them at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CHILDREN, PARENTS, SECTIONS
from ..sources.artifacts import nfc
from ..sources.versioned import VersionedTables
from .chunking import Chunked
from .index import INDEX
from .stats import manifest

MANIFEST = "doc_id string, collection string, chunks_count bigint, indexed_at timestamp"


def document_store(spark: SparkSession, path: str) -> VersionedTables:
    """Chunk tables, points and manifest by document; points go by their document's id and title and any breadcrumb.

    Points lie in the order of their chunks, so that those of one parent are neighbours and its text, which each of them
    carries, takes space once. Rows are not dealt out by bucket, as a shuffle of points takes more disk than the store.
    """
    return VersionedTables(
        spark,
        path,
        {"sections": SECTIONS, "parents": PARENTS, "children": CHILDREN, "points": INDEX, "manifest": MANIFEST},
        {"sections": "section_pos", "parents": "parent_pos", "children": "child_pos", "points": "chunk_id", "manifest": "collection"},
        names={"points": ("doc_id", "doc_title", "breadcrumbs")},
        deal=False,
    )


def store_documents(store: VersionedTables, chunked: Chunked, points: DataFrame, tag: str = "") -> int:
    """Commit documents with their chunks and points, and the manifest that follows from the points."""
    tables = {"sections": chunked.sections, "parents": chunked.parents, "children": chunked.children, "points": points, "manifest": manifest(points)}
    return store.commit(tables, chunked.sections.select("doc_id").distinct(), tag)


def clean_documents(store: VersionedTables, names: DataFrame, collection: str | None = None) -> int:
    """Delete all that goes by the names (``name``): chunks, points and manifest rows, by one entry in the deletion log.

    Names meet ids in Unicode NFC form. With ``collection`` only points and manifest rows of that collection go. A
    document that is stored again later under a deleted name is there again.
    """
    return store.delete(names.select(nfc("name").alias("name"), F.lit(collection).cast("string").alias("collection")))
