"""The index table: payload, vectors, upserts and deletes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import backfilled_doc_id, point_id
from ..functions.meta import page_start, without_image_keys
from ..functions.text import non_empty
from ..session import cut_lineage
from .encode import Encoder, dense_vectors, document_vector, words
from .filters import active
from .stats import manifest

INDEX = (
    "point_id string, collection string, chunk_id string, doc_id string, doc_title string, parent_chunk_id string, "
    "parent_text string, section_id string, chunk_type string, title string, page_number int, page_end int, "
    "page_idx int, breadcrumbs array<string>, text string, token_count int, char_length int, raw_html string, "
    "table_caption string, table_footnote string, table_type string, is_table boolean, is_atomic_table boolean, "
    "metadata map<string,string>, sparse struct<indices:array<bigint>,values:array<double>>, dense array<float>, "
    "indexed_at timestamp"
)
BROADCAST_NAMES = 100_000


def attach_parent_text(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children with ``parent_text``; text the child already carries wins, a missing parent gives none."""
    p = parents.select("doc_id", "parent_chunk_id", F.col("text").alias("__pt"))
    own = non_empty("parent_text") if "parent_text" in children.columns else F.lit(None).cast("string")
    joined = children.join(p, ["doc_id", "parent_chunk_id"], "left")
    return joined.withColumn("parent_text", F.coalesce(own, "__pt", F.lit(""))).drop("__pt")


def payload(children: DataFrame, collection: str) -> DataFrame:
    """Index columns of active children that carry ``parent_text``."""
    caption = F.coalesce(non_empty("table_caption"), F.lit(""))
    start = page_start("page_number")
    text = F.coalesce("text", F.lit(""))
    return active(children).select(
        point_id("chunk_id").alias("point_id"),
        F.lit(collection).alias("collection"),
        "chunk_id",
        backfilled_doc_id("doc_id", "breadcrumbs", "chunk_id").alias("doc_id"),
        F.coalesce(F.element_at("metadata", "doc_title"), F.get("breadcrumbs", F.lit(0)), F.lit("")).alias("doc_title"),
        F.coalesce("parent_chunk_id", F.lit("")).alias("parent_chunk_id"),
        "parent_text",
        F.coalesce("section_id", F.lit("")).alias("section_id"),
        F.coalesce("chunk_type", F.lit("text")).alias("chunk_type"),
        caption.alias("title"),
        start.alias("page_number"),
        F.coalesce(F.nullif("page_end", F.lit(0)), start).alias("page_end"),
        (start - 1).alias("page_idx"),
        F.coalesce("breadcrumbs", F.array().cast("array<string>")).alias("breadcrumbs"),
        text.alias("text"),
        F.coalesce("token_estimate", F.lit(0)).alias("token_count"),
        F.length(text).alias("char_length"),
        "raw_html",
        "table_caption",
        "table_footnote",
        "table_type",
        (F.coalesce("is_table", F.lit(False)) | (F.coalesce("chunk_type", F.lit("")) == "table")).alias("is_table"),
        F.coalesce("is_atomic_table", F.lit(False)).alias("is_atomic_table"),
        without_image_keys("metadata").alias("metadata"),
    )


def index_points(
    children: DataFrame,
    parents: DataFrame | None,
    collection: str,
    encode: Encoder | None = None,
    tokens: Column | None = None,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Points of all active children: payload, sparse and dense vectors.

    Dense vectors come from the encoder, or from ``vectors`` (chunk_id, dense) computed elsewhere. Without ``parents``
    all children carry their ``parent_text``.
    """
    rows = active(children) if parents is None else attach_parent_text(active(children), parents)
    rows = payload(rows, collection)
    rows = rows.withColumn("sparse", document_vector(tokens if tokens is not None else words("text")))
    if vectors is not None:
        rows = rows.join(vectors.select("chunk_id", "dense"), "chunk_id", "left")
    elif encode is not None:
        rows = rows.withColumn("dense", dense_vectors(encode, "text"))
    else:
        rows = rows.withColumn("dense", F.lit(None).cast("array<float>"))
    return rows.withColumn("indexed_at", F.current_timestamp())


POINT = ("collection", "point_id")


def last_writes(batch: DataFrame, key: str | Sequence[str], version: Column) -> DataFrame:
    """One row per key: the one with the highest version. Copies of a hot key are reduced before the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in batch.columns if c not in keys]
    # Equal versions are decided by content, so that a retried task gives the same row.
    content = F.xxhash64(*[c for c, t in batch.dtypes if c not in keys and "map<" not in t])
    best = F.max_by(F.struct(*rest), F.struct(version.alias("v"), content.alias("h")))
    return batch.groupBy(*keys).agg(best.alias("__b")).select(*keys, "__b.*").select(*batch.columns)


def upsert(index: DataFrame, batch: DataFrame, key: str | Sequence[str] = POINT, version: Column | None = None) -> DataFrame:
    """The index after a batch of points: points of the batch replace those of the same collection and id.

    Tables without a ``collection`` column are one collection.
    """
    keys = [key] if isinstance(key, str) else [c for c in key if c in batch.columns]
    new = last_writes(batch, keys, version if version is not None else F.col("indexed_at"))
    return index.join(new.select(*keys), keys, "left_anti").unionByName(new)


def _small(names: DataFrame) -> DataFrame:
    bounded = names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES
    return F.broadcast(names) if bounded else names


def delete_documents(index: DataFrame, names: DataFrame, collection: str | None = None) -> DataFrame:
    """The index without points whose document id, title or any breadcrumb is one of the names (``name``).

    With ``collection`` only points of that collection go. Points are told apart by collection and id, so a point of the
    same id in another collection stays unless a name hits it too.
    """
    if collection is not None:
        inside = F.coalesce(F.col("collection") == collection, F.lit(False))
        return index.where(~inside).unionByName(delete_documents(index.where(inside), names))
    n = _small(names.select("name").distinct())
    known = F.array_distinct(F.concat(F.array("doc_id", "doc_title"), F.coalesce("breadcrumbs", F.array().cast("array<string>"))))
    keys = [c for c in POINT if c in index.columns]
    gone = index.select(*[F.col(c).alias(f"gone_{c}") for c in keys], F.explode(known).alias("name")).join(n, "name", "left_semi")
    doomed = gone.drop("name").distinct()
    same = [F.col(c).eqNullSafe(F.col(f"gone_{c}")) for c in keys]
    return index.join(doomed, reduce(Column.__and__, same), "left_anti")


def without_documents(table: DataFrame, docs: DataFrame) -> DataFrame:
    """Any table with ``doc_id`` without the listed documents."""
    return table.join(_small(docs.select("doc_id").distinct()), "doc_id", "left_anti")


def create_collection(spark: SparkSession, path: str, collection: str, recreate: bool = False) -> bool:
    """Create a collection of the index at ``path``, or recreate it; returns whether it was created.

    An index is one folder per collection; ``read_index`` reads all. Other collections are not touched.
    """
    try:
        exists = not read_index(spark, path).where(F.col("collection") == collection).isEmpty() or _has_files(spark, path, collection)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        exists = False
    if exists and not recreate:
        return False
    # A file without rows keeps the schema readable.
    empty = spark.createDataFrame([], INDEX).drop("collection")
    empty.coalesce(1).write.mode("overwrite").parquet(f"{path}/collection={collection}")
    return True


def _has_files(spark: SparkSession, path: str, collection: str) -> bool:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/collection={collection}")
    return not files.select("path").isEmpty()


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """All points below ``path``, with the collection read from the folder names."""
    names = [f.name for f in spark.createDataFrame([], INDEX).schema]
    return spark.read.schema(INDEX).parquet(path).select(*names)


def wrong_dimension(index: DataFrame, dimension: int) -> DataFrame:
    return index.where(F.size("dense") != dimension)


@dataclass(frozen=True)
class IndexJob:
    """What an index job leaves: the index after it, the points it wrote, the manifest and the report."""

    index: DataFrame
    points: DataFrame
    manifest: DataFrame
    report: DataFrame


def index_job(
    index: DataFrame,
    children: DataFrame,
    parents: DataFrame,
    collection: str,
    encode: Encoder | None = None,
    tokens: Column | None = None,
    vectors: DataFrame | None = None,
) -> IndexJob:
    """Encode the active children once, upsert them into their collection, and report from the stored points."""
    points = cut_lineage(index_points(children, parents, collection, encode, tokens, vectors))
    after = upsert(index, points)
    mine = after.where(F.col("collection") == collection)
    return IndexJob(after, points, manifest(mine), index_report(children, points))


def index_report(children: DataFrame, points: DataFrame) -> DataFrame:
    """One row: chunks seen, points written and whether the job had anything to index."""
    total = children.agg(F.count("*")).scalar()
    done = points.agg(F.count("*").alias("upserted_count"), F.max(F.size("dense")).alias("dense_dim"))
    return done.withColumn("total_chunks", total).withColumns(
        {
            "success": F.col("upserted_count") > 0,
            "error": F.when(F.col("total_chunks") == 0, "no chunks to index").when(
                F.col("upserted_count") == 0, "all chunks are ignored"
            ),
        }
    )


__all__ = ["index_points", "upsert", "manifest"]
