"""Chunk tables over the sample tables, for the registered queries.

Each non-blank line of a document is a child; 8 lines make a parent, 4 parents a section. Section k lies
under section k div 2, so the tree has the depth of a binary heap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import strip, token_estimate
from ..operators.chunking import Chunked
from ..session import spread


TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df


def line_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"),
        "source",
        "lang",
        F.posexplode(F.split("text", "\n")).alias("n", "text"),
    ).where(F.length(strip("text")) > 0)
    n = F.col("n").cast("bigint")
    section = F.floor(n / 32) + 1
    # Lines of a few words stand in for captions of tables.
    short = F.length("text") < 60
    page = F.floor(n / 5).cast("int") + 1
    return lines.select(
        "doc_id",
        ids.chunk_id("doc_id", n + 1).alias("chunk_id"),
        (n + 1).alias("child_pos"),
        ids.parent_id("doc_id", F.floor(n / 8) + 1).alias("parent_chunk_id"),
        ids.section_id("doc_id", section).alias("section_id"),
        F.when(short, "table").otherwise("paragraph").alias("chunk_type"),
        "text",
        F.lit(None).cast("string").alias("raw_html"),
        F.when(short, F.concat(F.lit("caption of "), "text")).alias("table_caption"),
        F.lit(None).cast("string").alias("table_footnote"),
        F.when(short, "simple_table").alias("table_type"),
        token_estimate("text").alias("token_estimate"),
        page.alias("page_number"),
        (page + (n % 2).cast("int")).alias("page_end"),
        F.array("doc_id", F.concat(F.lit("Section "), section.cast("string"))).alias("breadcrumbs"),
        short.alias("is_table"),
        short.alias("is_atomic_table"),
        F.contains("text", F.lit("que")).alias("is_edited"),
        (F.length("text") < 30).alias("is_ignored"),
        F.create_map(
            F.lit("source"), F.col("source"), F.lit("page"), page.cast("string"), F.concat(F.lit("lang_"), "lang"), F.lit("yes")
        ).alias("metadata"),
    )


def line_parents(children: DataFrame) -> DataFrame:
    rows = children.groupBy("doc_id", "parent_chunk_id", "section_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("child_pos", "text"))), lambda x: x["text"]), "\n\n").alias("text"),
        F.min("child_pos").alias("first"),
        F.min("page_number").alias("page_start"),
        F.max("page_end").alias("page_end"),
    )
    number = F.regexp_extract("parent_chunk_id", r"_p(\d+)$", 1).cast("bigint")
    return rows.select(
        "doc_id",
        "parent_chunk_id",
        number.alias("parent_pos"),
        "section_id",
        F.concat(F.lit("Part "), number.cast("string")).alias("title"),
        "text",
        token_estimate("text").alias("token_estimate"),
        "page_start",
        "page_end",
        F.array("doc_id").alias("breadcrumbs"),
        F.lit(False).alias("is_edited"),
    )


def line_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and sections of every document, also those whose lines are all blank."""
    docs = table(spark, sf_dir, "documents")
    d = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    last = F.floor((F.size(F.split("text", "\n")) - 1) / 32) + 1
    rows = docs.select(d.alias("doc_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("k"))
    k = F.col("k")
    root = k == 0
    return rows.select(
        "doc_id",
        ids.section_id("doc_id", k).alias("section_id"),
        k.alias("section_pos"),
        F.when(root, F.col("doc_id")).otherwise(F.concat(F.lit("Section "), k.cast("string"))).alias("title"),
        F.when(root, 0).otherwise(1).alias("level"),
        F.when(~root, ids.section_id("doc_id", F.floor(k / 2))).alias("parent_section_id"),
        F.array("doc_id").alias("breadcrumbs"),
        F.lit(1).alias("page_start"),
        F.lit(1).alias("page_end"),
    )


def line_chunks(spark: SparkSession, sf_dir: str) -> Chunked:
    children = line_children(spark, sf_dir)
    return Chunked(line_sections(spark, sf_dir), line_parents(children), children)


# The same tables as DuckDB SQL.
TOKENS = (
    "coalesce(greatest(floor(length({0}) / 2), floor(CASE WHEN trim({0}) = '' THEN 0 ELSE "
    "len(regexp_extract_all({0}, '\\S+')) END * 2.2::DOUBLE)), 0)::INT"
)
LINES_SQL = f"""
l AS (
  SELECT 'd' || doc_id AS doc_id, source, lang, unnest(string_split(text, chr(10))) AS text,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n
  FROM documents),
children AS (
  SELECT doc_id, printf('%s_c%04d', doc_id, n + 1) AS chunk_id, n + 1 AS child_pos,
         printf('%s_p%04d', doc_id, n // 8 + 1) AS parent_chunk_id,
         printf('%s_s%02d', doc_id, n // 32 + 1) AS section_id, n // 32 + 1 AS section_no,
         CASE WHEN length(text) < 60 THEN 'table' ELSE 'paragraph' END AS chunk_type, text, source, lang,
         CASE WHEN length(text) < 60 THEN 'caption of ' || text END AS table_caption,
         {TOKENS.format('text')} AS token_estimate,
         (n // 5 + 1)::INT AS page_number, (n // 5 + 1 + n % 2)::INT AS page_end,
         'Section ' || (n // 32 + 1) AS section_title,
         length(text) < 60 AS is_table, contains(text, 'que') AS is_edited, length(text) < 30 AS is_ignored
  FROM l WHERE length(trim(text)) > 0),
ptext AS (
  SELECT doc_id, parent_chunk_id, section_id, string_agg(text, chr(10) || chr(10) ORDER BY child_pos) AS text,
         min(page_number) AS page_start, max(page_end) AS page_end
  FROM children GROUP BY ALL),
parents AS (
  SELECT *, regexp_extract(parent_chunk_id, '_p(\\d+)$', 1)::BIGINT AS parent_pos,
         'Part ' || regexp_extract(parent_chunk_id, '_p(\\d+)$', 1)::BIGINT AS title,
         {TOKENS.format('text')} AS token_estimate
  FROM ptext),
sections AS (
  SELECT doc_id, k AS section_pos, printf('%s_s%02d', doc_id, k) AS section_id,
         CASE WHEN k = 0 THEN doc_id ELSE 'Section ' || k END AS title,
         CASE WHEN k = 0 THEN 0 ELSE 1 END AS level,
         CASE WHEN k > 0 THEN printf('%s_s%02d', doc_id, k // 2) END AS parent_section_id
  FROM (SELECT 'd' || doc_id AS doc_id,
               unnest(range(0, (len(string_split(text, chr(10))) - 1) // 32 + 2)) AS k FROM documents)),
paths AS (
  SELECT doc_id, section_id, section_pos, title, parent_section_id, [title] AS crumbs, [section_pos] AS ranks, 0 AS depth
  FROM sections WHERE section_pos = 0
  UNION ALL
  SELECT s.doc_id, s.section_id, s.section_pos, s.title, s.parent_section_id, list_append(p.crumbs, s.title),
         list_append(p.ranks, s.section_pos), p.depth + 1
  FROM sections s JOIN paths p ON s.doc_id = p.doc_id AND s.parent_section_id = p.section_id)
"""


def with_lines(sql: str) -> str:
    return f"WITH RECURSIVE {LINES_SQL} {sql}"
