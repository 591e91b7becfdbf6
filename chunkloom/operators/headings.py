"""What each block is: section heading, marker inside a section, table or text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import is_blank, strip

TEXT_TYPES = ("paragraph", "text", "index", "list", "equation", "equation_interline")
FURNITURE = ("page_header", "page_footer", "header", "footer", "page_number")


def article_number(text: Column) -> Column:
    """Article number without spaces; null where the text does not open an article."""
    number = F.regexp_extract(text, P.ARTICLE, 1)
    return F.when(F.length(number) > 0, F.replace(number, F.lit(" ")))


def article_title(text: Column) -> Column:
    return strip(F.coalesce(F.regexp_extract(text, P.ARTICLE, 2), F.lit("")))


def article_display(number: Column, title: Column) -> Column:
    return F.when(F.length(title) > 0, F.concat(number, F.lit("("), title, F.lit(")"))).otherwise(number)


def legal_level(text: Column) -> Column:
    """Section level of a structure mark in a statute, else null."""
    return (
        F.when(text.rlike(P.PART), 1)
        .when(text.rlike(P.CHAPTER) | text.rlike(P.ADDENDUM), 2)
        .when(text.rlike(P.SECTION) | text.rlike(P.APPENDIX), 3)
        .when(text.rlike(P.SUBSECTION), 4)
    )


def general_level(title: Column, declared: Column) -> Column:
    """Heading level by outline number, else as declared.

    0 stands for a number whose level depends on the headings before it: 2 below an open heading of
    level 1, otherwise the declared level but at most 2.
    """
    return (
        F.when(title.rlike(P.ROMAN) | title.rlike(P.PART) | title.rlike(P.CHAPTER), 1)
        .when(title.rlike(P.DECIMAL_SUB), 3)
        .when(title.rlike(P.HANGUL_LETTER) | title.rlike(P.PAREN_NUMBER) | title.rlike(P.ARTICLE), 3)
        .when(title.rlike(P.DECIMAL) | title.rlike(P.SECTION), 0)
        .otherwise(declared)
    )


def drop_furniture(blocks: DataFrame) -> DataFrame:
    """Blocks without page headers, footers and page numbers."""
    return blocks.where(~F.lower(F.coalesce("block_type", F.lit(""))).isin(*FURNITURE))


def classify(blocks: DataFrame) -> DataFrame:
    """Keep the blocks that matter and add ``kind``, heading and article columns.

    ``kind`` is section, marker, table or text. ``heading_level`` 0 is resolved by ``chunking``.
    Titles have the level they declare under the strategy ``declared``. Strategies other than that and ``legal`` are general.
    """
    clean = strip(F.coalesce("text", F.lit("")))
    b = (
        drop_furniture(blocks)
        .withColumn("block_type", F.lower("block_type"))
        .where(F.col("block_type").isin("title", "table", *TEXT_TYPES))
        .withColumn("legal", F.coalesce(F.col("strategy") == "legal", F.lit(False)))
        .withColumn("text", F.when(F.col("block_type") == "table", F.lit("")).otherwise(clean))
        .where((F.col("block_type") == "table") | ~is_blank("text"))
    )
    text, title = F.col("text"), F.col("block_type") == "title"
    table = F.col("block_type") == "table"
    declared = F.greatest(F.coalesce("level", F.lit(1)), F.lit(1))
    general = F.when(title, F.when(F.col("strategy") == "declared", declared).otherwise(general_level(text, declared)))
    level = F.when(~table, F.when(F.col("legal"), legal_level(text)).otherwise(general))
    number = F.when(F.col("legal") & ~table, article_number(text))
    b = b.withColumns({"heading_level": level, "declared": F.least(declared, F.lit(2))})
    section = F.col("heading_level").isNotNull() & (F.col("legal") | (F.col("heading_level") <= 2))
    b = b.withColumn(
        "kind",
        F.when(table, "table")
        .when(section, "section")
        .when(F.col("legal"), F.when(number.isNotNull(), "marker").otherwise("text"))
        .when(title, "marker")
        .otherwise("text"),
    )
    is_article = (F.col("kind") == "marker") & F.col("legal")
    return b.withColumns(
        {
            "heading": F.when(
                F.col("kind") == "section",
                F.when(F.col("legal"), F.substring_index(text, "\n", 1)).otherwise(text),
            ).when((F.col("kind") == "marker") & ~F.col("legal"), text),
            "article_no": F.when(is_article, number),
            "article_title": F.when(is_article, article_title(text)),
        }
    )
