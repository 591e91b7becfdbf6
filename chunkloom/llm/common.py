"""What the operators of this package share.

Conventions that hold for all of them, unless a docstring says otherwise:

* A null text counts as an empty text. A null doc_id is an id of its own that sorts after all others.
* Rows that repeat both doc_id and text are one document; where an operator returns a row per input row,
  each of them gets the same row. Rows that share a doc_id but not the text are different documents.
* Only the columns an operator names are read; further columns may have any name.
* An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, freed_shuffles

NO_ID = -(2**63)  # stands for a null doc_id in joins
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, so that later jobs and retried tasks read the same ones.

    What was shuffled to make them is no longer needed then and is freed.
    """
    with freed_shuffles(df.sparkSession):
        return cut_lineage(df)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def identity(prefix: str = "") -> list[Column]:
    """Two columns that identify a document of (doc_id, text) and can be joined on."""
    return [
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias(f"{prefix}k_id"),
        F.xxhash64(text_of()).alias(f"{prefix}k_text"),
    ]


def id_back(name: str = "k_id") -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores appended to those the table has already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def with_results(docs: DataFrame, results: DataFrame, columns: list[str], how: str = "inner") -> tuple[DataFrame, list[str]]:
    """All columns of ``docs`` joined with ``columns`` of ``results``, a table with one row per (k_id, k_text).

    Returns the joined table and the names the added columns have in it.
    """
    keys = fresh(docs, "k_id", "k_text", *columns)
    left = docs.withColumns({keys[0]: identity()[0], keys[1]: identity()[1]})
    right = results.select(
        F.col("k_id").alias(keys[0]), F.col("k_text").alias(keys[1]), *[F.col(c).alias(n) for c, n in zip(columns, keys[2:])]
    )
    return left.join(right, keys[:2], how).drop(*keys[:2]), keys[2:]


KEY_BUCKETS = 2**26


def maybe_among(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be one of ``keys`` (of that column), so that a join moves few others.

    Keys are told apart by bucket, and the buckets are broadcast as bits of at most ``KEY_BUCKETS / 64`` rows, however many
    keys there are.
    """
    name, word, bits = fresh(df, "bucket", "word", "bits")
    bucket = F.pmod(F.xxhash64(column), F.lit(KEY_BUCKETS)).alias(name)
    place = F.shiftright(name, 6)
    held = keys.select(bucket).groupBy(place.alias(word)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({name} & 63 AS int))")).alias(bits))
    # A semi-join, as Spark would move joins that follow below another one.
    inside = (place == F.col(word)) & (F.getbit(bits, F.col(name).bitwiseAND(63).cast("int")) == 1)
    return df.withColumn(name, bucket).join(F.broadcast(held), inside, "left_semi").drop(name)


def hash_part(mod: int) -> Column:
    """crc32 of doc_id as text (null: empty text) modulo ``mod``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod
