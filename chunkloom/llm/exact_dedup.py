"""Exact dedup by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

WHITE = r"[ \t-\r]+"  # \x20 and \x09-\x0D
DIGEST = ["text_sha256", "norm_length", "check"]


def digest_runs(docs: DataFrame) -> DataFrame:
    """One row per document with the digest of its text without white space; each scan partition is one sorted run.

    ``norm_length`` and the second hash ``check`` verify that rows of one digest hold one text. ``own_text``, a hash of
    the original text, and ``row``, a number of the row, decide between rows that are alike in all else.
    """
    norm = F.regexp_replace(text_of(), WHITE, "")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.length(text_of()).alias("n_chars"),
        norm.alias("norm"),
        F.xxhash64(text_of()).alias("own_text"),
    ).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.length("norm").alias("norm_length"),
        F.xxhash64("norm").alias("check"),
        "own_text",
        F.spark_partition_id().alias("run"),
    )
    return rows.sortWithinPartitions(*DIGEST).withColumn("row", F.monotonically_increasing_id())


def merge_runs(runs: DataFrame, n_runs: int, fan_in: int = 16) -> DataFrame:
    """The row that stays and the group size of every digest.

    Each round merges ``fan_in`` neighbouring runs, which is log2(fan_in) binomial rounds in one exchange. A run
    carries one row per digest, so a text that fills a third of the corpus is one row per run from the first
    round on. At every level the entry with most code points, then the smallest doc_id, is retained.
    """
    merged = runs.select(
        "run",
        *DIGEST,
        F.struct((-F.col("n_chars")).alias("longest"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "own_text", "row").alias("best"),
        F.lit(1).cast("bigint").alias("group_size"),
    )
    while True:
        merged = (
            merged.withColumn("run", F.floor(F.col("run") / fan_in))
            .groupBy("run", *DIGEST)
            .agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
        )
        n_runs = -(-n_runs // fan_in)
        if n_runs <= 1:
            return merged.select(*DIGEST, "best", "group_size")


def exact_dedup(docs: DataFrame, fan_in: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs``.

    Texts are equal when identical without the characters \\x20 and \\x09-\\x0D. Of equal texts the row with most
    code points stays, then the smallest doc_id, a null doc_id last. Null, empty and blank texts are one group.
    One row of each group is kept: among rows of one length and one doc_id (or none) the one with the smallest hash of
    its original text, and of rows that repeat that too the first read.
    """
    runs = stored(digest_runs(docs))
    n_runs = max(1, runs.agg(F.max("run")).first()[0] or 0) + 1
    winners = merge_runs(runs, n_runs, fan_in)
    joined = runs.join(winners, DIGEST)
    return joined.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )
