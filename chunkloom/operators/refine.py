"""Refining chunk texts with a user's model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import non_empty, strip, strip_fence

Refiner = Callable[[str, str], str]  # (prompt, text) -> answer

DEFAULT_PROMPT = "Correct line breaks, spacing and recognition errors. Keep wording, numbers and order. Return only the text."


def refine(chunks: DataFrame, refiner: Refiner, prompt: str | None = None) -> DataFrame:
    """(doc_id, chunk_id, original_text, refined_text, original_chars, refined_chars, elapsed_seconds, error).

    Only ids and texts pass through Python. A failing row carries its error and no refined text.
    """
    asked = prompt.strip() if prompt and prompt.strip() else DEFAULT_PROMPT

    rows = chunks.select("doc_id", "chunk_id", F.coalesce("text", F.lit("")).alias("original_text"))
    return _refined(_ask(rows.withColumn("text", F.col("original_text")), refiner, asked))


def _ask(rows: DataFrame, refiner: Refiner, prompt: str) -> DataFrame:
    """``rows`` with ``text`` replaced by ``answer``, ``elapsed_seconds`` and ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers, errors, seconds = [], [], []
            for text in pdf["text"]:
                began = time.perf_counter()
                try:
                    answers.append(refiner(prompt, text))
                    errors.append(None)
                except Exception as e:
                    answers.append(None)
                    errors.append(str(e))
                seconds.append(round(time.perf_counter() - began, 2))
            yield pdf.drop(columns="text").assign(answer=answers, elapsed_seconds=seconds, error=errors)

    kept = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "text")
    return rows.mapInPandas(run, f"{kept}, answer string, elapsed_seconds double, error string")


def _refined(out: DataFrame) -> DataFrame:
    return out.select(
        "doc_id",
        "chunk_id",
        "original_text",
        strip_fence("answer").alias("refined_text"),
        F.length("original_text").alias("original_chars"),
        F.length(strip_fence("answer")).alias("refined_chars"),
        "elapsed_seconds",
        "error",
    )


ANSWERS = "key string, answer string, elapsed_seconds double, error string"


def refine_once(chunks: DataFrame, refiner: Refiner, path: str, prompt: str | None = None) -> DataFrame:
    """As ``refine``, with answers kept at ``path`` by prompt and text, so that no text is asked about twice.

    Equal texts are one question. Answers are added when the job that asked for them has ended; a job that was lost asks
    again for its own. Texts the model failed on are asked again in the next run.
    """
    spark = chunks.sparkSession
    asked = prompt.strip() if prompt and prompt.strip() else DEFAULT_PROMPT
    key = F.sha2(F.concat(F.lit(asked), F.lit("\x00"), F.col("original_text")), 256)
    rows = chunks.select("doc_id", "chunk_id", F.coalesce("text", F.lit("")).alias("original_text")).withColumn("key", key)
    known = _answers(spark, path).where("answer IS NOT NULL").select("key").distinct()
    questions = rows.groupBy("key").agg(F.first("original_text").alias("text")).join(known, "key", "left_anti")
    _ask(questions, refiner, asked).write.mode("append").parquet(path)
    # Of several answers the first by text, and a failure only where there is no answer; ties do not change it.
    best = F.min(F.struct(F.col("answer").isNull().alias("failed"), "answer", "error", "elapsed_seconds")).alias("b")
    answers = _answers(spark, path).groupBy("key").agg(best).select("key", "b.answer", "b.elapsed_seconds", "b.error")
    return _refined(rows.join(answers, "key"))


def _answers(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(ANSWERS).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ANSWERS)


def as_edits(refined: DataFrame) -> DataFrame:
    """Refined texts as updates of children."""
    ok = refined.where(F.col("error").isNull() & non_empty(strip("refined_text")).isNotNull())
    return ok.select("doc_id", "chunk_id", F.col("refined_text").alias("text"))
