"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, id_back, identity, stored, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5  # of all sizes
MOST = 2  # times a source's size
BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size), one row per source.

    Sources by code point, null last, get the weights in turn. The water level is found in one pass: with sources by
    cap / weight, those before the first that the level does not fill are capped, the rest share by weight.
    The windows hold one row per source.
    """
    numbered = sizes.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("n") % len(weights) + 1)
    caps = numbered.select("source", "source_size", w.alias("w"), (F.col("source_size") * float(most)).alias("cap"))
    order = Window.orderBy((F.col("cap") / F.col("w")), "w", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    levels = caps.select(
        "*",
        ((F.sum("source_size").over(every) * share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("rest"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("rest_w"),
    ).withColumn("level", F.col("rest") / F.col("rest_w"))
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))).over(every)["level"]
    return levels.withColumn("at", level).select(
        "source",
        "source_size",
        F.when(F.col("at").isNull() | (F.col("at") * F.col("w") > F.col("cap")), F.col("cap")).otherwise(F.col("at") * F.col("w")).alias("target"),
    )


def _uniform(ids: np.ndarray, texts: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) that depend on the document and the salt alone."""
    x = ids.astype(np.uint64) ^ (texts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(salt * 0xD1B54A32D192ED03 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)) / float(1 << 53)


def pivot(size: np.ndarray, p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Pair fractional probabilities and move word mass until one of the pair is integral.

    The sum of size * p and the expectation of every p stay as they are. Returns p and the index of the one document
    that may still be fractional, or -1.
    """
    p = p.copy()
    eps = 1e-9
    carry = -1
    for j in range(len(p)):
        if not eps < p[j] < 1 - eps:
            p[j] = round(p[j])
            continue
        if carry < 0:
            carry = j
            continue
        i = carry
        up = min(size[i] * (1 - p[i]), size[j] * p[j])
        down = min(size[i] * p[i], size[j] * (1 - p[j]))
        move = up if u[j] * (up + down) < down else -down
        p[i] += move / size[i]
        p[j] -= move / size[j]
        carry = -1
        for k in (i, j):
            if eps < p[k] < 1 - eps:
                carry = k
            else:
                p[k] = round(p[k])
    return p, carry


def _rounds(level: int, last: bool):
    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "k_id", "k_text"], ascending=[False, True, True], kind="stable")
        u = _uniform(rows["k_id"].to_numpy(), rows["k_text"].to_numpy(), 2 * level + 1)
        p, carry = pivot(rows["size"].to_numpy(dtype=float), rows["p"].to_numpy(), u)
        done = np.ones(len(rows), dtype=bool)
        if carry >= 0 and last:
            p[carry] = float(_uniform(rows["k_id"].to_numpy(), rows["k_text"].to_numpy(), 2 * level + 2)[carry] < p[carry])
        elif carry >= 0:
            done[carry] = False
        return rows.assign(p=p, done=done)

    return settle


def copies(docs: DataFrame, block_rows: int = 4096, fan_in: int = 256) -> tuple[DataFrame, DataFrame]:
    """(k_id, k_text, size, source, source_size, target, copies) per document, with the targets per source as second.

    A source is cut into blocks of about ``block_rows`` documents by hash; each block settles all but one of its
    documents, and the residuals of ``fan_in`` blocks meet in the next level of the tree.
    """
    read = docs.select(*identity(), F.col("source").cast("string").alias("source"), F.size(F.regexp_extract_all(text_of(), F.lit(WORD), F.lit(0))).cast("bigint").alias("size"))
    rows = stored(read.groupBy("k_id", "k_text", "source", "size").agg(F.count("*").alias("times")))
    per_source = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.count("*").alias("rows"))
    facts = stored(per_source)
    targets = source_targets(facts.select("source", "source_size"))
    plan = targets.join(facts.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), "source_size", "target", F.ceil(F.col("rows") / block_rows).alias("blocks")
    )
    n_sources, most_blocks = plan.agg(F.count("*"), F.max("blocks")).first()
    # One short row per source; beyond the bound the same join shuffles.
    plan = F.broadcast(plan) if n_sources <= BROADCAST_SOURCES else plan
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).select(
        "k_id", "k_text", "source", "size", "times", "source_size", "target", rate.alias("rate"),
        F.pmod(F.xxhash64("k_id", "k_text", F.lit(17)), F.col("blocks")).alias("block"),
    )
    fraction = F.col("rate") - F.floor("rate")
    level_rows = start.where((F.col("size") > 0) & (fraction > 1e-9) & (fraction < 1 - 1e-9)).select(
        "k_id", "k_text", "source", (F.col("size") * F.col("times")).alias("size"), "block", fraction.alias("p")
    )
    most_blocks = most_blocks or 1
    settled: list[DataFrame] = []
    level = 0
    while True:
        last = most_blocks <= 1
        out = stored(
            level_rows.groupBy("source", "block").applyInPandas(
                _rounds(level, last), "k_id bigint, k_text bigint, source string, size bigint, block bigint, p double, done boolean"
            )
        )
        settled.append(out.where("done").select("k_id", "k_text", F.col("source").alias("s"), F.col("p").cast("int").alias("extra")))
        if last:
            break
        level_rows = out.where("NOT done").select("k_id", "k_text", "source", "size", F.floor(F.col("block") / fan_in).alias("block"), "p")
        most_blocks = -(-most_blocks // fan_in)
        level += 1
    extra = settled[0]
    for more in settled[1:]:
        extra = extra.unionByName(more)
    extra = extra.withColumnsRenamed({"k_id": "e_id", "k_text": "e_text"})
    same = (F.col("k_id") == F.col("e_id")) & (F.col("k_text") == F.col("e_text")) & F.col("source").eqNullSafe(F.col("s"))
    whole = F.when(F.col("size") > 0, F.floor(F.col("rate") + 1e-9)).otherwise(0)
    mixed = start.join(extra, same, "left").select(
        "k_id", "k_text", "source", "size", "times", "source_size", "target", (whole + F.coalesce("extra", F.lit(0))).cast("int").alias("copies")
    )
    return mixed, targets


def mix_sources(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document.

    A document is taken 0, 1 or 2 times, never more; ``taken`` is size * copies. A null source is one source, after
    all others. Documents without words are never taken. Rows that repeat doc_id, text and source are taken alike,
    and each counts in the sizes. Without words every target is 0.
    """
    mixed, _ = copies(docs)
    return mixed.select(
        id_back().alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"),
        F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("row"),
    ).drop("row")


def take_mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each once, with ``copies`` (1 or 2) added.

    Rows that repeat doc_id and text under different sources are told apart by their source.
    """
    mixed, _ = copies(docs)
    taken = mixed.where("copies > 0").groupBy("k_id", "k_text", "source").agg(F.max("copies").alias("copies"))
    keys = fresh(docs, "k_id", "k_text", "of_source", "copies")
    left = docs.withColumns({keys[0]: identity()[0], keys[1]: identity()[1]})
    right = taken.select(F.col("k_id").alias(keys[0]), F.col("k_text").alias(keys[1]), F.col("source").alias(keys[2]), F.col("copies").alias(keys[3]))
    same = (left[keys[0]] == right[keys[0]]) & (left[keys[1]] == right[keys[1]]) & left["source"].cast("string").eqNullSafe(right[keys[2]])
    return left.join(right, same).select(*[left[c] for c in docs.columns], right[keys[3]])
