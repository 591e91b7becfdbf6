"""URL filters: host and path rules first, then a weighted vocabulary matched by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRICT_TERMS = ("casino", "porn", "xxx", "viagra", "phishing", "warez")
SOFT_TERMS = (
    ("adult", 3), ("ads", 1), ("bets", 2), ("cheap", 2), ("farm", 1), ("free", 1), ("pills", 3), ("spam", 3), ("track", 1), ("win", 1),
)
BASE_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


@dataclass(frozen=True)
class UrlFilter:
    """``rules``: (verdict, host, path prefix); ``soft``: (term, weight), each term once.

    A url is rejected on one strict term, or on ``min_soft`` distinct soft terms whose weights sum to ``min_weight``.
    """

    rules: Sequence[tuple[str, str, str]] = BASE_RULES
    strict: Sequence[str] = field(default=STRICT_TERMS)
    soft: Sequence[tuple[str, int]] = field(default=SOFT_TERMS)
    min_soft: int = 2
    min_weight: int = 3


def url_host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null; of rules of one length the first listed."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        best = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


@lru_cache(maxsize=4)
def _automaton(strict: tuple[str, ...], soft: tuple[tuple[str, int], ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, weight in soft:
        found.add_word(term, (term, weight))
    for term in strict:
        found.add_word(term, (term, None))
    found.make_automaton()
    return found


def count_terms(text: str, strict: tuple[str, ...], soft: tuple[tuple[str, int], ...]) -> tuple[int, int, int]:
    """Strict hits, distinct soft terms and their weight in a lower-cased url; a hit has no letter right before or after it."""
    hard, soft_seen = 0, {}
    for end, (term, weight) in _automaton(strict, soft).iter(text):
        start = end - len(term) + 1
        if (start and text[start - 1].isalpha()) or (end + 1 < len(text) and text[end + 1].isalpha()):
            continue
        if weight is None:
            hard += 1
        else:
            soft_seen[term] = weight
    return hard, len(soft_seen), sum(soft_seen.values())


def url_filter(pages: DataFrame, spec: UrlFilter = UrlFilter()) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft, soft_weight of every row of ``pages``.

    A null url, or one without ``://``, has empty host and path and no hits: it is allowed, with a null rule. Repeated
    rows give repeated rows. The vocabulary is applied to the whole lower-cased url of every row, and decides where
    no rule fits.
    """
    strict, soft = tuple(spec.strict), tuple((term, weight) for term, weight in spec.soft)

    @F.pandas_udf("struct<n_strict:bigint,n_soft:bigint,soft_weight:bigint>")
    def terms(urls: pd.Series) -> pd.DataFrame:
        rows = [count_terms(u.lower(), strict, soft) if u else (0, 0, 0) for u in urls]
        return pd.DataFrame(rows, columns=["n_strict", "n_soft", "soft_weight"], dtype="int64")

    rows = pages.select(
        "page_id",
        url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"),
        terms(F.when(F.contains("url", F.lit("://")), F.col("url"))).alias("terms"),
    ).withColumn("fit", fitting_rule(F.col("host"), F.col("path"), spec.rules))
    several = (F.col("terms.n_soft") >= spec.min_soft) & (F.col("terms.soft_weight") >= spec.min_weight)
    rejected = (F.col("terms.n_strict") > 0) | several
    return rows.select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(rejected, "block").otherwise("allow")).alias("verdict"),
        F.col("terms.n_strict").alias("n_strict"),
        F.col("terms.n_soft").alias("n_soft"),
        F.col("terms.soft_weight").alias("soft_weight"),
    )
