"""Ranked search against scoring every document with every item."""

import math
import random
import re
from collections import Counter

import pytest

from chunkloom.llm.reversed_search import rank_documents

from .conftest import rows

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top=10):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [c.total() for _, c in counted if c]
    n_docs, words = len(sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in wanted.items():
        scored = []
        for d, c in counted:
            if not c:
                continue
            m = 100 - 90 + (90 * c.total() * n_docs) // words
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if c[t]
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored, key=lambda s: s[:3])[:top])]
    return sorted(out, key=str)


def result(docs, items, **options):
    found = rank_documents(docs, items, **options)
    assert found.dtypes[1:] == [("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted((tuple(r) for r in found.collect()), key=str)


ITEMS = [(1, "alpha beta gamma"), (2, "one two three"), (2, "four FIVE"), (3, None), (4, ""), (None, "token secret tok1 tok2"), (5, "nowhere"), (6, "é 😀 W0X1"), (7, "one one one")]


@pytest.mark.parametrize("block_chars", [10_000_000, 20])
def test_messy(spark, messy, nothing, block_chars):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    docs = [r[:2] for r in rows()]
    assert result(messy, items, block_chars=block_chars) == plain(docs, ITEMS)
    assert result(nothing, items) == []
    assert result(messy, items.where("false")) == []


def test_ties_and_tops(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice("abcde") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 6)))) for i in range(400)]
    items = [(str(k), " ".join(rng.choice("abcde") * rng.randrange(1, 3) for _ in range(3))) for k in range(12)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    wanted = spark.createDataFrame(items, "item_id string, text string")
    assert result(table, wanted) == plain(docs, items)
    assert result(table, wanted, top=1) == plain(docs, items, 1)
