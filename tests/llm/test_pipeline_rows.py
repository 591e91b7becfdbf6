"""Rows that pipeline stages keep against direct Python versions, with null ids and planted copies, passages and windows."""

from collections import Counter

import pytest

import corpus_pipeline
from chunkloom.llm import mixing

from .conftest import PASSAGE
from .test_dedup import LAST, plain_lines, plain_sets
from .test_scans import plain_hits

STAGES = dict(corpus_pipeline.STAGES)
WINDOW = " ".join(f"bench{i}" for i in range(13))
ITEMS = [(1, WINDOW + " more")]


def text(k, n=60):
    return " ".join(f"k{k}w{i}" for i in range(n))


DATA = [(i, text(i)) for i in range(10)] + [(None, text(i)) for i in range(20, 24)] + [
    (30, text(3) + " end"), (None, text(4) + " end"), (31, text(5) + " " + text(50)), (None, None), (None, " "), (32, ""),
    (40, "head\n" + PASSAGE + "\ntail"), (41, "a\n" + PASSAGE + "\nb"), (None, "c\n" + PASSAGE), (42, PASSAGE),
    (50, text(60) + " " + WINDOW + " " + text(61)), (None, WINDOW), (51, WINDOW + " " + text(62, 400)), (52, text(63) + " " + WINDOW[:-2]),
]


def plain_line_dedup(data):
    gone = plain_lines(data, 50)
    out = []
    for d, t in data:
        no = set(gone[(LAST if d is None else d, t or "")])
        lines = (t or "").split("\n")
        if len(no) < len(lines):
            out.append((d, "\n".join(x for i, x in enumerate(lines) if i not in no) if no else t))
    return out


def plain_near_copies(data):
    """The first row of each component of links; ids link nothing."""
    order = sorted(range(len(data)), key=lambda i: (data[i][0] is None, data[i][0] or 0))
    sets, root = [plain_sets(t) for _, t in data], list(range(len(data)))
    for k, i in enumerate(order):
        for j in order[:k]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    seen = set()
    return [data[i] for i in order if not (root[i] in seen or seen.add(root[i]))]


def plain_decontamination(data):
    named = [(str(i), t) for i, t in ITEMS]
    hits = [plain_hits(t, named, 13) for _, t in data]
    return [r for r, (n, hit, *_) in zip(data, hits) if not (hit and 20 * hit >= n)]


@pytest.mark.parametrize(
    ("stage", "plain"), [("line_dedup", plain_line_dedup), ("near_copies", plain_near_copies), ("decontamination", plain_decontamination)]
)
def test_rows_of_stage(spark, tmp_path, stage, plain):
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(DATA, "doc_id bigint, text string").repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in STAGES[stage](spark, docs, str(tmp_path)).collect())
    want = Counter(plain(DATA))
    assert got == want and 0 < len(want) and want != Counter(DATA)


def test_mix_tells_sources_apart(spark, tmp_path):
    """A row is taken as often as the mix reports for its source, also if doc_id and text repeat under another."""
    data = [(1, "a b c", "x"), (1, "a b c", "y"), (1, "a b c", None), (None, "d e", "y"), (2, "f", "x"), (3, "", "x")]
    data += [(10 + i, text(i, 20), ("x", "y", "z", None)[i % 4]) for i in range(40)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string").repartition(3)
    report = Counter()
    for r in mixing.mix_sources(docs).collect():
        if r["copies"]:
            report[(r["doc_id"], r["size"], r["source"], r["copies"])] += 1
    taken = STAGES["mixing"](spark, docs, str(tmp_path))
    assert taken.columns == [*docs.columns, "copies"]
    got = Counter((r["doc_id"], len(r["text"].split()), r["source"], r["copies"]) for r in taken.collect())
    assert got == report


@pytest.mark.parametrize("stage", STAGES)
def test_stages_on_empty_tables(spark, tmp_path, stage):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert STAGES[stage](spark, docs, str(tmp_path)).collect() == []
