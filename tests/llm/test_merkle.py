"""The Merkle manifest against a direct Python version."""

import hashlib
import zlib

import pytest

from chunkloom.llm.merkle import merkle_manifest

from .conftest import rows


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(doc_id, text, lang, source, n_chars):
    return h(*map(field, (doc_id, source, lang, n_chars, text)))


def levels_of(nodes):
    """All levels from the leaves to the single node."""
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([h(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return out


def siblings(levels, at):
    out = []
    for nodes in levels[:-1]:
        other = at ^ 1
        out.append((at % 2 == 0, nodes[other] if other < len(nodes) else ""))
        at //= 2
    return out


def plain(data):
    langs = {}
    for r in data:
        langs.setdefault(r[2], []).append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        own = sorted(langs[name], key=lambda r: (r[0] is None, r[0] or 0, leaf(*r)))
        trees[name] = own, levels_of([leaf(*r) for r in own])
    top = levels_of([trees[n][1][-1][0] for n in names])
    root = top[-1][0]
    out = []
    for no, name in enumerate(names):
        own, levels = trees[name]
        for at, r in enumerate(own):
            path = siblings(levels, at) + siblings(top, no)
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(*r[:4], r[4] + 1 if hit else r[4])
            for first, other in path:
                node = h(node, other) if first else h(other, node)
            out.append((r[0], leaf(*r), levels[-1][0], root, h(*[s for _, s in path]), node, node == root))
    return sorted(out, key=str)


def result(docs, levels):
    found = merkle_manifest(docs, levels).drop("path")
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("levels", [2, 10])
def test_messy(spark, messy, nothing, levels):
    data = [r[:5] for r in rows()]
    got = result(messy, levels)
    assert got == plain(data)
    assert not all(r[-1] for r in got)
    assert result(nothing, levels) == []


@pytest.mark.parametrize("n", [1, 3, 8, 65, 300])
def test_sizes(spark, n):
    data = [(i * 3, f"text {i}", "en" if n < 50 or i % 3 else None, "s", i) for i in range(n)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    assert result(docs, 3) == plain(data)


def test_many_languages(spark):
    data = [(i, "t", ["", "é", "z", "a", "aa", None, "\U0001f600", "\uffee"][i % 8], None, None) for i in range(25)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert result(docs, 2) == plain(data)


def test_path_folds_to_root(spark):
    data = [(i, f"text {i}", f"l{i % 5}", "s", i) for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for r in merkle_manifest(docs, 4).collect():
        node = r["leaf"]
        for step in r["path"]:
            node = h(node, step["sibling"]) if step["first"] else h(step["sibling"], node)
        assert node == r["root"]
