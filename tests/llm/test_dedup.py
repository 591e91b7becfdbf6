"""Exact dedup, line dedup and the Jaccard join against direct Python versions."""

import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from chunkloom.llm import exact_dedup, jaccard_join, line_dedup

from .conftest import rows

LAST = 2**63 - 1


def plain_exact(data):
    groups = defaultdict(list)
    for doc_id, text in data:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for doc_id, text in data:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best = min(groups[norm])
        out.append((doc_id, best[3], len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def check_exact(docs, data, **options):
    """All but ``kept`` by the plain version; of each group one row of the kept doc_id and the most code points stays."""
    got = exact_dedup.exact_dedup(docs, **options).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == plain_exact(data)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_dedup(messy, nothing):
    check_exact(messy, [r[:2] for r in rows()], fan_in=2)
    assert exact_dedup.exact_dedup(nothing).collect() == []


def test_exact_dedup_keeps_one_of_ties(spark):
    data = [(1, "a b"), (1, "a\tb"), (2, "ab"), (None, "x y"), (None, "x\ny"), (None, "x y"), (3, "same"), (3, "same"), (4, ""), (None, None)]
    check_exact(spark.createDataFrame(data, "doc_id bigint, text string").repartition(4), data)


def plain_lines(data, min_words):
    docs = sorted({(LAST if d is None else d, t or "") for d, t in data})
    lines = {k: k[1].split("\n") for k in docs}
    words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x))
    blocks = defaultdict(list)
    for k in docs:
        for s in range(len(lines[k])):
            total = 0
            for e in range(s, len(lines[k])):
                total += words(lines[k][e])
                if total >= min_words:
                    blocks[tuple(lines[k][s : e + 1])].append((k, s))
                    break
    gone = defaultdict(set)
    for places in blocks.values():
        places.sort()
        for no, (k, s) in enumerate(places):
            for other, at in places[:no]:
                n = 0
                while s + n < len(lines[k]) and at + n < len(lines[other]) and lines[k][s + n] == lines[other][at + n]:
                    n += 1
                gone[k].update(range(s, s + n))
    return {k: [i for i in range(len(lines[k])) if i in gone[k]] for k in docs}


def check_lines(docs, data, min_words):
    want = plain_lines(data, min_words)
    got = line_dedup.line_dedup(docs, min_words).collect()
    assert len(got) == len(data)
    by_text = defaultdict(list)
    for d, t in data:
        by_text[d].append(t)
    for r in got:
        matching = [t for t in by_text[r["doc_id"]] if len((t or "").split("\n")) == r["n_lines"]]
        removed = [i for a, b in (x.split(":") for x in r["removed"].split(",") if x) for i in range(int(a), int(b))]
        assert any(removed == want[(LAST if r["doc_id"] is None else r["doc_id"], t or "")] for t in matching)
        assert r["n_removed"] == len(removed)


def test_line_dedup_messy(messy, nothing):
    check_lines(messy, [r[:2] for r in rows()], 50)
    assert line_dedup.line_dedup(nothing).collect() == []
    kept = line_dedup.drop_repeated_lines(messy)
    assert kept.columns == messy.columns
    by_id = defaultdict(list)
    for r in kept.collect():
        by_id[r["doc_id"]].append(r["text"])
    assert by_id[21] == ["a\nb"]  # both copies go: an earlier document has the passage
    assert 20 not in by_id and by_id[5] == [None] and by_id[6] == [""]


def test_line_dedup_random(spark):
    rng = random.Random(4)
    data = [(i, "\n".join(rng.choice(["", "a", "b b", "c c c"]) for _ in range(rng.randrange(1, 40)))) for i in range(25)]
    data += [(25 + i, "\n".join(["run of words"] * (3 + 5 * i))) for i in range(3)]
    for min_words in (3, 9):
        check_lines(spark.createDataFrame(data, "doc_id bigint, text string"), data, min_words)


def test_line_dedup_by_any_earlier_copy(spark):
    """Runs go as far as they agree with any earlier copy, be it not the first; lines without words count as lines."""
    p, q = " ".join(f"p{i}" for i in range(60)), "\n".join(f"q{i} r{i}" for i in range(10))
    data = [(1, p + "\nx"), (2, p + "\n" + q), (3, p + "\n" + q), (4, p + "\n" + q[:14] + "\nx"), (5, "a\n" + p + "\n\n\n\nb")]
    data += [(6, p + "\n\n\nc"), (7, p + "\n\n\n"), (8, q), (None, "z\n" + p + "\n" + q + "\nz")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string").repartition(5)
    check_lines(docs, data, 50)
    got = {r["doc_id"]: r["removed"] for r in line_dedup.line_dedup(docs).collect()}
    assert (got[1], got[2], got[3], got[6], got[8], got[None]) == ("", "0:1", "0:11", "0:3", "", "1:12")


def test_line_dedup_random_tails(spark):
    """Long passages, each followed by short tails that agree with different earlier copies, and repeated inside documents."""
    rng = random.Random(11)
    passages = [["w " * rng.randrange(4, 9) + f"p{i}.{j}" for j in range(4)] for i in range(3)]
    tail = lambda: [rng.choice(["", "", "a", "b", "a b"]) for _ in range(rng.randrange(9))]
    data = [(i, "\n".join(sum([tail() + rng.choice(passages) + tail() for _ in range(rng.randrange(1, 4))], []))) for i in range(60)]
    for min_words in (12, 20):
        check_lines(spark.createDataFrame(data, "doc_id bigint, text string"), data, min_words)


def plain_sets(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_components(data):
    ids = sorted({LAST if d is None else d for d, _ in data})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(LAST if d is None else d, plain_sets(t)) for d, t in data]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    back = lambda i: None if i == LAST else i
    return sorted(((d, len(s), back(find(LAST if d is None else d)) if s else d) for (d, _), (_, s) in zip(data, sets)), key=str)


def test_jaccard_messy(messy, nothing):
    got = [tuple(r) for r in jaccard_join.jaccard_report(messy).collect()]
    assert sorted(got, key=str) == plain_components([r[:2] for r in rows()])
    assert jaccard_join.jaccard_report(nothing).collect() == []
    assert jaccard_join.drop_near_copies(messy).columns == messy.columns


def test_near_copies_by_null_and_shared_ids(spark):
    """No id links texts: of rows without id or with one id, all that are no near copies stay."""
    text = lambda k: " ".join(f"k{k}w{i}" for i in range(60))
    data = [(7, text(7)), (9, text(9)), (None, text(7) + " end"), (None, text(9) + " end")]  # near 7 and near 9
    data += [(None, text(k)) for k in (1, 2, 3)] + [(None, text(3) + " more"), (None, None), (None, " \t"), (None, "")]
    data += [(20, text(20)), (20, text(21)), (22, text(21) + " end"), (5, text(30)), (5, text(31)), (6, text(31)), (6, text(32))]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard_join.drop_near_copies(docs).collect()), key=str)
    chosen = {text(3), text(3) + " more"}
    assert len(chosen & {t for _, t in kept}) == 1
    gone = [(None, text(7) + " end"), (None, text(9) + " end"), (22, text(21) + " end"), (6, text(31))]
    assert [r for r in kept if r[1] not in chosen] == sorted((r for r in data if r not in gone and r[1] not in chosen), key=str)
    report = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_report(docs).collect()), key=str)
    want = [(7, 56, 7), (9, 56, 9), (None, 57, 7), (None, 57, 9)]
    want += [(None, 56, None)] * 3 + [(None, 57, None)] + [(None, 0, None)] * 3
    want += [(20, 56, 20), (20, 56, 20), (22, 57, 20), (5, 56, 5), (5, 56, 5), (6, 56, 5), (6, 56, 6)]
    assert report == sorted(want, key=str)


def test_jaccard_near_copies(spark, monkeypatch):
    """Chains of near copies around the threshold, in groups larger than a block and tokens above the pair limit."""
    rng = random.Random(8)
    data = []
    for base in range(6):
        words = [f"b{base}w{i}" for i in range(rng.randrange(8, 120))]
        for _ in range(25):
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            data.append((len(data), " ".join(words[: rng.randrange(max(1, len(words) - 6), len(words) + 1)])))
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 7)
    monkeypatch.setattr(jaccard_join.verified_links, "__defaults__", (7,))
    got = [tuple(r) for r in jaccard_join.jaccard_report(spark.createDataFrame(data, "doc_id bigint, text string")).collect()]
    assert sorted(got, key=str) == plain_components(data)


def test_long_words_are_told_apart(spark):
    """Words of thousands of letters of which a polynomial modulo a power of two sees no difference."""
    even = "a"
    for _ in range(12):
        even += even.translate(str.maketrans("ab", "ba"))
    odd = even.translate(str.maketrans("ab", "ba"))
    data = [(d, " ".join(w[:n] for n in (1024, 2048, 4096))) for d, w in ((1, even), (2, odd), (3, even))]
    report = jaccard_join.jaccard_report(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in report) == [(1, 1), (2, 2), (3, 1)]


def test_repeated_rows_leave_one(spark):
    text = lambda k: " ".join(f"k{k}w{i}" for i in range(60))
    data = [(None, text(1), "a"), (None, text(1), "b"), (7, text(2), "a"), (7, text(2), "a"), (8, text(2) + " end", "a"), (None, None, "a"), (None, "", "b"), (9, " ", "a"), (9, " ", "a")]
    kept = jaccard_join.drop_near_copies(spark.createDataFrame(data, "doc_id bigint, text string, source string"))
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(None, text(1)), (7, text(2)), (None, None), (None, ""), (9, " "), (9, " ")], key=str)


def test_run_starts_are_no_plan_with_a_join_per_round(messy):
    ranks = line_dedup.first_ranks(line_dedup.positions(line_dedup.line_table(messy), 50))
    starts = line_dedup.run_starts(ranks)
    assert starts.count() > 0
    assert "Join" not in starts._jdf.queryExecution().optimizedPlan().toString()


def test_few_rows_pass_for_many_keys(spark):
    from chunkloom.llm.common import maybe_among

    keys = spark.range(2_000_000).select((F.col("id") * 2).alias("k"))
    rows = spark.range(40_000).select(F.col("id").alias("k"), F.lit("x").alias("word"), F.lit(1).alias("bucket"))
    found = maybe_among(rows, keys, "k")
    assert found.columns == rows.columns
    assert found.where("k % 2 = 0").count() == 20_000 and found.where("k % 2 = 1").count() < 2_000


def test_prefixes_leave_the_disk(spark):
    import glob

    from chunkloom.session import checkpoint_dir

    texts = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(20)]
    docs = spark.createDataFrame(texts + [(99, texts[3][1] + " end")], "doc_id bigint, text string")
    assert jaccard_join.jaccard_report(docs).where("component_id <> doc_id").count() == 1
    folders = glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/prefixes-*")
    assert folders and all(spark.read.parquet(f).isEmpty() for f in folders)
    lists = lambda n: spark.range(n).select(F.sequence(F.lit(1), F.lit(2**20)).alias("tokens"))
    assert [jaccard_join.filter_bits(lists(n)) for n in (1, 40, 600)] == [2**24, 2**25, 2**28]
