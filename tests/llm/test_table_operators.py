"""Operators that bring rows together, against brute force."""

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import exact, fuse, mixing, neardup, passages, permutation
from millrace.llm.components import components
from millrace.llm.store import Scratch

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
DOCS = "doc_id long, text string, source string"


def words(text):
    return WORDS.findall((text or "").translate(FOLD))


def prose(r, n):
    return [f"w{r.randrange(5000)}" for _ in range(n)]


# Components


def test_components_of_chains_stars_and_cycles(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 230)] + [(300, 301), (301, 302), (302, 300), (7, 7), (None, 3)]
    r.shuffle(links)
    got = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test")).collect()
    found = {row["node"]: row["component"] for row in got}
    assert found == {**{i: 100 for i in range(101, 161)}, **{i: 5 for i in range(200, 230)}, 301: 300, 302: 300}


# Near duplicates


def near_groups(rows, size, percent):
    """doc_id -> (set size, smallest reachable id), by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_fixture():
    r = random.Random(2)
    rows, base = [], prose(r, 120)
    rows.append((1, " ".join(base)))
    for i in range(2, 90):  # a drifting cluster around one text
        w = rows[r.randrange(len(rows))][1].split(" ")
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    line = prose(r, 30)
    for i in range(100, 140):  # a common passage in otherwise different texts, short ones too
        rows.append((i, " ".join(prose(r, r.choice([2, 4, 60])) + line + prose(r, r.choice([0, 3, 50])))))
    for i in range(200, 230):  # small sets near the threshold
        rows.append((i, " ".join(["a", "b", "c", "d", "e", "f", "g", "h", "i", "j"][: r.randint(1, 10)])))
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "A B"), (304, "a  b"), (305, "b a")]
    return rows


@pytest.mark.parametrize(("size", "sketch"), [(4, 64), (5, 16)])
def test_near_duplicates_against_all_pairs(spark, size, sketch):
    rows = near_fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("v", F.lit(1)).repartition(5)
    out = neardup.near_duplicates(docs, shingle=size, size=sketch).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == near_groups(rows, size, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out) and len(out) == len(rows)


def test_lists_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = near_fixture()
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == near_groups(rows, 4, 80)


def test_near_duplicates_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (None, text), (None, text + " more"), (7, text + " else"), (8, "quite another text with some words"), (8, "a second text of that very id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("own", F.lit("clash"))
    out = neardup.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in out) == [(0, 0, True), (0, 7, False), (0, 7, False), (0, 7, False), (7, 7, True), (8, 8, True), (8, 8, True)]
    left = neardup.without_near_duplicates(docs)
    assert left.columns == ["doc_id", "text", "own"] and left.filter("own = 'clash'").count() == 4
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


# Exact duplicates


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 30_000])
def test_fuse_filter_knows_all_its_keys(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
    made = fuse.build(keys)
    assert fuse.contains(made, keys).all()
    others = np.random.default_rng(0).integers(2**63, 2**64, 20_000, dtype=np.uint64)
    assert fuse.contains(made, others).mean() < 0.01
    if n > 10_000:
        assert len(made) < 1.4 * n


def exact_fixture():
    r = random.Random(3)
    texts = ["", "one", "two", "Two", "x" * 100_000] + [f"text {i % 40}" for i in range(100)]
    rows = [(i, r.choice(texts), f"s{i % 3}") for i in range(400)] + [(1000, None, None), (1001, "é"), (1001, "é")]
    return [(*row, None)[:3] for row in rows]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups_against_grouping_by_text(spark, weak):
    rows = exact_fixture()
    docs = spark.createDataFrame(rows, DOCS).withColumn("keep", F.lit("clash")).repartition(4)
    digest = (lambda t: F.encode(F.length(t).cast("string"), "utf-8")) if weak else exact.sha256
    out = exact.duplicate_groups(docs, F.expr("doc_id % 2 = 0"), digest).collect()
    groups = defaultdict(list)
    for i, text, _ in rows:
        groups[text or ""].append(i)
    expected = Counter((i, max(groups[text or ""]), len(groups[text or ""])) for i, text, _ in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in out) == expected
    assert sorted(r["doc_id"] for r in out if r["kept"]) == sorted(max(g) for g in groups.values())
    if not weak:
        digests = {i: sha256((text or "").encode()).digest() for i, text, _ in rows}
        assert all(bytes(r["digest"]) == digests[r["doc_id"]] for r in out)


def test_rows_that_stay(spark):
    rows = [(1, "a", "s"), (2, "a", "s"), (2, "a", "s"), (None, "a", "s"), (None, "b", "s"), (None, "b", "s"), (3, None, "s"), (4, "", None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("digest", F.lit("clash"))
    left = exact.without_duplicates(docs, F.expr("doc_id = 1"))
    assert left.columns == [*docs.columns]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == [(0, "b"), (2, "a"), (4, "")]
    assert exact.duplicate_groups(docs.limit(0), F.lit(True)).count() == 0


# Mixing


def targets_of(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Shares by weight; what exceeds the most goes to the others, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        plan = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if plan[s] > most * sizes[s]]
        if not above:
            return fixed | plan
        fixed |= {s: most * sizes[s] for s in above}


def mixing_fixture():
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * min(400, int(r.paretovariate(1.1) * 10))), r.choice(["hot"] * 6 + ["a", "b", "é", "Z", None])) for i in range(6000)]
    return rows + [(6001, None, "a"), (6002, "", "nothing"), (6003, " one  two ", "a"), (6003, " one  two ", "a"), (None, "no id", "b")]


def test_mixture_comes_near_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 100)  # several levels of the tree
    rows = mixing_fixture()
    docs = spark.createDataFrame(rows, DOCS).withColumn("target", F.lit("clash"))
    out = mixing.copies(docs.repartition(3)).collect()
    again = mixing.copies(docs.repartition(7)).collect()
    key = ("doc_id", "source", "size", "copies")
    assert Counter(tuple(r[k] for k in key) for r in out) == Counter(tuple(r[k] for k in key) for r in again)
    sizes, taken = Counter(), Counter()
    for i, text, source in rows:
        sizes[source] += len(WORDS.findall(text or ""))
    expected = targets_of(sizes)
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r["copies"] <= 2 and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(expected[r["source"]], rel=1e-9, abs=1e-9)
        taken[r["source"]] += r["copies"] * r["size"]
    for source, target in expected.items():
        assert abs(taken[source] - target) <= 0.03 * target + 400, source


def test_rounding_keeps_sums_and_odds():
    import pandas as pd

    total = np.zeros(20)
    p = np.linspace(0.05, 0.95, 20)
    for seed in range(2000):
        group = pd.DataFrame({"size": 1, "lot": range(20), "doc_id": range(20), "p": p, "seed": seed})
        extra = mixing._rounded((), group, last=True).sort_values("doc_id")["extra"].to_numpy()
        assert extra.sum() in (10, 10.0) and set(extra) <= {0.0, 1.0}
        total += extra
    assert np.abs(total / 2000 - p).max() < 0.05


def test_mixed_rows(spark):
    rows = [(1, "a b c", "s"), (2, "d", "s"), (2, "d", "s"), (None, "e f", None), (3, None, "t")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("lot", F.lit("clash"))
    out = mixing.mixed(docs, weights=(1,), share=2.0)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == {(1, "a b c"): 2, (2, "d"): 4, (None, "e f"): 2}
    assert mixing.copies(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


# Nearest neighbours


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(1200, 16)) * rng.uniform(0.5, 2, size=(1200, 1))).astype(np.float32)
    x[300:500] = x[300]  # one very common vector
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2004, [1.0] * 3), (None, [1.0] * 16), (2005, [float("inf")] * 16)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    out = permutation.neighbours(table, F.col("vec_id") % 20 == 0).collect()
    found = defaultdict(list)
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 1200, 20))
    hit, exact_ = 0, x.astype(np.float64)
    for q, got in found.items():
        scores = exact_ @ exact_[q]
        order = [int(i) for i in np.lexsort((np.arange(1200), -scores)) if i != q][:20]
        assert len(got) == 20 and q not in [i for i, _ in got]
        assert np.allclose([s for _, s in got], scores[[i for i, _ in got]], rtol=0, atol=1e-12)
        assert got == sorted(got, key=lambda g: (-g[1], g[0]))
        hit += len(set(order) & {i for i, _ in got})
    assert hit / (20 * len(found)) >= 0.9


def test_few_vectors(spark):
    table = spark.createDataFrame([(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    out = permutation.neighbours(table, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out) == [(20, 1, 1, 1.0), (20, 2, 2, 1.0)]
    assert permutation.neighbours(table.limit(0), F.lit(True)).count() == 0
    alone = spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>")
    assert permutation.neighbours(alone, F.lit(True)).count() == 0


def test_double_vectors_keep_their_digits(spark):
    x = np.random.default_rng(8).normal(size=(60, 3)) * (1 + 1e-12)
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    out = permutation.neighbours(table, F.col("vec_id") % 20 == 0).collect()
    assert len(out) == 60
    for r in out:
        assert abs(r["score"] - float(x[r["query_id"]] @ x[r["vec_id"]])) < 1e-14


def test_the_share_of_opened_files_falls_as_pivots_grow():
    shares = [permutation.opened_share(n) for n in (1, 16, 100, 226, 1000, 4096)]
    assert shares[0] == 1 and shares == sorted(shares, reverse=True) and shares[2] == 0.3
    assert all(a * m < b * n for (a, m), (b, n) in zip(zip(shares, (1, 16, 100, 226, 1000)), zip(shares[1:], (16, 100, 226, 1000, 4096))))  # more files, still


def test_a_query_opens_its_share_of_all_files(spark, monkeypatch):
    monkeypatch.setattr(permutation, "PLACES", 4)  # fewer than the files to open, as in a large table
    x = np.random.default_rng(6).normal(size=(1500, 16)).astype(np.float32)
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    found = defaultdict(list)
    for r in sorted(permutation.neighbours(table, F.col("vec_id") % 100 == 0, opened=1.0, reranked=1.0).collect(), key=lambda r: r["rank"]):
        found[r["query_id"]].append(r["vec_id"])
    for q in range(0, 1500, 100):
        assert found[q] == [int(i) for i in np.argsort(-(x.astype(np.float64) @ x[q].astype(np.float64)), kind="stable") if i != q][:20]


def test_ties_within_a_block_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, (i * 37 % 2000) / 2000]) for i in range(1, 2000)]
    table = spark.createDataFrame([*rows, (5000, [1.0, 0.0])], "vec_id long, embedding array<float>")
    out = permutation.neighbours(table, F.col("vec_id") == 5000, opened=1.0, reranked=1.0).collect()
    assert [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"])] == list(range(1, 21))


# Passages


def test_common_words_is_the_longest_common_subsequence():
    r = random.Random(6)
    for _ in range(200):
        a, b = ([r.randrange(4) for _ in range(r.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert passages.common_words(np.array(a, np.uint32), np.array(b, np.uint32)) == table[-1][-1]


def test_best_chain_against_all_chains():
    r = random.Random(7)
    for _ in range(60):
        n = r.randint(2, 9)
        x, y = (np.array([r.randrange(40) for _ in range(n)]) for _ in range(2))

        def score(i, x=x, y=y):
            return 5 + max([0.0, *(score(j) - passages.GAP_COST * (x[i] + y[i] - x[j] - y[j]) for j in range(len(x)) if x[j] < x[i] and y[j] < y[i])])

        best = max(score(i) for i in range(n))
        paths = passages.chains(x, y, least=1)
        first = paths[0]
        assert (np.diff(x[first]) > 0).all() and (np.diff(y[first]) > 0).all()
        assert 5 * len(first) - passages.GAP_COST * (x[first][-1] - x[first][0] + y[first][-1] - y[first][0]) == pytest.approx(best)
        assert sorted(i for p in paths for i in p.tolist()) == list(range(n))


def test_marks_that_differ_in_their_lowest_bits_are_paired():
    r = random.Random(17)
    for bits, most in ((8, passages.PAIRS), (24, passages.PAIRS), (8, 3)):
        mark = np.array([r.randrange(30) << bits | r.randrange(4) for _ in range(120)] + [99 << bits] * 3, np.uint64)
        passages.PAIRS, before = most, passages.PAIRS
        try:
            found = [(min(p, q), max(p, q)) for i, j in passages._differing(mark, bits) for p, q in zip(i.tolist(), j.tolist(), strict=True)]
        finally:
            passages.PAIRS = before
        m = mark.tolist()
        assert sorted(found) == [(i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if m[i] >> bits == m[j] >> bits and m[i] != m[j]]


def test_chains_of_many_pairs_are_those_of_each():
    r = np.random.default_rng(15)
    pair, x, y = [], [], []
    for p in range(40):
        at = np.unique(r.integers(0, r.integers(3, 60), (int(r.integers(2, 70)), 2)), axis=0)
        at = at[np.lexsort((at[:, 0], at[:, 1] - at[:, 0]))]
        pair, x, y = pair + [p] * len(at), x + at[:, 0].tolist(), y + at[:, 1].tolist()
    pair, x, y = (np.array(c) for c in (pair, x, y))
    weight = r.integers(1, 20, len(x))
    found, sizes = passages.chains_of(pair, x, y, weight)
    want = {tuple(np.flatnonzero(pair == p)[c].tolist()) for p in range(40) for c in passages.chains(x[pair == p], y[pair == p], weight=weight[pair == p])}
    assert len(want) > 100 and len(sizes) == len(want)
    assert {tuple(c.tolist()) for c in np.split(found, sizes.cumsum()[:-1])} == want


def test_gaps_and_ends_of_many_chains_are_aligned_as_each():
    r = np.random.default_rng(16)
    a, b = (r.integers(0, 3, 3000).astype(np.uint32) for _ in range(2))
    b[1000:1400] = a[1000:1400]
    b[r.integers(1000, 1400, 20)] = 7
    m, n = r.integers(0, 70, 500), r.integers(0, 70, 500)
    a0, b0 = r.integers(100, 2500, 500), r.integers(100, 2500, 500)
    assert passages._common(a, a0, m, b, b0, n).tolist() == [passages.common_words(a[i : i + k], b[j : j + h]) for i, k, j, h in zip(a0, m, b0, n, strict=True)]
    m, n = r.integers(0, 500, 500), r.integers(0, 500, 500)
    a0 = b0 = r.integers(700, 1500, 500)
    for way in (1, -1):
        got = passages._outwards(a, a0, m, b, b0, n, way)
        want = [passages._outward(a[i : i + k * way : way][:k], b[j : j + h * way : way][:h]) for i, k, j, h in zip(a0, m, b0, n, strict=True)]
        assert list(zip(*(c.tolist() for c in got), strict=True)) == want
        assert max(length for length, _, _ in want) > 128


def test_passages_are_found_and_clean_documents_left_alone(spark):
    r = random.Random(8)
    passage, fuzzy, line = prose(r, 60), prose(r, 80), prose(r, 20)
    changed = list(fuzzy)
    changed[20], changed[50] = "other", "thing"
    del changed[65]
    rows = {i: prose(r, 50) + line + prose(r, 40) for i in range(1, 60)}
    for i in (5, 10, 50):
        rows[i] = prose(r, 30) + passage + prose(r, 30)
    rows[7], rows[8] = prose(r, 25) + fuzzy + prose(r, 10), prose(r, 5) + changed + prose(r, 60)
    # Pieces of the passage in earlier documents do not hide it in later ones.
    rows[2], rows[3] = prose(r, 20) + passage[:30] + prose(r, 20), prose(r, 20) + passage[30:] + prose(r, 20)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()] + [(70, None), (71, ""), (None, " ".join(passage)), (72, " ".join(passage + passage))],
                                 "doc_id long, text string").withColumn("ref", F.lit("clash"))
    out = passages.repeated_passages(docs).collect()
    assert {r["doc_id"] for r in out} | {r["ref_id"] for r in out} == {5, 10, 50, 72, 7, 8}
    pair = next(r for r in out if r["doc_id"] == 8)
    assert (pair["ref_id"], pair["start"], pair["end"], pair["ref_start"], pair["ref_end"]) == (7, 5, 84, 25, 105) and pair["common"] == 77
    for r in out:
        if r["doc_id"] in (10, 50) and r["ref_id"] == 5:
            assert (r["start"], r["end"], r["ref_start"], r["ref_end"]) == (30, 90, 30, 90)
    assert passages.repeated_passages(docs.limit(0)).count() == 0


def test_every_long_exact_repeat_is_covered(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r["doc_id"]: words(r["text"]) for r in docs.collect()}
    where = defaultdict(set)
    for i, w in text.items():
        for j in range(len(w) - 49):
            where[tuple(w[j : j + 50])].add((i, j))
    repeated = {s for s, at in where.items() if len({i for i, _ in at}) > 1}
    covered = defaultdict(set)
    for r in passages.repeated_passages(docs).collect():
        covered[r["doc_id"]].update(range(r["start"], r["end"]))
        covered[r["ref_id"]].update(range(r["ref_start"], r["ref_end"]))
    spots = [(i, j) for s in repeated for i, j in where[s]]
    assert len(spots) > 1000
    assert sum(not covered[i].issuperset(range(j, j + 50)) for i, j in spots) == 0


def test_passages_of_frequent_lines_meet(spark):
    r = random.Random(9)
    lines = [prose(r, 20) for _ in range(3)]
    passage = sum(lines, [])
    rows = {i: prose(r, 30) + lines[i % 3] + prose(r, 30) for i in [*range(1, 40), *range(50, 90), *range(100, 140)]}
    # Pieces across the ends of lines are frequent as well.
    rows |= {i: prose(r, 20) + passage[(i % 3) * 15 :][:30] + prose(r, 20) for i in [*range(200, 230), *range(400, 430)]}
    rows[300], rows[310] = prose(r, 30) + passage + prose(r, 30), prose(r, 10) + passage + prose(r, 30)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    out = passages.repeated_passages(docs).collect()
    assert (310, 10, 70, 300, 30, 90, 60) in {tuple(x) for x in out}
    assert {(x["doc_id"], x["ref_id"]) for x in out} == {(310, 300)}


def test_changed_passages_of_frequent_pieces_meet(spark):
    r = random.Random(12)
    passage = prose(r, 60)
    changed = list(passage)
    for j in (11, 24, 37, 50):
        changed[j] = f"new{j}"
    rows = {}
    for first in (200, 400, 600):
        for i in range(30):
            for j, version in enumerate((passage, changed)):
                begin = r.randrange(31)
                rows[first + 2 * i + j] = prose(r, 20) + version[begin : begin + 30] + prose(r, 20)
    rows[300], rows[500] = prose(r, 20) + passage + prose(r, 20), prose(r, 30) + changed + prose(r, 10)
    # Frequent lines with one word between them, which differs, in many documents: each pair of them is linked.
    lines = [prose(r, 30), prose(r, 30)]
    rows |= {1000 + i: prose(r, 20) + lines[0] + [f"slot{i}"] + lines[1] + prose(r, 20) for i in range(40)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    out = {(x["doc_id"], x["ref_id"]): x for x in passages.repeated_passages(docs).collect()}
    assert tuple(out[500, 300]) == (500, 30, 90, 300, 20, 80, 56)
    assert set(out) == {(500, 300)} | {(1000 + i, 1000 + j) for i in range(40) for j in range(i)}


def test_all_pairs_of_documents_with_a_common_passage_meet(spark):
    r = random.Random(14)
    passage = prose(r, 60)
    rows = {i: prose(r, 20) + passage + prose(r, 20) for i in range(100)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    out = passages.repeated_passages(docs).collect()
    assert {(x["doc_id"], x["ref_id"]) for x in out} == {(i, j) for i in range(100) for j in range(i)}
    # Words beside the passage can agree by chance.
    assert all(x["start"] <= 20 and x["end"] >= 80 and x["ref_start"] <= 20 and x["ref_end"] >= 80 for x in out)


def test_all_places_of_repeating_texts_meet():
    # One document says a line once, the other again and again, 12 words apart: each place is a passage of its own.
    line = np.arange(12, dtype=np.uint8)
    once, again = np.concatenate([line] * 5), np.concatenate([line] * 10)
    x = np.arange(0, 72, 12)
    around = [once, *(again[max(0, i - passages.LEFT) : i + passages.RIGHT] for i in x)]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in around])])
    doc, before = np.array([1] + [2] * 6), np.array([500, 600] + [11] * 5)
    found = np.concatenate(list(passages.links(np.zeros(7, np.int64), doc, np.concatenate([[0], x]), before, np.concatenate(around), offsets)), axis=1)
    assert {(int(p), int(q)) for p, q in zip(found[2], found[3], strict=True) if q == 0 and p % 12 == 0} >= {(int(i), 0) for i in x}


@pytest.mark.parametrize(("percent_changed", "recall"), [(15, 0.95), (20, 0.75)])
def test_recall_of_changed_passages(spark, percent_changed, recall):
    r = random.Random(10)
    rows, n = {}, 200
    for i in range(n):
        passage = prose(r, 60)
        changed = list(passage)
        for j in r.sample(range(5, 55), 60 * percent_changed // 100):
            changed[j] = f"new{i}x{j}"
        rows[i], rows[1000 + i] = prose(r, 20) + passage + prose(r, 20), prose(r, 30) + changed + prose(r, 10)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    found = {(x["doc_id"], x["ref_id"]) for x in passages.repeated_passages(docs).collect()}
    print("recall", percent_changed, len(found) / n)
    assert found <= {(1000 + i, i) for i in range(n)}
    assert len(found) >= recall * n


def test_matches_of_near_copies_are_made_once(spark):
    r = random.Random(13)
    text = prose(r, 200)
    rows = {i: [f"new{i}x{j}" if r.random() < 0.06 else w for j, w in enumerate(text)] for i in range(12)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc long, text string")
    codes = passages._word_codes(docs).select("doc", "codes", "small").cache()
    found = [tuple(x) for x in passages.matches(codes, passages._places(passages.seeds(codes, 1))).collect()]
    once = {x[:4] for x in found}
    assert len({x[:2] for x in once}) == 12 * 11 // 2
    assert len(found) <= 1.5 * len(once)
    # Chains that see the same words are aligned in one row.
    rows = passages._chained(spark.createDataFrame(found, passages._LINKS)).collect()
    assert len({(x["doc"], x["ref"]) for x in rows}) == len(rows)
    assert all(sum(x["sizes"]) == len(x["xs"]) == len(x["ys"]) for x in rows)
