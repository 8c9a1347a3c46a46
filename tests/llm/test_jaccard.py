import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sparkseek.llm.jaccard import least_matches, near_duplicates
from sparkseek.llm.queries import op8_ngram_jaccard_join

SMALL = "/root/testdata/sf0.001"


def brute(rows, t=0.8):
    sets = {}
    for i, text in rows:
        w = re.findall(r"\w+", (text or "").lower())
        k = min(5, len(w)) or 1
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()
    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    pairs = Counter(p for ids in by.values() for p in combinations(sorted(ids), 2))
    links, up = Counter(), {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, b), n in pairs.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= t:
            links[a] += 1
            links[b] += 1
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {i: (root(i), links[i], root(i) == i) for i in sets}


def test_query_equals_brute_force(spark):
    want = brute([(r["doc_id"], r["text"]) for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()])
    got = {r[0]: (r[1], r[2], r[3]) for r in op8_ngram_jaccard_join(spark, SMALL).collect()}
    assert got == want and any(n for _, n, _ in want.values())


def test_large_groups_in_blocks(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    base = list(rng.choice(words, 160))
    rows = []
    for i in range(300):  # near copies, copies and texts that share a passage
        text = list(base)
        for k in rng.choice(160, rng.integers(0, 6), replace=False):
            text[k] = str(rng.choice(words))
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(base[:60]) + " " + " ".join(rng.choice(words, 90))) for i in range(60)]
    rows += [(2000 + i, rows[i % 7][1]) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r[0]: (r[1], r[2], r[3]) for r in near_duplicates(df, block_bytes=200_000).collect()}
    want = brute(rows)
    assert got == want


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "!!!", "c"), (None, "one two three four five six", "d"), (4, "one two", "e"), (5, "One, two", "f"), (6, "x " * 50_000, "g"), (7, "x x x x x", "h"), (7, "x x x x x", "h")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, rep string")
    got = sorted(((r[0], r[1], r[2], r[3]) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, 0, True), (2, 2, 0, True), (3, 3, 0, True), (None, None, 0, True), (4, 4, 1, True), (5, 4, 1, False), (6, 6, 2, True), (7, 6, 2, False), (7, 6, 2, False)], key=str)
    assert near_duplicates(df.where(F.lit(False))).collect() == []


def test_unlike_texts_under_one_id_are_rows_of_their_own(spark):
    one, two, three = (" ".join(f"{a}{i}" for i in range(60)) for a in "xyz")
    rows = [(5, one), (5, two), (6, one + " more"), (7, two + " more"), (7, three), (8, three), (5, one), (9, "alone")]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "doc_id bigint, text string, node int, d1 int, component int")
    got = sorted(tuple(r) for r in near_duplicates(df).collect())
    assert got == sorted([(5, 5, 2, True), (5, 5, 2, True), (5, 5, 1, True), (6, 5, 2, False), (7, 5, 1, False), (7, 7, 1, True), (8, 7, 1, False), (9, 9, 0, True)])


def test_pruning_bound():
    assert least_matches(0.8, 1e-6, 16) <= 5 and least_matches(0.8, 1e-6, 160) > 90
