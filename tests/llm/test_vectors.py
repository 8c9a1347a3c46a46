import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sparkseek.llm.queries import op4_embedding_near_dedup
from sparkseek.llm.vectors import ROOTS, Lattice, near_duplicates, nearest_e8

SMALL = "/root/testdata/sf0.001"


def brute(rows, t=0.95):
    ids = [i for i, _ in rows]
    x = np.stack([np.asarray(v, np.float64) for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= t
    np.fill_diagonal(hit, False)
    label = np.array(ids)
    while True:
        new = np.where(hit.any(1), np.minimum(label, np.where(hit, label[None, :], label.max() + 1).min(1)), label)
        if (new == label).all():
            break
        label = new
    return {i: (int(n), int(c), bool(c == i)) for i, n, c in zip(ids, hit.sum(1), label)}


def run(df, **o):
    return {r[0]: (r[1], r[2], r[3]) for r in near_duplicates(df, **o).collect()}


def test_query_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SMALL}/embeddings.parquet").to_pylist()]
    got = {r[0]: (r[1], r[2], r[3]) for r in op4_embedding_near_dedup(spark, SMALL).collect()}
    assert got == brute(rows)


def test_large_groups_in_blocks(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((3, 24))
    rows = [(i, (centre[0] + rng.standard_normal(24) * 0.06).tolist()) for i in range(260)]
    rows += [(300 + i, centre[1].tolist()) for i in range(90)] + [(400 + i, (centre[2] + rng.standard_normal(24) * 0.2).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    want = brute(rows)
    for size in (2048, 40):
        got = run(df, block_rows=size)
        assert {i: v[1:] for i, v in got.items()} == {i: v[1:] for i, v in want.items()}
        assert got == want


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((800, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = rng.standard_normal(x.shape)
    e -= (e * x).sum(1, keepdims=True) * x
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    lattice = Lattice(64, 6, 0.15, 8)
    a, b = lattice.keys(x), lattice.keys(0.95 * x + np.sqrt(1 - 0.95**2) * e)
    met = (a[:, :, :, None] == b[:, :, None, :]) & ((np.arange(9)[:, None] == 0) | (np.arange(9) == 0))
    assert met.any(axis=(1, 2, 3)).mean() > 0.99


def test_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(3)
    y = rng.standard_normal((300, 8)) * 2
    c = nearest_e8(y)
    assert np.allclose(c @ c.T * 2 % 1, 0) and np.isin((c.sum(1)) % 2, [0, 1]).all() and len(ROOTS) == 240
    assert (((y - c) ** 2).sum(1)[:, None] <= (((y - c)[:, None] - ROOTS) ** 2).sum(2) + 1e-9).all()


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.0]), (8, [2.0, 2.0]), (9, [1.0, 1.0, 0.0]), (10, [1e300, 1e300]), (11, [-1.0, -1.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<double>, keys int")
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, None, 9, 11)]
    assert got == sorted(alone + [(7, 3, 7, True), (8, 3, 7, False), (8, 3, 7, False), (10, 3, 7, False)], key=str)
    assert near_duplicates(df.where(F.lit(False))).collect() == []


def test_unlike_vectors_under_one_id_are_rows_of_their_own(spark):
    a, b, c = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1], [0.0, 0.1, -1.0]
    near = lambda v: [x + 0.02 for x in v]
    rows = [(5, a), (5, b), (6, near(a)), (7, near(b)), (7, c), (8, near(c)), (5, a)]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "vec_id bigint, embedding array<double>, node int, d1 int, component int")
    got = sorted(tuple(r) for r in near_duplicates(df).collect())
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (5, 1, 5, True), (6, 2, 5, False), (7, 1, 5, False), (7, 1, 7, True), (8, 1, 7, False)])
