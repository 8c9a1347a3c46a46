import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkseek.llm.common import Forest, broadcast_if_small, components, fresh, numbered, slices, whole_runs


def labels(n, edges):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 19), st.integers(0, 19)), max_size=12), max_size=4))
def test_forest_equals_union_find(batches):
    forest = Forest(20)
    for edges in batches:
        if edges:
            forest.add(np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    flat = [e for b in batches for e in b]
    assert forest.label.tolist() == labels(20, flat) == labels(20, forest.edges)
    assert len(forest.edges) == 20 - len(set(labels(20, flat)))


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [tuple(map(int, rng.integers(200, 260, 2))) for _ in range(45)] + [(300, 300)]
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(3)
    want = labels(301, edges)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in components(df).collect()} == {x: want[x] for x in touched}
    assert components(df.limit(0)).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.integers(1, 9), st.integers(1, 12))
def test_whole_runs(keys, size, rows):
    keys = sorted(keys)
    batches = [pa.RecordBatch.from_pydict({"k": keys[i : i + size], "n": list(range(i, min(i + size, len(keys))))}) for i in range(0, len(keys), size)]
    seen, ends = [], set()
    for batch, starts in whole_runs(batches, ["k"], rows):
        k = batch.column("k").to_pylist()
        assert starts[0] == 0 and starts[-1] == len(k)
        for a, b in zip(starts[:-1], starts[1:]):
            assert len(set(k[a:b])) == 1 and k[a] not in ends
            ends.add(k[a])
        seen += batch.column("n").to_pylist()
    assert seen == list(range(len(keys)))


def test_slices_keep_all_rows():
    texts = ["a" * 10, None, "", "b" * 100, "c", "é" * 30]
    batch = pa.RecordBatch.from_pydict({"t": texts})
    for limit in (1, 20, 1000):
        assert [x for p in slices(batch, "t", limit) for x in p.column("t").to_pylist()] == texts
    assert list(slices(batch.slice(0, 0), "t")) == []


def test_broadcast_only_below_the_measured_bytes(spark):
    df = spark.range(10)
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(broadcast_if_small(df, 320)) and not hinted(broadcast_if_small(df, 319))
    long = df.selectExpr("id", "repeat('x', 1000) AS a", "sequence(0, 99) AS b")
    assert hinted(broadcast_if_small(long, 10 * (24 + 24 + 1000 + 800))) and not hinted(broadcast_if_small(long, 10 * (24 + 24 + 1000 + 800) - 1))
    assert hinted(broadcast_if_small(long.where("id < 0")))


def test_fresh_names():
    assert fresh(["a", "B", "b_"], "a", "b", "c", "c") == ["a_", "b__", "c", "c_"]


def test_numbers_grow_with_the_id(spark):
    df = spark.createDataFrame([(i % 40, i) for i in range(200)], "id bigint, d bigint")
    rows = sorted((r["node"], r["id"], r["d"]) for r in numbered(df, "id", "d").collect())
    assert len({r[0] for r in rows}) == 200 and [r[1:] for r in rows] == sorted(r[1:] for r in rows)
