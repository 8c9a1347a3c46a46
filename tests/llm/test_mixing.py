import heapq
import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkseek.llm.mixing import Fluid, default_weights, mix, mixed
from sparkseek.llm.queries import op7_source_mixing

SMALL = "/root/testdata/sf0.001"


def served(blocks, weights):
    """Ideal blocks of each source after every slot, phase by phase."""
    got, t, out = [Fraction(0)] * len(blocks), Fraction(0), []
    while len(out) < sum(blocks):
        on = [i for i, n in enumerate(blocks) if got[i] < n]
        total = sum(weights[i] for i in on)
        step = min([(blocks[i] - got[i]) * total / weights[i] for i in on] + [len(out) + 1 - t])
        for i in on:
            got[i] += step * weights[i] / total
        t += step
        if t == len(out) + 1:
            out.append(list(got))
    return out


def brute(blocks, weights):
    """Sources by slot: windows from the ideal service slot by slot, then earliest deadline first."""
    ideal = [[Fraction(0)] * len(blocks), *served(blocks, weights)]
    jobs = []
    for s, n in enumerate(blocks):
        for i in range(n):
            deadline = next(t for t, x in enumerate(ideal) if x[s] >= i + 1)
            release = max(t for t, x in enumerate(ideal) if x[s] <= i)
            jobs.append((release, deadline, s, i))
    jobs.sort()
    ready, out, at = [], [], 0
    for t in range(sum(blocks)):
        while at < len(jobs) and jobs[at][0] <= t:
            heapq.heappush(ready, (jobs[at][1], jobs[at][2], jobs[at][3]))
            at += 1
        out.append(heapq.heappop(ready)[1:])
    return out


WEIGHTS = st.sampled_from([Fraction(1), Fraction(2), Fraction(7, 3), Fraction(1, 100), Fraction(0.3), Fraction(2.0**0.5)])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), WEIGHTS), min_size=1, max_size=7))
def test_sweep_equals_brute_force_and_deviates_by_less_than_a_block(sources):
    blocks, weights = [b for b, _ in sources], [w for _, w in sources]
    got = [(int(s), int(i)) for a, b in Fluid(blocks, weights).sweep() for s, i in zip(a, b)]
    assert got == brute(blocks, weights)
    seen = Counter()
    for (s, _), ideal in zip(got, served(blocks, weights)):
        seen[s] += 1
        assert all(abs(seen[q] - x) < 1 for q, x in enumerate(ideal))


def test_a_million_blocks_keep_to_the_target_weights():
    for weights in ([0.9, 0.1], [0.99, 0.01], [0.7, 0.2, 0.05, 0.03, 0.02], [1000.0] + [1.0] * 999, [float(i % 97 + 1) for i in range(10_000)]):
        whole = sum(map(Fraction, weights))
        exact = [Fraction(w) / whole for w in weights]
        total = 200_000 if len(weights) > 10 else 1_000_000
        blocks = [math.ceil(total * w) + 1 for w in exact]
        source = np.concatenate([s for s, _ in Fluid(blocks, list(map(Fraction, weights))).sweep()])
        # Nobody runs out before `total`: the targets themselves are the ideal.
        for t in (1, 10, 333, 1000, 99_999, total // 2, total):
            seen = np.bincount(source[:t], minlength=len(weights))
            assert all(abs(int(n) - t * w) < 1 for n, w in zip(seen, exact))


def test_query_equals_brute_force(spark):
    rows = op7_source_mixing(spark, SMALL).collect()
    docs = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    assert sorted((r["doc_id"], r["source"]) for r in rows) == sorted((d["doc_id"], d["source"]) for d in docs)
    counts = Counter(d["source"] for d in docs)
    names = sorted(counts)
    target = default_weights(counts)
    assert target == {s: n**0.5 for s, n in counts.items()}
    order = brute([-(-counts[s] // 64) for s in names], [Fraction(target[s]) for s in names])
    seeded = {r["id"]: r["h"] for r in spark.createDataFrame([(d["doc_id"],) for d in docs], "id bigint").withColumn("h", F.xxhash64("id", F.lit(17))).collect()}
    want, at = {}, 0
    ranked = {s: sorted((d["doc_id"] for d in docs if d["source"] == s), key=lambda i: (seeded[i], i)) for s in names}
    for slot, (s, block) in enumerate(order):
        for i in ranked[names[s]][64 * block : 64 * block + 64]:
            want[i] = (block, slot, at)
            at += 1
    assert {r["doc_id"]: (r["block"], r["slot"], r["position"]) for r in rows} == want


def test_weights_and_edges(spark):
    rows = [(i, "a" if i % 3 else "b", i) for i in range(600)] + [(None, None, 0)] * 2 + [(900, "c", 1), (900, "c", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, position int")
    got = sorted(mix(df, {"a": 3, "b": 1}, block_rows=5).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(len(rows)))
    assert max(Counter((r["source"], r["block"]) for r in got).values()) <= 5
    for t in range(5, 400, 5):
        assert abs(sum(r["source"] == "b" for r in got[:t]) / 5 - t / 20) < 1
    assert {r["source"] for r in got[-4:]} == {None, "c"}
    again = mixed(df, {"a": 3, "b": 1}, block_rows=5)
    assert again.columns == df.columns and sorted(map(str, again.collect())) == sorted(map(str, df.collect()))
    head = [r["source"] for r in again.limit(200).collect()]
    assert abs(head.count("b") - 50) <= 5
    assert mix(df.where(F.lit(False))).collect() == [] and mixed(df.where(F.lit(False))).collect() == []


def test_columns_of_any_name(spark):
    names = ["mixed_id", "mixed_position", "position", "slot", "block", "number", "begin", "within", "short", "mix", "id"]
    df = spark.createDataFrame([(i, "a", *[f"{n}{i}" for n in names]) for i in range(9)], "doc_id bigint, source string, " + ", ".join(f"{n} string" for n in names))
    assert sorted(map(str, mixed(df).collect())) == sorted(map(str, df.collect()))
    assert sorted(r["position"] for r in mix(df).collect()) == list(range(9))


def test_many_sources(spark):
    df = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("host"), (F.col("id") % 3000).cast("string")).alias("source"))
    got = mix(df, block_rows=2).toPandas()
    assert sorted(got.position) == list(range(12_000)) and got.groupby("slot").source.nunique().max() == 1
