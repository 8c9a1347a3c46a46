from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkseek.llm.lines import dedup_lines, segment_keys, within
from sparkseek.llm.queries import op6_line_dedup

SMALL = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def arr(s):
    return np.array([ord(c) for c in s], np.uint32)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=14), st.text("abc", max_size=14)), min_size=1, max_size=8), st.integers(1, 3))
def test_banded_automaton_equals_edit_distance(pairs, edits):
    assert within([arr(a) for a, _ in pairs], [arr(b) for _, b in pairs], edits).tolist() == [distance(a, b) <= edits for a, b in pairs]


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=7, max_size=24), st.lists(st.tuples(st.sampled_from("idr"), st.integers(0, 30), st.sampled_from("abc")), max_size=3), st.integers(1, 3))
def test_near_lines_share_a_key(line, edits, allowed):
    other = list(line)
    for kind, at, c in edits[:allowed]:
        at %= len(other) + (kind == "i")
        if kind == "i":
            other.insert(at, c)
        elif kind == "d":
            del other[at]
        else:
            other[at] = c
    other = "".join(other)
    if len(other) <= 2 * allowed:
        return
    of, keys, own = segment_keys([line, other], allowed)
    mine = [{k for o, k in zip(of, keys) if o == i} for i in (0, 1)]
    index = [{k for o, k, w in zip(of, keys, own) if o == i and w} for i in (0, 1)]
    assert index[0] & mine[1] or index[1] & mine[0]


def brute(rows, edits=2, low=20):
    """doc -> (text, lines, copies, near); equal lines of any length, near ones from `low` on"""
    order = sorted((d, k, x.strip()) for d, t in rows for k, x in enumerate(t.split("\n")) if x.strip())
    seen, by_size, gone = set(), defaultdict(list), {}
    for d, k, x in order:
        if x in seen:
            gone[d, k] = "copy"
            continue
        seen.add(x)
        if len(x) < low:
            continue
        for n in range(len(x) - edits, len(x) + edits + 1):
            if (d, k) not in gone and any(len(set(x) ^ set(y)) <= 2 * edits and sum(((c[0] - c[1]) ** 2) ** 0.5 for c in counts_apart(x, y)) <= 2 * edits and distance(x, y) <= edits for y in by_size[n]):
                gone[d, k] = "near"
        by_size[len(x)].append(x)
    out = {}
    for d, t in rows:
        own = t.split("\n")
        kinds = [gone.get((d, k)) for k in range(len(own))]
        out[d] = ("\n".join(x for x, g in zip(own, kinds) if not g), len(own) if t else 0, kinds.count("copy"), kinds.count("near"))
    return out


def counts_apart(x, y):
    return [(x.count(c), y.count(c)) for c in set(x) | set(y)]


def planted(n, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("or", "an", "il", "est")]
    base = [" ".join(rng.choice(words, rng.integers(5, 12))) for _ in range(30)]
    rows = []
    for i in range(n):
        own = []
        for _ in range(rng.integers(1, 6)):
            x = list(base[rng.integers(0, 30)] if rng.random() < 0.7 else " ".join(rng.choice(words, 8)))
            for _ in range(rng.integers(0, 4)):
                x[rng.integers(0, len(x))] = rng.choice(list("xyz"))
            own.append(("  " if rng.random() < 0.1 else "") + "".join(x))
        rows.append((i, "\n".join(own)))
    return rows


def test_equals_brute_force(spark):
    rows = planted(250)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = brute(rows)
    assert sum(w[3] for w in want.values()) > 50 and sum(w[2] for w in want.values()) > 20
    for size in (2048, 16):
        assert {r[0]: tuple(r)[1:] for r in dedup_lines(df, block_rows=size).collect()} == want


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"] or "") for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()]
    want = brute(docs)
    got = {r["doc_id"]: (r["text"] or "", r["n_lines"], r["n_copies"], r["n_near"]) for r in op6_line_dedup(spark, SMALL).collect()}
    assert got == want and any(w[2] for w in want.values()) and any(len(x.strip()) < 20 for d, t in docs for x in set(t.split("\n")) - set(want[d][0].split("\n")))


def test_columns_of_any_name(spark):
    names = ["of", "said", "copied", "close", "doc", "line", "near", "h1", "first", "key", "own", "wanted"]
    df = spark.createDataFrame([(i, "the same line", *["x"] * len(names)) for i in range(3)], "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))
    got = sorted(dedup_lines(df, counts=False).collect())
    assert [r["text"] for r in got] == ["the same line", "", ""] and got[2]["said"] == "x" and dedup_lines(df, counts=False).columns == df.columns


def test_edges(spark):
    long = "q" * 60_000
    rows = [(1, None, 7), (1, "", 7), (None, "a line that is long enough", 7), (2, "a line that is long enoug\nshort\nshort\n\n", 7), (3, long + "\n" + long[:-2], 7), (4, long + "x", 7), (4, long + "x", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_lines int")
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_copies"], r["n_near"]) for r in dedup_lines(df).collect()), key=str)
    assert got == sorted([(1, None, 0, 0, 0), (1, "", 0, 0, 0), (None, rows[2][1], 1, 0, 0), (2, "short\n\n", 5, 1, 1), (3, long, 2, 0, 1), (4, "", 1, 0, 1), (4, "", 1, 0, 1)], key=str)
    assert dedup_lines(df, counts=False).columns == df.columns
    assert dedup_lines(df.where(F.lit(False))).collect() == []
