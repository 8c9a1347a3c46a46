"""Embedding near-duplicates: lattice hashing with probes, verified by exact cosine.

1. Equal vectors are one node, numbered in the order of the nodes' smallest ids.
2. Each table projects unit vectors to eight dimensions and decodes them to E8 lattice
   points. A vector is indexed under its own cell and probes the neighbouring cells that
   its residual leans to. Cells without an indexed vector and another one are dropped
   before vectors move.
3. Inside a cell, block by block, cosines are verified in double precision; a block
   returns a spanning forest of its links, never its pairs. Components of the forests
   are the classes.
4. Links lie inside components, so each component's cosines are taken once more, block
   by block, and every member gets its number of links.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, broadcast_if_small, components, cut, numbered, stored, whole_runs
from .shingles import mix64

THRESHOLD = 0.95
TABLES = 6
PROBES = 8
CELL = 0.15
BLOCK_ROWS = 8192
TILE = 1024
SEED = 20240411


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


ROOTS = roots()


def nearest_d8(y: np.ndarray) -> np.ndarray:
    f = np.rint(y)
    e = y - f
    odd = np.flatnonzero(f.sum(axis=1) % 2)
    k = np.abs(e[odd]).argmax(axis=1)
    f[odd, k] += np.where(e[odd, k] >= 0, 1, -1)
    return f


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Closest E8 points: the better of the two cosets of D8."""
    a, b = nearest_d8(y), nearest_d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


class Lattice:
    """Tables of random projections; keys of own and probed cells."""

    def __init__(self, dimensions: int, tables: int, cell: float, probes: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        width = max(dimensions, 8)
        self.bases = [np.linalg.qr(rng.standard_normal((width, 8)))[0][:dimensions] / cell for _ in range(tables)]
        self.shifts = rng.random((tables, 8))
        self.odd = (rng.integers(0, 1 << 62, 8) * 2 + 1).astype(np.uint64)
        self.probes = probes

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, 1 + probes) keys of unit vectors; the first is the vector's own cell."""
        out = np.empty((len(x), len(self.bases), 1 + self.probes), np.int64)
        step = (ROOTS * 2).astype(np.int64).astype(np.uint64) @ self.odd
        for t, (base, shift) in enumerate(zip(self.bases, self.shifts)):
            y = x @ base + shift
            c = nearest_e8(y)
            own = (c * 2).astype(np.int64).astype(np.uint64) @ self.odd
            lean = (y - c) @ ROOTS.T
            near = np.argpartition(-lean, self.probes, axis=1)[:, : self.probes]
            cells = np.concatenate([own[:, None], own[:, None] + step[near]], axis=1)
            out[:, t] = mix64(cells ^ mix64(np.full(1, t + 1, np.uint64))).view(np.int64)
        return out


def unit(raw: pa.Array, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), np.float64).reshape(-1, dimensions)


def _linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    return x @ y.T >= threshold


def cell_forest(x: np.ndarray, own: np.ndarray, side: np.ndarray, cross: np.ndarray, starts: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Spanning forest of the verified links inside runs of rows."""
    forest = Forest(len(x))
    size = np.diff(starts)
    small = np.repeat(size <= 64, size)
    run = np.repeat(np.arange(len(size)), size)
    for d in range(1, int(min(64, size.max(initial=0)))):
        i = np.flatnonzero((run[:-d] == run[d:]) & small[:-d])
        j = i + d
        ok = (own[i] | own[j]) & (~cross[i] | (side[i] != side[j]))
        i, j = i[ok], j[ok]
        for at in range(0, len(i), 1 << 16):
            p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            hit = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
            forest.add(p[hit], q[hit])
    for k in np.flatnonzero(size > 64):
        rows = np.arange(starts[k], starts[k + 1])
        for i in range(0, len(rows), TILE):
            for j in range(i, len(rows), TILE):
                a, b = rows[i : i + TILE], rows[j : j + TILE]
                hit = _linked(x[a], x[b], threshold) & (own[a][:, None] | own[b])
                if cross[a[0]]:
                    hit &= side[a][:, None] != side[b]
                p, q = np.nonzero(hit)
                forest.add(a[p], b[q])
    return forest.edges


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, cell: float = CELL, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept).

    `n_links` counts other rows whose cosine in double precision reaches the threshold,
    equal vectors among them; `component_id` is the smallest id reachable by links, itself
    included; `kept` marks it. Vectors that are null, empty or zero, or hold null or
    non-finite components, and rows with a null id link with nothing and are kept.
    Vectors of different lengths link with none of another length. Repeated rows are rows
    of their own, and so are unlike vectors under one id: each has its own links, and its
    component is named by the smallest id in it. An empty table gives an empty result;
    other columns are ignored, whatever their names.

    At the threshold itself a table finds a pair with a probability of about 0.82, six
    tables miss one in tens of thousands; closer pairs are missed less.
    """
    spark = table.sparkSession
    chosen = table.select(table[id_col].alias("id"), table[vector_col].alias("v"))
    kind = dict(chosen.dtypes)["id"]

    def prepare(batches):
        lattices: dict[int, Lattice] = {}
        for batch in batches:
            groups: dict[int, list] = {}
            for i, v in enumerate(batch.column("v").to_pylist()):
                if v and None not in v and batch.column("id")[i].is_valid:
                    x = np.asarray(v, np.float64) + 0.0
                    top = np.abs(x).max()
                    if np.isfinite(x).all() and top > 0:
                        groups.setdefault(len(x), []).append((i, x, top))
            rows, unit_bytes, d1, d2, keys = [], [], [], [], []
            for n, members in groups.items():
                x = np.stack([m[1] / m[2] for m in members])
                x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
                lattice = lattices.setdefault(n, Lattice(n, tables, cell, probes))
                rows += [m[0] for m in members]
                unit_bytes += [v.tobytes() for v in x]
                for m in members:
                    digest = xxhash.xxh3_128_intdigest(m[1].tobytes())
                    d1.append((digest >> 64) - (1 << 63))
                    d2.append((digest & (1 << 64) - 1) - (1 << 63))
                keys += list((lattice.keys(x) ^ n).reshape(len(x), -1))
            bad = [i for i in range(batch.num_rows) if i not in set(rows)]
            empty = [None] * len(bad)
            ids = batch.column("id").take(pa.array(rows + bad, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(d1 + empty, pa.int64()), pa.array(d2 + empty, pa.int64()), pa.array(unit_bytes + empty, pa.binary()), pa.array(keys + empty, pa.list_(pa.int64()))],
                names=["id", "d1", "d2", "x", "keys"],
            )

    rows = stored(chosen.mapInArrow(prepare, f"id {kind}, d1 bigint, d2 bigint, x binary, keys array<bigint>"))
    good = rows.where("d1 IS NOT NULL")
    nodes = numbered(good.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "id", "d1", "d2")
    heads = good.join(nodes.select("d1", "d2", "id", "node"), ["d1", "d2", "id"])
    # An id's repeated rows stand once.
    heads = stored(heads.dropDuplicates(["node"]).select(F.col("node").alias("rep"), "x", "keys"))
    listed = heads.select("rep", F.posexplode("keys").alias("place", "key"))
    listed = listed.select("rep", "key", (F.col("place") % (probes + 1) == 0).alias("own"))
    shared = listed.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.max("own").alias("own"), F.count(F.lit(1)).alias("n")).where("a < b AND own")
    shared = cut(shared.select("key", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(block_rows))).cast("int").alias("blocks")))
    members = listed.join(broadcast_if_small(shared), "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    vectors = heads.select("rep", "x")
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "own", "rep").join(vectors, "rep")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = ["key", "lo", "hi"]
    dealt = dealt.repartition(n, *sort).sortWithinPartitions(*sort)

    def verify(batches):
        for batch, starts in whole_runs(batches, sort):
            sizes = np.array([len(v) for v in batch.column("x").to_pylist()])
            rep, lo, hi = batch.column("rep"), batch.column("lo").to_numpy(), batch.column("hi").to_numpy()
            own, side = batch.column("own").to_numpy(zero_copy_only=False), batch.column("block").to_numpy()
            a, b = [], []
            # Runs of one key hold vectors of one length, as the length is part of the key.
            for size in np.unique(sizes):
                here = np.flatnonzero(sizes == size)
                run = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[here]
                bounds = np.append(np.flatnonzero(np.append(True, run[1:] != run[:-1])), len(here))
                x = unit(batch.column("x").take(pa.array(here)), int(size) // 8)
                for i, j in cell_forest(x, own[here], side[here], (lo != hi)[here], bounds, threshold):
                    a.append(int(here[i]))
                    b.append(int(here[j]))
            if a:
                yield pa.RecordBatch.from_arrays([rep.take(pa.array(a)), rep.take(pa.array(b))], names=["a", "b"])

    area = cut(components(dealt.mapInArrow(verify, "a bigint, b bigint")))
    sizes = area.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    inside = area.join(sizes, "component").withColumnRenamed("node", "rep").join(nodes.select(F.col("node").alias("rep"), "copies"), "rep").join(vectors, "rep")
    inside = inside.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(block_rows))).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    inside = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    inside = inside.select("component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "copies", "x")
    by = ["component", "lo", "hi"]
    inside = inside.repartition(n, *by).sortWithinPartitions(*by)

    def count(batches):
        for batch, starts in whole_runs(batches, by, 1 << 12):
            links = np.zeros(batch.num_rows, np.int64)
            copies = batch.column("copies").to_numpy()
            lo, hi, side = (batch.column(k).to_numpy() for k in ("lo", "hi", "block"))
            for s, e in zip(starts[:-1], starts[1:]):
                x = np.frombuffer(b"".join(batch.column("x").slice(s, e - s).to_pylist()), np.float64).reshape(e - s, -1)
                cross = lo[s] != hi[s]
                left = np.flatnonzero(side[s:e] == lo[s])
                right = np.flatnonzero(side[s:e] == hi[s])
                for i in range(0, len(left), TILE):
                    for j in range(0 if cross else i, len(right), TILE):
                        p, q = left[i : i + TILE], right[j : j + TILE]
                        hit = _linked(x[p], x[q], threshold)
                        if not cross and i == j:
                            np.fill_diagonal(hit, False)
                        links[s + p] += hit @ copies[s + q]
                        if cross or i != j:
                            links[s + q] += copies[s + p] @ hit
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(some)), pa.array(links[some])], names=["rep", "links"])

    links = inside.mapInArrow(count, "rep bigint, links bigint").groupBy("rep").agg(F.sum("links").alias("links"))
    named = nodes.join(links.withColumnRenamed("rep", "node"), "node", "left").join(area, "node", "left")
    least = nodes.select(F.col("node").alias("component"), F.col("id").alias("component_id"))
    named = named.withColumn("component", F.coalesce("component", "node")).join(least, "component")
    named = named.select("d1", "d2", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = good.select("id", "d1", "d2").join(named, ["d1", "d2"]).select("id", "n_links", "component_id")
    rest = rows.where("d1 IS NULL").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.expr("id <=> component_id").alias("kept"))
