"""Near-duplicate documents: Jaccard join on word shingles with Bayesian pruning.

1. Documents with the same shingle set form one node, numbered in the order of the nodes'
   smallest ids. MinHash values, banded, name candidates among nodes.
2. Candidates that share a band are linked to the band's smallest member (a star, not
   all pairs); components of these links bound where similar pairs can be.
3. Inside a component, block by block, MinHash values are compared a few at a time and
   a pair is dropped once the posterior probability of reaching the threshold falls
   below the tolerance; the rest is verified exactly on the shingle sets.
4. A block pair returns each member's number of links and a spanning forest, never its
   pairs; components of the forests are the classes.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, broadcast_if_small, components, cut, numbered, slices, stored
from .shingles import SIZE, shingles

THRESHOLD = 0.8
BANDS, ROWS = 32, 5
STEP = 16
TOLERANCE = 1e-6
BLOCK_BYTES = 32 << 20
TILE = 512

_rng = np.random.Generator(np.random.PCG64(20240229))
_A = (_rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)[:, None]


def signature(x: np.ndarray) -> np.ndarray:
    """MinHash values of a shingle set."""
    low = (x >> np.uint64(32)).astype(np.uint32) ^ x.astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1024):
        np.minimum(out, (_A * low[None, i : i + 1024] + _B).min(axis=1), out=out)
    return out


def bands(sig: np.ndarray) -> list[int]:
    rows = sig.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(rows[i].tobytes(), seed=i) - (1 << 63) for i in range(BANDS)]


def digest(x: np.ndarray) -> tuple[int, int]:
    """128 bits of a shingle set in two halves."""
    value = xxhash.xxh3_128_intdigest(x.tobytes())
    return (value >> 64) - (1 << 63), (value & (1 << 64) - 1) - (1 << 63)


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float, n: int) -> int:
    """Fewest matches of `n` values at which P(similarity >= threshold), from a uniform prior, reaches the tolerance."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def survivors(a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Pairs (i, j) of two signature tables that no step prunes."""
    n, alive = 0, np.ones((len(a), len(b)), bool)
    matches = np.zeros((len(a), len(b)), np.int16)
    # While much of the tile is alive, whole columns are compared; then only the pairs left.
    while n < a.shape[1] and np.count_nonzero(alive) * 16 > alive.size:
        for k in range(n, n + STEP):
            matches += a[:, k, None] == b[None, :, k]
        n += STEP
        alive &= matches >= least_matches(threshold, tolerance, n)
    pairs = np.argwhere(alive)
    count = matches[alive].astype(np.int64)
    while n < a.shape[1] and len(pairs):
        count = count + (a[pairs[:, 0], n : n + STEP] == b[pairs[:, 1], n : n + STEP]).sum(axis=1)
        n += STEP
        keep = count >= least_matches(threshold, tolerance, n)
        pairs, count = pairs[keep], count[keep]
    return pairs


def link_block(sets: list[np.ndarray], sigs: np.ndarray, weight: np.ndarray, side: np.ndarray, cross: bool, threshold: float, tolerance: float):
    """Links among members (or, if `cross`, between the two sides): weighted link counts and forest edges.

    sets: sorted distinct hashes; weight: documents a member stands for.
    """
    n = len(sets)
    links = np.zeros(n, np.int64)
    forest = Forest(n)
    left = np.flatnonzero(side == 0) if cross else np.arange(n)
    right = np.flatnonzero(side == 1) if cross else left
    sizes = np.array([len(s) for s in sets])
    ids = None
    for i in range(0, len(left), TILE):
        for j in range(0 if cross else i, len(right), TILE):
            a, b = left[i : i + TILE], right[j : j + TILE]
            pairs = survivors(sigs[a], sigs[b], threshold, tolerance)
            if not cross and i == j:
                pairs = pairs[pairs[:, 0] < pairs[:, 1]]
            if not len(pairs):
                continue
            if len(pairs) > 256:
                if ids is None:  # number the hashes that two members share
                    flat = np.concatenate(sets)
                    known, ids = np.unique(flat, return_inverse=True)
                    ids = np.where(np.bincount(ids, minlength=len(known))[ids] > 1, ids, -1)
                    bounds = np.concatenate([[0], np.cumsum(sizes)])
                inter = _dense([ids[bounds[x] : bounds[x + 1]] for x in a], [ids[bounds[x] : bounds[x + 1]] for x in b])[pairs[:, 0], pairs[:, 1]]
            else:
                inter = np.array([len(np.intersect1d(sets[a[x]], sets[b[y]], assume_unique=True)) for x, y in pairs])
            union = sizes[a[pairs[:, 0]]] + sizes[b[pairs[:, 1]]] - inter
            found = pairs[inter / union >= threshold]
            links[a] += np.bincount(found[:, 0], weights=weight[b[found[:, 1]]], minlength=len(a)).astype(np.int64)
            links[b] += np.bincount(found[:, 1], weights=weight[a[found[:, 0]]], minlength=len(b)).astype(np.int64)
            forest.add(a[found[:, 0]], b[found[:, 1]])
    return links, forest.edges


def _dense(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of id sets (-1: shared with none)."""
    flat = np.concatenate([*left, *right])
    used = np.unique(flat[flat >= 0])
    out = np.zeros((len(left), len(right)), np.float32)
    width = max(1, (64 << 20) // (4 * (len(left) + len(right))))
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    col = np.searchsorted(used, flat)
    for at in range(0, len(used), width):
        here = (flat >= 0) & (col >= at) & (col < at + width)
        grid = np.zeros((len(left) + len(right), min(width, len(used) - at)), np.float32)
        grid[row[here], col[here] - at] = 1
        out += grid[: len(left)] @ grid[len(left) :].T
    return np.rint(out).astype(np.int64)


def sketch(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, d1, d2, n, bands): the set's digest in two halves, its size and its band hashes."""
    chosen = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = dict(chosen.dtypes)["id"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                d1, d2, n, keys = [], [], [], []
                for text in part.column("text").to_pylist():
                    x = shingles(text, size)
                    high, low = digest(x)
                    d1.append(high)
                    d2.append(low)
                    n.append(len(x))
                    keys.append(bands(signature(x)) if len(x) else [])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "d1", "d2", "n", "bands"])

    return chosen.mapInArrow(run, f"id {kind}, d1 bigint, d2 bigint, n bigint, bands array<bigint>")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, size: int = SIZE, tolerance: float = TOLERANCE, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, class_id, n_links, kept).

    Two documents are linked when the Jaccard similarity of their shingle sets reaches
    the threshold; `n_links` counts other rows linked directly, copies among them;
    `class_id` is the smallest id reachable by links, itself included; `kept` marks it.
    Texts that are null or hold no word link with nothing; rows with a null id are
    returned with a null class, no links and kept. Repeated rows are rows of their own
    (all of a kept id are marked), and so are unlike texts under one id: each has its own
    links, and its class is named by the smallest id in it. Whole texts of any length are
    read. An empty table gives an empty result; columns besides id and text are ignored,
    whatever their names.
    """
    spark = docs.sparkSession
    rows = stored(sketch(docs, size, id_col, text_col))
    full = rows.where("n > 0 AND id IS NOT NULL")
    groups = full.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"))
    groups = numbered(groups, "id", "d1", "d2")
    heads = full.join(groups.select("d1", "d2", "id", "node"), ["d1", "d2", "id"])
    keys = heads.select("node", F.explode("bands").alias("key"))
    leaders = keys.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("other")).where("leader < other").select("key", "leader")
    candidates = keys.join(leaders, "key").where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    area = components(candidates)
    members = area.join(groups, "node")
    sizes = members.groupBy("component").agg(F.sum(F.col("n") * 8 + 4 * BANDS * ROWS).alias("bytes"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.lit(block_bytes))).cast("int")
    members = cut(members.join(sizes, "component").select("id", "d1", "d2", F.col("node").alias("rep"), "component", "copies", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block")))

    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(broadcast_if_small(members), "id").drop("id")

    def prepare(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingles(t, size) for t in part.column("text").to_pylist()]
                # Other texts under the id are other nodes, or none.
                own = [i for i, (x, d1, d2) in enumerate(zip(sets, part.column("d1").to_pylist(), part.column("d2").to_pylist())) if digest(x) == (d1, d2)]
                made = [pa.array([signature(sets[i]).tobytes() for i in own], pa.binary()), pa.array([sets[i].tobytes() for i in own], pa.binary())]
                at = pa.array(own, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(k).take(at) for k in ("rep", "component", "copies", "blocks", "block")] + made, names=["rep", "component", "copies", "blocks", "block", "sig", "items"])

    ready = texts.mapInArrow(prepare, "rep bigint, component bigint, copies bigint, blocks int, block int, sig binary, items binary")
    dealt = ready.select("rep", "component", "copies", "block", "sig", "items", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.col("block").alias("side"), "rep", "copies", "sig", "items")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")

    def compare(batches):
        def finish(held):
            batch = pa.Table.from_batches(held).combine_chunks()
            rep, copies = batch.column("rep").to_pylist(), batch.column("copies").to_numpy()
            # A row that is in the table twice under one id stands once: its copies are counted already.
            first = list({r: i for i, r in reversed(list(enumerate(rep)))}.values())
            rep, copies = [rep[i] for i in first], copies[first]
            if len(rep) < 2:
                return
            sig, items = batch.column("sig").to_pylist(), batch.column("items").to_pylist()
            sigs = np.stack([np.frombuffer(sig[i], np.uint32) for i in first])
            sets = [np.frombuffer(items[i], np.uint64) for i in first]
            lo, hi = batch.column("lo")[0].as_py(), batch.column("hi")[0].as_py()
            side = (batch.column("side").to_numpy()[first] == hi).astype(np.int8)
            links, edges = link_block(sets, sigs, copies, side, lo != hi, threshold, tolerance)
            some = np.flatnonzero(links)
            a = [rep[i] for i in some] + [rep[i] for i, _ in edges]
            b = [None] * len(some) + [rep[j] for _, j in edges]
            w = [int(links[i]) for i in some] + [0] * len(edges)
            if a:
                kind_a = batch.schema.field("rep").type
                yield pa.RecordBatch.from_arrays([pa.array(a, kind_a), pa.array(b, kind_a), pa.array(w, pa.int64())], names=["a", "b", "w"])

        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(k).to_pylist() for k in ("component", "lo", "hi"))))
            start = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start]:
                    if held and key != keys[start]:
                        yield from finish(held)
                        held = []
                    key = keys[start]
                    held.append(batch.slice(start, i - start))
                    start = i
        if held:
            yield from finish(held)

    found = cut(dealt.mapInArrow(compare, "a bigint, b bigint, w bigint"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("linked"))
    classes = components(found.where("b IS NOT NULL"))
    least = groups.select(F.col("node").alias("component"), F.col("id").alias("class_id"))
    named = groups.join(counts, "node", "left").join(classes, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node")).join(least, "component")
    named = named.select("d1", "d2", "class_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    out = full.select("id", "d1", "d2").join(named, ["d1", "d2"]).select("id", "class_id", "n_links")
    rest = rows.where("NOT (n > 0 AND id IS NOT NULL)").select("id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return out.unionByName(rest).select(F.col("id").alias(id_col), "class_id", "n_links", F.expr("id <=> class_id").alias("kept"))
