"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session gets one of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="sparkseek-checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame reliably and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in the store that Spark writes to."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may have ended already
        pass


def stored(df: DataFrame) -> DataFrame:
    """Write a wide frame as Parquet in the shared folder and read it back.

    Smaller than a checkpoint and readable by column; removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a frame that `stored` returned, once nothing will read it again."""
    _forget(df.sparkSession, df.stored_at)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of frames that nothing refers to any more removed now.

    Spark removes them once the driver has collected its garbage, by itself every half hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_libc = ctypes.CDLL(None)


def settle() -> None:
    """Give freed memory back to the system: workers live on between tasks, and an executor's share is fixed."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20):
    """Cut a batch into runs of rows whose texts hold about `limit` bytes; a longer row stands alone."""
    values = batch.column(column)
    if not batch.num_rows:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    yield batch.slice(start)
    settle()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of a graph given by its edges: (node, component), component = smallest node.

    Alternating large-star and small-star passes: each round is two grouped minima
    and two equi-joins, never a gathered neighbourhood, so a node of any degree is
    fine (adaptive execution splits a hot join key). Rounds grow with the logarithm
    of a component's size. Nodes without an edge to another node aren't returned.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        # e: distinct (u, v) with u > v.
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y"))
        if large:
            both = both.unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        linked = both.join(least, "x")
        if large:
            out = linked.where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        else:
            out = linked.select(F.col("y").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
        return out.where("u > v").distinct()

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = cut(e)
    mark = None
    while True:
        e = cut(star(star(e, True), False))
        new = e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if new == mark:
            break
        mark = new
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return nodes.unionByName(roots)


#: Bytes up to which a narrow table is broadcast; beyond it joins shuffle.
BROADCAST_BYTES = 32 << 20
#: Bytes that a row takes besides its values, in a broadcast hash table.
ROW_BYTES = 24


def broadcast_if_small(narrow: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of a materialised frame, only if its measured bytes allow it.

    Numbers count eight bytes; strings, binaries and arrays (of numbers or narrow structs)
    count their summed lengths.
    """
    width, sums = ROW_BYTES, []
    for name, kind in narrow.dtypes:
        column = F.col(f"`{name}`")
        width += 8
        if kind in ("string", "binary"):
            sums.append(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)))
        elif kind.startswith("array"):
            sums.append(F.coalesce(F.sum(F.size(column).cast("bigint")), F.lit(0)) * 8 * (1 + kind.count(":")))
    measured = narrow.agg(F.count(F.lit(1)) * width + sum(sums, F.lit(0))).first()[0]
    return F.broadcast(narrow) if measured <= limit else narrow


def fresh(taken, *names: str) -> list[str]:
    """Inner column names that no column of the input has, whatever its case."""
    held, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def numbered(nodes: DataFrame, id_col: str, *more: str) -> DataFrame:
    """Nodes with a `node` number that grows with their id, then with the other columns.

    Ids can stand for several nodes; the numbers can't, and the smallest number of a set of
    nodes belongs to its smallest id. Numbers are the places after a range sort, written
    before they are used, so they are the same however often tasks run again.
    """
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = nodes.repartitionByRange(n, id_col, *more).sortWithinPartitions(id_col, *more)
    return cut(placed.withColumn("node", F.monotonically_increasing_id()))


def whole_runs(batches, keys: list[str], rows: int = 1 << 14):
    """Join sorted batches into tables of about `rows` rows that never end inside a run of equal keys.

    Yields (batch, starts): the first row of each run and the number of rows.
    """
    held: list[pa.RecordBatch] = []

    def starts_of(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, bool)
        new[:1] = True
        for k in keys:
            column = batch.column(k)
            new[1:] |= np.asarray(pc.fill_null(pc.not_equal(column[1:], column[:-1]), True))
        return np.append(np.flatnonzero(new), batch.num_rows)

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        whole = joined()
        starts = starts_of(whole)
        if len(starts) > 2:
            yield whole.slice(0, int(starts[-2])), starts[:-1]
            held = [whole.slice(int(starts[-2]))]
        else:
            held = [whole]
    if held:
        whole = joined()
        yield whole, starts_of(whole)
    settle()


class Forest:
    """Connected components of local indices from arrays of links; keeps the edges that joined trees."""

    def __init__(self, n: int):
        self.label, self.edges = np.arange(n), []

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        """Join the trees of left[k] and right[k], for all k at once.

        Each root hooks to its smallest neighbour below it, so that only roots without a
        smaller neighbour stay: at least half of those with links go in a round.
        """
        at, own = np.arange(len(left)), np.arange(len(self.label))
        a, b = self.label[left], self.label[right]
        while True:
            new = np.flatnonzero(a != b)
            if not len(new):
                return
            at, a, b = at[new], a[new], b[new]
            high, low = np.maximum(a, b), np.minimum(a, b)
            up, by = own.copy(), np.empty(len(own), np.int64)
            np.minimum.at(up, high, low)
            least = np.flatnonzero(up[high] == low)
            by[high[least]] = at[least]
            joined = by[np.flatnonzero(up != own)]
            self.edges += zip(left[joined].tolist(), right[joined].tolist())
            while True:
                further = up[up]
                if (further == up).all():
                    break
                up = further
            self.label = up[self.label]
            a, b = up[a], up[b]
