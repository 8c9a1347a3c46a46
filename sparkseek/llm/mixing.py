"""Mixing sources to target weights by proportionate-fair scheduling.

Each source's documents form blocks. In the ideal (fluid) mixture every source that has
blocks left is served in proportion to its weight at every moment. A block's release time
is the slot in which its ideal service begins, its deadline the slot by which it ends;
slots go to the released block with the earliest deadline, which keeps every source
within less than one block of its ideal service at every slot. When a source runs out,
the others' ideal shares grow, so no document is dropped and none is repeated.

Weights are exact fractions. Whom a slot goes to depends on all slots before, so one task
sweeps over the blocks (not the rows: one step for each `block_rows` documents), holds a
few numbers for each source and streams the schedule out; rows meet it by a join. Sorting
rows and placing them is spread over all tasks.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, fresh, stored

BLOCK_ROWS = 64
STREAM_ROWS = 1 << 16


class Fluid:
    """Ideal service of sources in proportion to their weights, until each one's blocks run out.

    Time counts slots. Sources run out in the order of blocks / weight, their virtual time;
    between two such times the total service is a line, so that windows have a closed form.
    """

    def __init__(self, blocks: list[int], weights: list[Fraction]):
        scale = math.lcm(*(w.denominator for w in weights))
        self.blocks, self.parts = blocks, [int(w * scale) for w in weights]
        self.ends = sorted(Fraction(n, p) for n, p in zip(blocks, self.parts))
        self.total = sum(blocks)
        # Up to ends[k]: gone[k] blocks of sources that ran out, rate[k] parts of the others.
        self.gone, self.rate = [], []
        gone, rate = 0, sum(self.parts)
        for s in sorted(range(len(blocks)), key=lambda s: Fraction(blocks[s], self.parts[s])):
            self.gone.append(gone)
            self.rate.append(rate)
            gone, rate = gone + blocks[s], rate - self.parts[s]

    def line(self, i: int, p: int, k: int = 0) -> int:
        """The line that holds virtual time i / p, from the k-th on."""
        end = self.ends[k]
        if i * end.denominator <= end.numerator * p:
            return k
        return min(bisect_left(self.ends, Fraction(i, p), k), len(self.ends) - 1)

    def sweep(self):
        """(source, block) arrays of the slots: earliest deadline first among released blocks."""
        taken, at = [0] * len(self.parts), [0] * len(self.parts)
        waiting = [(0, s) for s in range(len(self.parts))]
        ready: list[tuple[int, int]] = []
        sources, blocks = array("q"), array("q")
        for t in range(self.total):
            while waiting and waiting[0][0] <= t:
                s = heapq.heappop(waiting)[1]
                i, p = taken[s] + 1, self.parts[s]
                k = at[s] = self.line(i, p, at[s])
                heapq.heappush(ready, (self.gone[k] - -i * self.rate[k] // p, s))
            s = heapq.heappop(ready)[1]
            sources.append(s)
            blocks.append(taken[s])
            taken[s] += 1
            if taken[s] < self.blocks[s]:
                # The line of this block's end is that of the next one's beginning.
                k = at[s]
                heapq.heappush(waiting, (self.gone[k] + taken[s] * self.rate[k] // self.parts[s], s))
            if len(sources) == STREAM_ROWS:
                yield np.array(sources), np.array(blocks)
                del sources[:], blocks[:]
        if sources:
            yield np.array(sources), np.array(blocks)


def plan(blocks: list[int], weights: list[float]) -> list[tuple[int, list[int], Fluid]]:
    """(first slot, sources, their ideal service): weighted sources first, then those of weight zero in equal shares."""
    out, begin = [], 0
    for some, own in (([s for s, w in enumerate(weights) if w > 0 and blocks[s]], True), ([s for s, w in enumerate(weights) if not w > 0 and blocks[s]], False)):
        if some:
            out.append((begin, some, Fluid([blocks[s] for s in some], [Fraction(weights[s]) if own else Fraction(1) for s in some])))
            begin += out[-1][2].total
    return out


def default_weights(counts: dict) -> dict:
    """Square roots of the sources' counts: small sources weigh more than their rows."""
    return {s: float(n) ** 0.5 for s, n in counts.items()}


def mix(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Schedules every row: (doc_id, source, block, slot, position).

    Within a source rows are in a seeded hash order; `block` counts its blocks, `slot`
    is the block's place in the mixture, `position` the row's own, from 0 without gaps.
    `weights` maps sources to target weights, the square roots of their counts if not
    given; sources not named or of weight zero come last, in equal shares. A null source
    is a source of its own; null ids and repeated rows are scheduled each; texts aren't
    read; an empty table gives an empty result; other columns are ignored, whatever their
    names. Collected: one count for each source and each border of a partition, and each
    source's last slot.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source")).withColumn("mix", F.xxhash64("id", F.lit(seed)))
    rows = cut(rows.repartitionByRange(n, "source", "mix", "id").sortWithinPartitions("source", "mix", "id").select("id", "source"))
    counts: dict = {}
    begins: dict = {}
    for p, s, c in rows.groupBy(F.spark_partition_id().alias("p"), "source").count().orderBy("p").collect():
        begins[p, s] = counts.get(s, 0)
        counts[s] = counts.get(s, 0) + c
    names = sorted(counts, key=lambda s: (s is not None, s or ""))
    given = weights if weights is not None else default_weights(counts)
    parts = plan([-(-counts[s] // block_rows) for s in names], [float(given.get(s, 0)) for s in names])
    made = spark.sparkContext.broadcast((parts, np.array([counts[s] for s in names], np.int64)))

    def sweep(batches):
        plans, held = made.value
        for _ in batches:
            for slot, some, fluid in plans:
                some = np.array(some, np.int64)
                for source, block in fluid.sweep():
                    source = some[source]
                    rest = held[source] - (block + 1) * block_rows
                    yield pa.RecordBatch.from_arrays([pa.array(source), pa.array(block), pa.array(slot + np.arange(len(block))), pa.array(np.minimum(rest, 0))], names=["number", "block", "slot", "short"])
                    slot += len(block)

    schedule = stored(spark.range(0, 1, 1, 1).mapInArrow(sweep, "number bigint, block bigint, slot bigint, short bigint"))
    # Only a source's last block can be short of rows.
    short = sorted((r["slot"], -r["short"]) for r in schedule.where("short < 0").select("slot", "short").collect())
    fills = spark.sparkContext.broadcast((begins, {s: i for i, s in enumerate(names)}, np.array([x[0] for x in short], np.int64), np.concatenate([[0], np.cumsum([x[1] for x in short])]).astype(np.int64)))
    kind = dict(rows.dtypes)["id"]

    def begin_blocks(batches):
        _, _, ends, missing = fills.value
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("number"), batch.column("block"), batch.column("slot"), pa.array(slot * block_rows - missing[np.searchsorted(ends, slot)])], names=["number", "block", "slot", "begin"])

    def rank(batches):
        begin, number, _, _ = fills.value
        me, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            coded = batch.column("source").dictionary_encode()
            codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            place, of = np.empty(len(codes), np.int64), np.empty(len(codes), np.int64)
            for code in np.unique(codes):
                s = coded.dictionary[int(code)].as_py() if code >= 0 else None
                here = np.flatnonzero(codes == code)
                place[here] = begin[me, s] + seen.get(s, 0) + np.arange(len(here))
                of[here] = number[s]
                seen[s] = seen.get(s, 0) + len(here)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), pa.array(of), pa.array(place // block_rows), pa.array(place % block_rows)], names=["id", "source", "number", "block", "within"])

    ranked = rows.mapInArrow(rank, f"id {kind}, source string, number bigint, block bigint, within bigint")
    placed = schedule.mapInArrow(begin_blocks, "number bigint, block bigint, slot bigint, begin bigint")
    out = ranked.join(placed, ["number", "block"]).select("id", "source", "block", "slot", (F.col("begin") + F.col("within")).alias("position"))
    return out.withColumnsRenamed({"id": id_col, "source": source_col})


def mixed(docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The same rows and columns in the order of the mixture: range-partitioned and sorted by position.

    Rows that share an id take its first position; null ids share one. Null and empty texts,
    repeated rows and columns of any name pass; an empty table gives an empty result.
    """
    key, place = fresh(docs.columns, "mixed_id", "mixed_position")
    places = mix(docs, weights, id_col=id_col, source_col=source_col, **options)
    places = places.groupBy(F.col(id_col).alias(key)).agg(F.min("position").alias(place))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = docs.join(broadcast_if_small(cut(places)), docs[id_col].eqNullSafe(F.col(key)), "left")
    return joined.repartitionByRange(n, place).sortWithinPartitions(place).select(*[docs[c] for c in docs.columns])
