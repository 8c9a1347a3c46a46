"""Best-fit packing of tokenised documents into sequences of bounded length.

Bulk-synchronous best-fit, all of it in tasks:

1. Pieces are range-sorted by length and ranked; the rank decides which shard a piece
   competes in (rank modulo the number of shards), so that every shard holds the same mix
   of lengths. With an order column, shards are windows of that order instead.
2. Each shard sweeps its pieces from the longest down; a piece takes its successor, the
   tightest gap that holds it, or opens a sequence, and the gap is updated. Equal pieces
   contest one gap by rank and move as a run.
3. A shard lets go of its emptiest sequences, if they have room. Their pieces are sorted and dealt again, to
   a `FAN`-th of the shards, and the superstep repeats until one shard is left.

A shard holds `SHARD_ROWS` narrow rows whatever the corpus holds; the driver only sees the
number of rows of each partition.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, fresh, slices, stored, whole_runs

CAPACITY = 2048
END_ID = 0
LONG_RUN = 1000
#: Pieces (or, with an order column, documents) of a shard.
SHARD_ROWS = 1 << 14
#: Shards that are merged into one from a superstep to the next, and sequences that each lets go of.
FAN = 16
#: A sequence is let go of if this part of it is empty at least.
LOOSE = 16


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> uint32 ids, equal to the tokenizer file's own.

    The same vocabulary runs through tiktoken, which is several times faster; texts with
    a special token's string or very long unbroken runs go through tokenizers itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = [t["content"] for t in spec.get("added_tokens", [])]
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    blank = re.compile(rf"\s{{{LONG_RUN}}}")

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special) or (len(text) > LONG_RUN and (max(map(len, text.split()), default=0) > LONG_RUN or blank.search(text))):
            return np.array(own.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(fast._core_bpe.encode_ordinary(text), dtype="<u4")

    return encode


def tokenise(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """Pieces of at most `capacity` tokens: (doc_id, piece, start, length, ids_crc32[, ids][, order]).

    A document is its text's ids and `end_id`; null texts count as empty, so each row
    gives one piece at least. A longer document's first piece takes the remainder.
    """
    path = tokenizer or default_tokenizer()
    more = ["order"] if order_col else []
    chosen = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"), *([docs[order_col].cast("bigint").alias("order")] if order_col else []))
    kind = dict(chosen.dtypes)["doc"]

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                rows, pieces, starts, lengths, crcs, held = [], [], [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = np.append(encode(text) if text else np.zeros(0, "<u4"), np.array([end_id], "<u4")).astype("<u4")
                    n = len(ids)
                    cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                    raw = ids.tobytes()
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append(i)
                        pieces.append(k)
                        starts.append(a)
                        lengths.append(b - a)
                        crcs.append(zlib.crc32(raw[4 * a : 4 * b]))
                        if keep_ids:
                            held.append(raw[4 * a : 4 * b])
                at = pa.array(rows, pa.int64())
                arrays = [part.column("doc").take(at), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
                arrays += [pa.array(held, pa.binary())] * keep_ids + [part.column(c).take(at) for c in more]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids + more)

    out = chosen.mapInArrow(run, f"doc {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids + ", order bigint" * len(more))
    return out.withColumnRenamed("doc", id_col)


def supersteps(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Placements of runs: rows (length, rank from, first sequence, pieces a sequence, offset), sorted.

    The piece of rank r in [rank from, next rank from) goes to sequence
    first + (r - rank from) // k at offset + length * ((r - rank from) % k).
    """
    gaps: list[int] = []  # sorted sizes of open gaps
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, sequences)
    opened, plan = 0, []

    def put(gap: int, first: int, n: int) -> None:
        if gap <= 0 or n <= 0:
            return
        if gap not in runs:
            bisect.insort(gaps, gap)
            runs[gap] = []
        runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:
                gap, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            k = gap // length
            full, rest = min(n, left // k), 0
            if full < n:
                rest = left - full * k if left - full * k < k else 0
            plan.append((length, rank, first, k, capacity - gap))
            moved = full * k + rest
            left, rank = left - moved, rank + moved
            # Equal pieces may go on into what the same sequences still have: the gap left is shorter than a piece.
            put(gap - k * length, first, full)
            if rest:
                put(gap - rest * length, first + full, 1)
            put(gap, first + full + bool(rest), n - full - bool(rest))
    out = np.array(plan, dtype=np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def _ranked(rows: DataFrame, keys: list, rank: str) -> tuple[DataFrame, int]:
    """Rows range-sorted by the keys with their rank, and their number."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys))
    part = F.spark_partition_id()
    held = rows.groupBy(part.alias("p")).count().orderBy("p").collect()
    begins = spark.sparkContext.broadcast(dict(zip((r["p"] for r in held), np.cumsum([0] + [r["count"] for r in held]).tolist())))

    def run(batches):
        at = begins.value.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + batch.num_rows))], names=[*batch.schema.names, rank])
            at += batch.num_rows

    fields = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, `{rank}` bigint"), sum(r["count"] for r in held)


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length", tie_cols: tuple[str, ...] = ("doc_id", "piece"), order_col: str | None = None, shard_rows: int = SHARD_ROWS, fan: int = FAN) -> DataFrame:
    """Adds `sequence_id` and `offset` to pieces whose lengths are from 1 to `capacity`.

    Sequences have no gaps between pieces. With `order_col` (places of the documents from
    0), shards are windows of `shard_rows` places and sequence ids grow with the windows,
    so that reading sequences by id keeps the documents' order window by window; without
    it, ids mean nothing. Extra columns pass, whatever their names (`sequence_id` and
    `offset` are replaced); repeated rows are placed each; ties are free; an empty table
    gives an empty result; lengths out of range and null lengths raise an error. `pieces`
    should be materialised, as it is read for sampling and again for sorting.
    """
    spark = pieces.sparkSession
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rank, shard, mixed, opened, sequence, place = fresh([*pieces.columns, "sequence_id", "offset"], "rank", "shard", "mixed", "opened", "sequence", "place")
    bad = pieces.where(F.col(length_col).isNull() | ~F.col(length_col).between(1, capacity))
    if not bad.isEmpty():
        raise ValueError(f"lengths must be from 1 to {capacity}")
    left, done, level = pieces.select(*columns, F.xxhash64(*tie_cols).alias(mixed)), [], 0
    kinds = dict(left.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in [*columns, mixed])
    total = None
    while True:
        if order_col and level == 0:
            total = (pieces.agg(F.max(order_col)).first()[0] or 0) + 1
            rows = left.withColumn(shard, F.floor(F.col(order_col) / F.lit(shard_rows)).cast("bigint"))
        elif order_col:
            rows = left.withColumn(shard, F.floor(F.col(shard) / F.lit(fan)).cast("bigint"))
        else:
            rows, n = _ranked(left.drop(shard), [F.col(length_col).desc(), mixed], rank)
            total = n if total is None else total
            rows = rows.withColumn(shard, F.pmod(F.col(rank), F.lit(max(1, -(-total // (shard_rows * fan**level)))))).drop(rank)
        shards = max(1, -(-total // (shard_rows * fan**level)))
        step, last = level, shards == 1
        parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), shards))
        dealt = rows.select(*columns, mixed, shard).repartition(parts, shard).sortWithinPartitions(shard, F.col(length_col).desc(), mixed)

        def run(batches, step=step, last=last):
            for batch, starts in whole_runs(batches, [shard], 1):
                for a, b in zip(starts[:-1], starts[1:]):
                    part = batch.slice(int(a), int(b - a))
                    seq, offset, loose = sweep(part.column(length_col).to_numpy(zero_copy_only=False).astype(np.int64), capacity, 0 if last else fan)
                    first = int(part.column(shard)[0].as_py()) * fan**step
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array((first << 26) + (step << 22) + seq), pa.array(offset), pa.array(loose)], names=[*part.schema.names, sequence, place, opened])

        placed = stored(dealt.mapInArrow(run, f"{fields}, `{shard}` bigint, `{sequence}` bigint, `{place}` bigint, `{opened}` boolean"))
        done.append(placed.where(~F.col(opened)).select(*columns, F.col(sequence).alias("sequence_id"), F.col(place).alias("offset")))
        if last:
            return reduce(DataFrame.unionByName, done)
        left, level = placed.where(F.col(opened)).select(*columns, mixed, shard), level + 1


def sweep(lengths: np.ndarray, capacity: int, release: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit of lengths that are sorted downwards: sequence and offset of each, and whether it is in one of the `release` emptiest sequences."""
    sizes, counts = np.unique(lengths, return_counts=True)
    table = supersteps(dict(zip(sizes.tolist(), counts.tolist())), capacity)
    first = np.searchsorted(-lengths, -lengths)
    rank = np.arange(len(lengths)) - first
    keys = table[:, 0] * (1 << 32) + table[:, 1]
    _, begin, opened, k, offset = table[np.searchsorted(keys, lengths * (1 << 32) + rank, side="right") - 1].T
    q, r = np.divmod(rank - begin, k)
    sequence = opened + q
    loose = np.zeros(len(lengths), bool)
    if release and len(lengths):
        held = np.bincount(sequence, lengths)
        emptiest = np.argsort(held, kind="stable")[:release]
        loose = np.isin(sequence, emptiest[held[emptiest] <= capacity - capacity // LOOSE])
    return sequence, offset + r * lengths, loose


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None, **options) -> DataFrame:
    """Tokenise, cut and place documents: one row per piece with its place.

    Null and empty texts are a sequence's single end id; very long texts are cut; ties
    and repeated rows are placed each; an empty table gives an empty result; columns
    besides id, text and order are ignored, whatever their names. With `order_col`, see `pack`.
    """
    pieces = stored(tokenise(docs, tokenizer, capacity, end_id, keep_ids, id_col, text_col, order_col))
    placed = pack(pieces, capacity, tie_cols=(id_col, "piece"), order_col="order" if order_col else None, **options)
    return placed.drop("order") if order_col else placed


def file_order(docs: DataFrame, name: str) -> DataFrame:
    """Rows of a frame that reads files, with their place (from 0) by file name and row: the order in which a sorted frame was written.

    Rows of a frame that doesn't read files get places by a hash of their values.
    """
    path, row, begin = fresh([*docs.columns, name], "path", "row", "begin")
    try:
        rows = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(row))
    except AnalysisException:
        return docs.withColumn(name, F.pmod(F.xxhash64(*docs.columns), F.lit(max(1, docs.count()))))
    held = {r[0]: r[1] for r in rows.groupBy(path).count().collect()}
    names = sorted(held, key=lambda x: (len(x), x))
    places = np.cumsum([0] + [held[x] for x in names]).tolist()
    spark = docs.sparkSession
    begins = spark.createDataFrame(list(zip(names, places)), f"`{path}` string, `{begin}` bigint")
    return rows.join(broadcast_if_small(begins), path).withColumn(name, F.col(begin) + F.col(row)).drop(path, row, begin)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves (sequence_id, ids) from pieces packed with keep_ids."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
