"""Line deduplication: exact copies by hash, near copies by a segment-partition edit join.

Lines within `max_edits` of each other share one of max_edits + 1 segments, shifted by
no more than the edits before and after it allow. Each line is indexed by its segments
and probes for those of lines that are shorter by up to `max_edits` (its length, the
segment's number and the substring make the key). Keys that only one line has are
dropped before anything wide moves. What is left is verified by a banded bit-parallel
edit distance over many pairs at once.

Equal lines are found whatever their length. Near lines have `MIN_CHARS` code points at
least, so that two edits are a tenth of a line at most: among shorter lines such
neighbours are mostly other words or numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, fresh, slices, stored
from .shingles import mix64

MAX_EDITS = 2
#: Fewest code points of a line in the edit join.
MIN_CHARS = 20
#: Lines that a task remembers to have given keys for; it may give them again after so many others.
REMEMBERED = 1 << 18
BLOCK_ROWS = 2048
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def split_lines(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lines and each line's first place."""
    flat = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)


def segment_keys(lines: list[str], edits: int = MAX_EDITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, whether the key is the line's own segment) for all lines' probes and segments.

    Lines must be longer than `edits`.
    """
    flat, bounds = codes(lines)
    n = np.diff(bounds)
    power = np.cumprod(np.full(len(flat) + 1, _BASE, np.uint64)) * _INVERSE
    back = np.cumprod(np.full(len(flat) + 1, _INVERSE, np.uint64)) * _BASE
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(mix64(flat.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    of, keys, own = [], [], []
    rows = np.arange(len(lines))
    parts = edits + 1
    for less in range(edits + 1):  # the indexed line is shorter by this
        size = n - less
        for i in range(parts):
            width = size // parts + (i >= parts - size % parts)
            start = (size // parts) * i + np.maximum(0, i - (parts - size % parts))
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                at = start + shift
                ok = (size > edits) & (width > 0) & (at >= 0) & (at + width <= n)
                a = bounds[:-1][ok] + at[ok]
                value = (total[a + width[ok]] - total[a]) * back[a]
                keys.append(mix64(value ^ mix64((size[ok] * parts + i).astype(np.uint64) + np.uint64(0xABCD))))
                of.append(rows[ok])
                own.append(np.full(len(a), less == 0 and shift == 0))
    return np.concatenate(of), np.concatenate(keys).view(np.int64), np.concatenate(own)


def within(left: list[np.ndarray], right: list[np.ndarray], edits: int) -> np.ndarray:
    """Whether the edit distance of each pair of code arrays is at most `edits`.

    The states of the Levenshtein automaton are bits over the 2 * edits + 1 diagonals of
    the band, one word per number of edits; all pairs step together.
    """
    out = np.zeros(len(left), bool)
    la, lb = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    order = np.argsort(la, kind="stable")
    width = 2 * edits + 1
    full = np.uint16((1 << width) - 1)
    at = 0
    while at < len(order):
        take = max(1, min(4096, (4 << 20) // int(la[order[min(at + 4096, len(order)) - 1]] + 1)))
        some = order[at : at + take]
        at += take
        steps = int(la[some].max())
        a = np.zeros((steps, len(some)), np.uint32)
        b = np.full((max(steps, int(lb[some].max())) + width, len(some)), 0xFFFFFFFF, np.uint32)
        for k, i in enumerate(some):
            a[: la[i], k] = left[i]
            b[edits : edits + lb[i], k] = right[i]
        # r[k]: bit d is set when k edits lead to diagonal d - edits.
        r = [np.full(len(some), 1 << edits, np.uint16)]
        for _ in range(edits):
            r.append(r[-1] | (r[-1] << 1) & full)
        done = np.zeros(len(some), bool)
        for t in range(steps + 1):
            here = la[some] == t
            if here.any():
                bit = (lb[some] - la[some] + edits).clip(0, width - 1)
                reach = np.zeros(len(some), bool)
                for x in r:
                    reach |= (x >> bit) & 1 > 0
                done[here] = reach[here] & (np.abs(lb[some] - la[some]) <= edits)[here]
            if t == steps:
                break
            match = np.zeros(len(some), np.uint16)
            for d in range(width):
                match |= (b[t + d] == a[t]).astype(np.uint16) << d
            new = [r[0] & match]
            for k in range(1, edits + 1):
                new.append(r[k] & match | r[k - 1] | r[k - 1] >> 1 | (new[k - 1] << 1) & full)
            r = new
        out[some] = done
    return out


class Verifier:
    """Finds rows of buckets that an earlier row of the same bucket is near to."""

    def __init__(self, edits: int, batch: int = 1 << 14):
        self.edits, self.batch = edits, batch
        self.pending: list[tuple] = []  # (earlier codes, later codes, later row)

    def bucket(self, rows: list[tuple], cross: bool):
        """rows: (order key, own segment, side, codes), sorted by order key; yields flagged order keys."""
        n = len(rows)
        if n <= 32:
            for j in range(1, n):
                for i in range(j):
                    if self.may(rows[i], rows[j], cross):
                        self.pending.append((rows[i][3], rows[j][3], rows[j][0]))
            if len(self.pending) >= self.batch:
                yield from self.flush()
            return
        own = np.array([x[1] for x in rows])
        side = np.array([x[2] for x in rows])
        size = np.array([len(x[3]) for x in rows])
        left = np.ones(n, bool)  # not flagged yet
        step = max(1, self.batch // n)
        for i in range(0, n, step):
            s, t = np.arange(i, min(i + step, n)), np.flatnonzero(left)
            ok = (s[:, None] < t) & (own[s][:, None] | own[t]) & (np.abs(size[s][:, None] - size[t]) <= self.edits)
            if cross:
                ok &= side[s][:, None] != side[t]
            p, q = np.nonzero(ok)
            if len(p):
                found = within([rows[s[k]][3] for k in p], [rows[t[k]][3] for k in q], self.edits)
                left[t[q[found]]] = False
        for j in np.flatnonzero(~left):
            yield rows[j][0]

    def may(self, x: tuple, y: tuple, cross: bool) -> bool:
        return (x[1] or y[1]) and abs(len(x[3]) - len(y[3])) <= self.edits and (not cross or x[2] != y[2])

    def flush(self):
        if self.pending:
            found = within([p[0] for p in self.pending], [p[1] for p in self.pending], self.edits)
            yield from {p[2] for p, yes in zip(self.pending, found) if yes}
            self.pending = []


def _lines_of(batch: pa.RecordBatch, min_chars: int = 1):
    """(part, rows, line numbers, stripped lines) of the lines that take part; a part's key arrays are fifty times its bytes."""
    for part in slices(batch, "text", 1 << 20):
        rows, numbers, texts = [], [], []
        for i, text in enumerate(part.column("text").to_pylist()):
            for k, line in enumerate(split_lines(text)):
                line = line.strip()
                if len(line) >= min_chars:
                    rows.append(i)
                    numbers.append(k)
                    texts.append(line)
        if texts:
            yield part, rows, numbers, texts


def _hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def repeated_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lines to remove: (doc, line, near), numbered from 0 in their document.

    A line's order is its document's id (null first), then its number. Of equal lines the
    first stays; the first of equal lines goes too (near) when a line before it is within
    `max_edits` and both have `min_chars` code points at least. Lines are compared without
    outer white space; blank ones take no part.
    """
    if min_chars <= 2 * max_edits:
        raise ValueError("min_chars must be more than twice max_edits")
    spark = docs.sparkSession
    chosen = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"))
    kind = dict(chosen.dtypes)["doc"]

    def number(batches):
        for batch in batches:
            for part, rows, numbers, texts in _lines_of(batch):
                raw = [x.encode("utf-8", "surrogatepass") for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array([_hash(x) for x in texts], pa.int64()), pa.array([xxhash.xxh32_intdigest(x, 7) - (1 << 31) for x in raw], pa.int32())],
                    names=["doc", "line", "h1", "h2"],
                )

    lines = stored(chosen.mapInArrow(number, f"doc {kind}, line int, h1 bigint, h2 int"))
    firsts = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc", "line")).alias("first"), F.count(F.lit(1)).alias("n"))
    again = firsts.where("n > 1").select("h1", "h2", "first")
    copies = lines.join(again, ["h1", "h2"]).where("NOT (struct(doc, line) <=> first)").select("doc", "line", F.lit(False).alias("near"))

    def keyed(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, _, _, texts in _lines_of(batch, min_chars):
                # A line that repeats in the task gives its keys once, as far as it is remembered.
                new = {h: x for h, x in zip(map(_hash, texts), texts) if h not in seen}
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen.update(new)
                if new:
                    of, keys, own = segment_keys(list(new.values()), max_edits)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.fromiter(new, np.int64, len(new))[of]), pa.array(own)], names=["key", "h1", "own"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Both branches are dealt by key, so the join and the groups need no further shuffle; Spark
    # makes the keys once for each branch.
    keys = chosen.mapInArrow(keyed, "key bigint, h1 bigint, own boolean").repartition(n, "key")
    shared = keys.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.max("own").alias("own")).where("a < b AND own").select("key")
    members = keys.join(shared.hint("shuffle_hash"), "key", "left_semi").groupBy("key", "h1").agg(F.max("own").alias("own"))
    members = stored(members)
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))

    named = members.select("h1").distinct().join(firsts.select("h1", "first.*"), "h1")
    wanted = cut(named.groupBy(F.col("doc").alias("of")).agg(F.collect_list(F.struct("line", "h1")).alias("wanted")))
    found = chosen.join(broadcast_if_small(wanted), F.col("doc").eqNullSafe(F.col("of"))).drop("of")

    def cut_out(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows, numbers, hashes, texts = [], [], [], []
                for i, (text, asked) in enumerate(zip(part.column("text").to_pylist(), part.column("wanted").to_pylist())):
                    own = split_lines(text)
                    for x in asked:
                        said = own[x["line"]].strip() if x["line"] < len(own) else ""
                        if said and _hash(said) == x["h1"]:
                            rows.append(i)
                            numbers.append(x["line"])
                            hashes.append(x["h1"])
                            texts.append(said)
                yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(hashes, pa.int64()), pa.array(texts, pa.string())], names=["doc", "line", "h1", "said"])

    said = found.mapInArrow(cut_out, f"doc {kind}, line int, h1 bigint, said string")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(block_rows))).cast("int")
    dealt = members.join(sizes, "key").where("n > 1").join(said, "h1").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("h1"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.col("block").alias("side"), "own", "doc", "line", "said")
    dealt = dealt.repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "doc", "line")

    def verify(batches):
        check, held, current, arrow = Verifier(max_edits), [], None, None

        def out(flagged):
            flagged = list(flagged)
            if flagged:
                yield pa.RecordBatch.from_arrays([pa.array([f[1] for f in flagged], arrow), pa.array([f[2] for f in flagged], pa.int32())], names=["doc", "line"])

        def finish():
            # A line stands once in a bucket, whatever its document's rows.
            rows = list({r[0]: r for r in held}.values())
            if len(rows) > 1:
                yield from out(check.bucket(sorted(rows, key=lambda r: r[0]), current[1] != current[2]))

        for batch in batches:
            arrow = batch.schema.field("doc").type
            texts = batch.column("said").to_pylist()
            flat, bounds = codes(texts)
            for i, (key, lo, hi, side, own, doc, line) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("key", "lo", "hi", "side", "own", "doc", "line")))):
                if (key, lo, hi) != current:
                    yield from finish()
                    held, current = [], (key, lo, hi)
                order = (doc is not None, doc, line) if doc is not None else (False, None, line)
                held.append((order, own, side, flat[bounds[i] : bounds[i + 1]]))
        yield from finish()
        yield from out(check.flush())

    near = dealt.mapInArrow(verify, f"doc {kind}, line int").distinct()
    # The first of equal lines stands for its copies, which go anyway.
    return copies.unionByName(near.withColumn("near", F.lit(True)))


def dedup_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", counts: bool = True, **options) -> DataFrame:
    """The documents without repeated lines: all columns, `text` without them.

    With `counts`, also `n_lines`, `n_copies` (equal to a line before) and `n_near`
    (within `max_edits` of one), which replace columns of these names. Every row stays,
    if with an empty text; null texts stay null; texts of any length are read whole. Rows
    that share an id count as one document, their lines of one number as one place. Blank
    lines stay. An empty table gives an empty result; other columns pass, whatever their
    names.
    """
    of, said, copied, close = fresh([*docs.columns, "n_lines", "n_copies", "n_near"], "of", "said", "copied", "close")
    gone = repeated_lines(docs, max_edits, min_chars, id_col=id_col, text_col=text_col, **options)
    gone = cut(gone.groupBy(F.col("doc").alias(of)).agg(F.collect_set(F.when(~F.col("near"), F.col("line"))).alias(copied), F.collect_set(F.when(F.col("near"), F.col("line"))).alias(close)))
    extra = ["n_lines", "n_copies", "n_near"] if counts else []
    others = [c for c in docs.columns if c not in (text_col, *extra)]
    base = docs.select(*[docs[c] for c in others], docs[text_col].alias(said))
    joined = base.join(broadcast_if_small(gone), base[id_col].eqNullSafe(F.col(of)), "left").drop(of)
    kinds = dict(joined.dtypes)

    def apply(batches):
        for batch in batches:
            for part in slices(batch, said):
                texts, numbers = [], []
                for text, copies, near in zip(*(part.column(k).to_pylist() for k in (said, copied, close))):
                    own = split_lines(text)
                    copies = {k for k in copies or () if k < len(own) and own[k].strip()}
                    near = {k for k in near or () if k < len(own) and len(own[k].strip()) >= min_chars} - copies
                    texts.append("\n".join(x for k, x in enumerate(own) if k not in copies and k not in near) if copies or near else text)
                    numbers.append((len(own), len(copies), len(near)))
                more = [pa.array([x[i] for x in numbers], pa.int64()) for i in range(len(extra))]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], pa.array(texts, pa.string()), *more], names=[*others, said, *extra])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), f"`{said}` string", *(f"{c} bigint" for c in extra)])
    out = joined.mapInArrow(apply, schema)
    return out.select(*[F.col(said).alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in extra], *extra)
