"""Copies among images by local descriptors.

Corners at several scales get an orientation from the intensity centroid and 256
orientation-normalised binary tests. Descriptors meet in tables keyed by sampled bits;
inside a table's bucket, those within a Hamming distance form clusters and each image is
paired with its cluster's smallest and with the nearest of another image (never all
pairs). Pairs that meet often enough at about one angle are verified by geometric
consensus: enough matches must agree on one similarity transformation. Components of the
verified pairs are the classes, so crops and edited copies of one picture share a class.
"""

from __future__ import annotations

import math
import struct
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, broadcast_if_small, components, cut, discard, numbered, release, settle, stored, whole_runs

#: Each scale's step to the next; scales go on while the picture holds a descriptor.
STEP = 0.7
#: Corners for a picture of 96 by 96 at full scale; larger pictures get more in proportion to their area.
POINTS = 32
AREA = 96 * 96
RADIUS = 11
TABLES, KEY_BITS = 8, 22
NEAR_BITS = 40
MATCH_BITS = 64
VOTES = 3
INLIERS = 8
#: Of the corners of the picture that has fewer, the share that must agree at least.
SHARE = 0.08
#: Side of the squares in which agreeing corners count once.
PLACE = 6
#: A bucket's rows are dealt in blocks of so many; each pair of blocks is a unit of work.
BLOCK_ROWS = 16384
#: The tables' meetings are summed in so many slices, one at a time.
SLICES = 4
#: Candidates are verified by pairs of blocks of pictures with so many bytes of points.
BLOCK_BYTES = 32 << 20
#: Rows of a bucket that are compared at once with as many others.
SIDE = 256
_rng = np.random.default_rng(20240507)
_TESTS = np.clip(_rng.normal(0, RADIUS / 2.2, (256, 2, 2)), -RADIUS + 1, RADIUS - 1)
_TURNS = 36
#: Parts of the circle that a corner's angle is told in.
TURNS = 72
_angles = 2 * np.pi * np.arange(_TURNS) / _TURNS
_rotate = np.stack([np.stack([np.cos(_angles), -np.sin(_angles)], 1), np.stack([np.sin(_angles), np.cos(_angles)], 1)], 1)
_PATTERN = np.rint(np.einsum("aij,tpj->atpi", _rotate, _TESTS)).astype(np.int64)
_PICK = np.stack([_rng.choice(256, KEY_BITS, replace=False) for _ in range(TABLES)])
_WEIGHT = 1 << np.arange(KEY_BITS, dtype=np.int64)
_DISC = np.array([(y, x) for y in range(-7, 8) for x in range(-7, 8) if x * x + y * y <= 49])
POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "<f4"), ("angle", "<f4"), ("bits", "u1", 32)])


def decode(raw: bytes | None) -> np.ndarray | None:
    """Grey levels of a binary PGM or PPM, or of a PNG of 8 bits without interlacing; None for anything else."""
    try:
        if raw is None:
            return None
        if raw[:2] in (b"P5", b"P6"):
            fields, at = [], 2
            while len(fields) < 3:
                while raw[at : at + 1].isspace():
                    at += 1
                if raw[at : at + 1] == b"#":
                    at = raw.index(b"\n", at)
                    continue
                end = at
                while raw[end : end + 1].isdigit():
                    end += 1
                fields.append(int(raw[at:end]))
                at = end
            w, h, most = fields
            depth = 1 if raw[:2] == b"P5" else 3
            if not 0 < most < 256 or w < 1 or h < 1:
                return None
            x = np.frombuffer(raw, np.uint8, w * h * depth, at + 1).reshape(h, w, depth)
            return x.astype(np.float32).mean(axis=2) * (255 / most)
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            at, data, head = 8, b"", None
            while at < len(raw):
                n, kind = struct.unpack(">I4s", raw[at : at + 8])
                body = raw[at + 8 : at + 8 + n]
                if kind == b"IHDR":
                    head = struct.unpack(">IIBBBBB", body)
                elif kind == b"IDAT":
                    data += body
                at += 12 + n
            w, h, bits, colour, _, _, interlaced = head
            depth = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
            if bits != 8 or interlaced:
                return None
            rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * depth)
            out = np.zeros((h, w * depth), np.uint8)
            before = np.zeros(w * depth, np.uint8)
            for i in range(h):
                kind, line = rows[i, 0], rows[i, 1:].copy()
                if kind == 2:
                    line += before
                elif kind in (1, 3, 4):
                    for k in range(len(line)):
                        a = int(line[k - depth]) if k >= depth else 0
                        b, c = int(before[k]), int(before[k - depth]) if k >= depth else 0
                        if kind == 4:
                            p = a + b - c
                            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                        line[k] = (int(line[k]) + (a if kind == 1 else (a + b) // 2 if kind == 3 else near)) & 255
                out[i] = before = line
            x = out.reshape(h, w, depth)
            return x[:, :, : 3 if depth > 2 else 1].astype(np.float32).mean(axis=2)
    except (ValueError, KeyError, TypeError, IndexError, struct.error, zlib.error):
        return None
    return None


def encode_pgm(x: np.ndarray) -> bytes:
    x = np.clip(np.rint(x), 0, 255).astype(np.uint8)
    return b"P5\n%d %d\n255\n" % (x.shape[1], x.shape[0]) + x.tobytes()


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of side 2 r + 1 of the last two axes, edges repeated."""
    rows, cols = (np.clip(np.arange(-r - 1, m + r), 0, m - 1) for m in x.shape[-2:])
    c = np.cumsum(np.cumsum(x[..., rows[:, None], cols], axis=-2, dtype=np.float64), axis=-1)
    n = 2 * r + 1
    return (c[..., n:, n:] - c[..., :-n, n:] - c[..., n:, :-n] + c[..., :-n, :-n]) / (n * n)


def _resize(x: np.ndarray, scale: float) -> np.ndarray:
    h, w = (max(1, int(round(n * scale))) for n in x.shape)
    yy, xx = (np.clip((np.arange(n) + 0.5) / scale - 0.5, 0, m - 1) for n, m in ((h, x.shape[0]), (w, x.shape[1])))
    y0, x0 = np.minimum(yy.astype(int), x.shape[0] - 2).clip(0), np.minimum(xx.astype(int), x.shape[1] - 2).clip(0)
    y1, x1 = np.minimum(y0 + 1, x.shape[0] - 1), np.minimum(x0 + 1, x.shape[1] - 1)
    fy, fx = (yy - y0)[:, None], (xx - x0)[None, :]
    return (x[y0][:, x0] * (1 - fx) + x[y0][:, x1] * fx) * (1 - fy) + (x[y1][:, x0] * (1 - fx) + x[y1][:, x1] * fx) * fy


def describe(image: np.ndarray, points: int = POINTS) -> np.ndarray:
    """The strongest corners of all scales with their descriptors."""
    out = []
    edge = int(RADIUS * 1.5) + 1
    points = points * max(1.0, image.size / AREA)
    x, scale = image, 1.0
    while min(x.shape) > 2 * edge + 2:
        made = _corners(x, scale, max(4, int(points * scale * scale * 0.75)), edge)
        if len(made):
            out.append(made)
        x = _resize(_box(x, 1), STEP)
        scale *= STEP
    return np.concatenate(out) if out else np.zeros(0, POINT)


def _corners(x: np.ndarray, scale: float, most: int, edge: int) -> np.ndarray:
    """The strongest corners of one scale."""
    gy, gx = np.gradient(_box(x, 1))
    a, b, c = _box(np.stack([gx * gx, gy * gy, gx * gy]), 2)
    r = a * b - c * c - 0.05 * (a + b) ** 2
    inner = r[edge:-edge, edge:-edge]
    around = r[edge - 2 : -edge + 2, edge - 2 : -edge + 2]
    h, w = inner.shape
    around = reduce(np.maximum, [around[k : k + h] for k in range(5)])
    around = reduce(np.maximum, [around[:, k : k + w] for k in range(5)])
    ys, xs = np.nonzero((inner >= around) & (inner > 1.0))
    order = np.argsort(-inner[ys, xs], kind="stable")[:most]
    ys, xs = ys[order] + edge, xs[order] + edge
    if not len(ys):
        return np.zeros(0, POINT)
    patch = x[ys[:, None] + _DISC[:, 0], xs[:, None] + _DISC[:, 1]]
    angle = np.arctan2(patch @ _DISC[:, 0], patch @ _DISC[:, 1])
    turn = np.rint(angle / (2 * np.pi) * _TURNS).astype(int) % _TURNS
    smooth = _box(x, 2)
    at = _PATTERN[turn]  # point, test, end, (x, y)
    value = smooth[ys[:, None, None] + at[..., 1], xs[:, None, None] + at[..., 0]]
    made = np.zeros(len(ys), POINT)
    made["x"], made["y"], made["scale"], made["angle"] = (xs + 0.5) / scale, (ys + 0.5) / scale, 1 / scale, angle
    made["bits"] = np.packbits(value[..., 0] < value[..., 1], axis=1)
    return made


def table_keys(p: np.ndarray, table: int) -> np.ndarray:
    """The points' bucket keys in a table: its sampled bits."""
    picked = p["bits"][:, _PICK[table] >> 3] >> (7 - (_PICK[table] & 7)).astype(np.uint8) & 1
    return picked.astype(np.int64) @ _WEIGHT


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of 32 bytes to one another."""
    a, b = (np.ascontiguousarray(v).view(np.uint64) for v in (a, b))
    out = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return out


def consensus(p: np.ndarray, q: np.ndarray, tolerance: float = 4.0, tight: float = 3.0) -> int:
    """The most matches that agree on one rotation, scale and shift.

    Each match proposes a transformation; the best one's matches are fitted by least squares
    and those near to the fit are counted, corners at coarse scales less strictly.
    """
    if not len(p) or not len(q):
        return 0
    j, d = np.empty(len(p), np.int64), np.empty(len(p), np.int64)
    step = max(1, (1 << 20) // len(q))
    for k in range(0, len(p), step):
        apart = hamming(p["bits"][k : k + step], q["bits"])
        j[k : k + step], d[k : k + step] = apart.argmin(axis=1), apart.min(axis=1)
    i = np.flatnonzero(d <= MATCH_BITS)
    if not len(i):
        return 0
    a, b = p[i], q[j[i]]
    ratio, turn = b["scale"] / a["scale"], b["angle"] - a["angle"]
    cos, sin = ratio * np.cos(turn), ratio * np.sin(turn)
    best = np.zeros(len(a), bool)
    step = max(1, (1 << 20) // len(a))
    for k in range(0, len(a), step):
        r = slice(k, k + step)
        dx, dy = a["x"][None] - a["x"][r, None], a["y"][None] - a["y"][r, None]
        ex = b["x"][r, None] + cos[r, None] * dx - sin[r, None] * dy - b["x"][None]
        ey = b["y"][r, None] + sin[r, None] * dx + cos[r, None] * dy - b["y"][None]
        # A wrong angle of a few degrees moves far points more.
        agree = np.hypot(ex, ey) <= tolerance + 0.12 * np.hypot(dx, dy)
        u, v = np.nonzero(agree)
        agree[u, v] = (np.abs(np.angle(np.exp(1j * (turn[v] - turn[k + u])))) < 0.4) & (np.abs(np.log(ratio[v] / ratio[k + u])) < 0.2)
        most = agree[int(agree.sum(axis=1).argmax())]
        if most.sum() > best.sum():
            best = most
    z, w = a["x"] + 1j * a["y"].astype(np.float64), b["x"] + 1j * b["y"].astype(np.float64)
    allowed = tight * np.maximum(1, np.maximum(a["scale"], b["scale"]))
    for _ in range(3):
        if best.sum() < 3:
            return 0
        zm, wm = z[best].mean(), w[best].mean()
        s = (np.conj(z[best] - zm) * (w[best] - wm)).sum() / max((np.abs(z[best] - zm) ** 2).sum(), 1e-9)
        alike = (np.abs(np.angle(np.exp(1j * (turn - np.angle(s))))) < 0.5) & (np.abs(np.log(ratio / max(np.abs(s), 1e-9))) < 0.3)
        best = (np.abs(s * (z - zm) + wm - w) <= allowed) & alike
    # Corners of one place, found at several scales, count once.
    return min(len(np.unique(np.round(v[best] / PLACE))) for v in (z, w))


def same_picture(p: np.ndarray, q: np.ndarray, inliers: int = INLIERS, share: float = SHARE) -> bool:
    """Whether enough corners agree: a number, and a share of the corners of the picture that has fewer."""
    need = max(inliers, math.ceil(share * min(len(p), len(q))))
    return min(len(p), len(q)) >= need and consensus(p, q) >= need


def image_copies(images: DataFrame, id_col: str = "id", image_col: str = "image", votes: int = VOTES, inliers: int = INLIERS, near_bits: int = NEAR_BITS, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per image: (id, n_points, class_id, kept).

    `n_points` counts the corners of images that are compared, zero for the others.

    Images of equal bytes are one node. `class_id` is the smallest id of the images tied to
    it by verified pairs, itself included; `kept` marks it. Values that are null, empty or no
    image that `decode` reads have no points and stand alone unless their bytes are equal;
    null bytes and null ids always stand alone. Repeated rows are rows of their own, and so
    are unlike pictures under one id: each has its own class, named by the smallest id in
    it. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    spark = images.sparkSession
    chosen = images.select(images[id_col].alias("id"), images[image_col].alias("image"))
    kind = dict(chosen.dtypes)["id"]

    def digest(batches):
        for batch in batches:
            d1, d2 = [], []
            for i in range(batch.num_rows):
                raw = batch.column("image")[i].as_py()
                value = xxhash.xxh3_128_intdigest(raw) if raw is not None and batch.column("id")[i].is_valid else None
                d1.append(None if value is None else (value >> 64) - (1 << 63))
                d2.append(None if value is None else (value & (1 << 64) - 1) - (1 << 63))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), batch.column("image")], names=["id", "d1", "d2", "image"])

    def points(batches):
        for batch in batches:
            found = [decode(raw) for raw in batch.column("image").to_pylist()]
            made = [(describe(x) if x is not None else np.zeros(0, POINT)).tobytes() for x in found]
            settle()
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(made, pa.binary())], names=["rep", "points"])

    hashed = chosen.mapInArrow(digest, f"id {kind}, d1 bigint, d2 bigint, image binary")
    rows = stored(hashed.select("id", "d1", "d2"))
    size = POINT.itemsize
    good = rows.where("d1 IS NOT NULL")
    nodes = numbered(good.groupBy("d1", "d2").agg(F.min("id").alias("id")), "id", "d1", "d2")
    # Equal bytes are described once. An id's repeated rows stand once.
    some = hashed.where("d1 IS NOT NULL").join(broadcast_if_small(nodes), ["d1", "d2", "id"]).select(F.col("node").alias("rep"), "image")
    heads = stored(some.mapInArrow(points, "rep bigint, points binary").dropDuplicates(["rep"]))

    words_of = [f"w{k}" for k in range(4)]
    by = ["key", "part"]

    def list_keys(table):
        def run(batches):
            for batch in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
                p = [np.frombuffer(x, POINT) for x in batch.column("points").to_pylist()]
                of = np.repeat(np.arange(len(p)), [len(x) for x in p])
                flat = np.concatenate([*p, np.zeros(0, POINT)])
                words = np.ascontiguousarray(flat["bits"]).view(np.int64)
                turn = np.rint(flat["angle"] / (2 * np.pi) * TURNS).astype(np.int32) % TURNS
                arrays = [batch.column("rep").take(pa.array(of)), pa.array(table_keys(flat, table)), pa.array(turn)]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(w) for w in words.T)], names=["rep", "key", "turn", *words_of])

        return run

    def meet(batches):
        for batch, starts in whole_runs(batches, by):
            words = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in words_of])
            n = batch.num_rows
            forest = Forest(n)
            length = np.diff(starts)
            run = np.repeat(np.arange(len(length)), length)
            rep = batch.column("rep")
            first = np.ones(n, bool)
            first[1:] = np.asarray(pc.not_equal(rep[1:], rep[:-1])) | (run[1:] != run[:-1])
            image = np.cumsum(first)
            nearest, least = np.arange(n), np.full(n, near_bits + 1)

            def closest(i, j, d):
                """Rows i, each any number of times, meet rows j at distance d."""
                new = np.flatnonzero((image[i] != image[j]) & (d < least[i]))
                new = new[np.lexsort((d[new], i[new]))]
                new = new[np.append(True, i[new][1:] != i[new][:-1])[: len(new)]]
                nearest[i[new]], least[i[new]] = j[new], d[new]

            # All pairs inside small runs at once, by the runs' lengths.
            for m in np.unique(length[(length > 1) & (length <= 64)]):
                at = np.asarray(starts[:-1])[length == m]
                p, q = np.triu_indices(m, 1)
                step = max(1, (1 << 18) // len(p))
                for k in range(0, len(at), step):
                    i, j = (at[k : k + step, None] + p).ravel(), (at[k : k + step, None] + q).ravel()
                    apart = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in words)
                    hit = apart <= near_bits
                    i, j, apart = i[hit], j[hit], apart[hit]
                    forest.add(i, j)
                    closest(np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([apart, apart]))
            for start, end in zip(starts[:-1][length > 64].tolist(), starts[1:][length > 64].tolist()):
                for i in range(start, end, SIDE):
                    a = slice(i, min(i + SIDE, end))
                    for j in range(i, end, SIDE):
                        b = slice(j, min(j + SIDE, end))
                        # Rows of a bucket share its key's bits: a distance fits a byte.
                        apart = np.bitwise_count(words[0, a, None] ^ words[0, b])
                        for w in words[1:]:
                            apart += np.bitwise_count(w[a, None] ^ w[b])
                        d = linked_a = apart.min(axis=1)
                        e = linked_b = apart.min(axis=0)
                        others = apart
                        # Rows are sorted by image.
                        if image[a.stop - 1] >= image[j]:
                            others = np.where(image[a, None] == image[b], np.uint8(255), apart)
                            d, e = others.min(axis=1), others.min(axis=0)
                        # The nearest row itself is looked up only where it is nearer than those before.
                        new = np.flatnonzero(d < least[a])
                        nearest[i + new], least[i + new] = j + others[new].argmin(axis=1), d[new]
                        new = np.flatnonzero(e < least[b])
                        nearest[j + new], least[j + new] = i + others[:, new].argmin(axis=0), e[new]
                        # Only rows with a link can join trees.
                        p, q = np.flatnonzero(linked_a <= near_bits), np.flatnonzero(linked_b <= near_bits)
                        trees = forest.label[np.append(i + p, j + q)]
                        if not len(trees) or (trees == trees[0]).all():
                            continue
                        # Nearest rows join most trees; then only rows outside the largest tree can join others.
                        x, y = p[d[p] <= near_bits], q[e[q] <= near_bits]
                        left, right = np.append(i + x, i + others[:, y].argmin(axis=0)), np.append(j + others[x].argmin(axis=1), j + y)
                        split = forest.label[left] != forest.label[right]
                        if split.any():
                            forest.add(left[split], right[split])
                            trees = forest.label[np.append(i + p, j + q)]
                        trees, count = np.unique(trees, return_counts=True)
                        most = trees[count.argmax()]
                        p, q = p[forest.label[i + p] != most], q[forest.label[j + q] != most]
                        x, y = np.nonzero(apart[p] <= near_bits)
                        u, v = np.nonzero(apart[:, q] <= near_bits)
                        left, right = np.append(i + p[x], i + u), np.append(j + y, j + q[v])
                        split = forest.label[left] != forest.label[right]
                        if split.any():
                            forest.add(left[split], right[split])
            # Rows are sorted by image in a run, so a cluster's smallest row is its smallest image.
            met = np.concatenate([np.stack([forest.label, np.arange(n)], 1), np.sort(np.stack([nearest, np.arange(n)], 1), axis=1)])
            met = met[image[met[:, 0]] != image[met[:, 1]]]
            met = np.stack(np.divmod(np.unique(met[:, 0] * n + met[:, 1]), n), 1)
            ids, turn = rep.to_numpy(), batch.column("turn").to_numpy()
            swap = ids[met[:, 0]] > ids[met[:, 1]]
            i, j = np.where(swap, met[:, 1], met[:, 0]), np.where(swap, met[:, 0], met[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array((turn[j] - turn[i]) % TURNS)], names=["a", "b", "turn"])

    # Meetings by their angle, in twelve parts of the circle and in twelve shifted by half a part: five bits count each.
    part = TURNS // 12
    tally = [F.sum(F.expr(f"shiftleft(1L, 5 * (((turn + {shift}) % {TURNS}) div {part}))")) for shift in (0, part // 2)]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tallies = []
    # One table at a time: what is shuffled at once is an eighth.
    for t in range(TABLES):
        listed = heads.mapInArrow(list_keys(t), "rep bigint, key bigint, turn int, " + ", ".join(f"{w} bigint" for w in words_of))
        shared = listed.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b")
        shared = cut(shared.select("key", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(block_rows))).alias("blocks")))
        dealt = listed.join(broadcast_if_small(shared), "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        part = F.shiftleft(F.least("block", "other"), 32).bitwiseOR(F.greatest("block", "other"))
        dealt = dealt.select("key", part.alias("part"), "rep", "turn", *words_of).repartition(n, *by).sortWithinPartitions(*by, "rep")
        met = dealt.mapInArrow(meet, "a bigint, b bigint, turn int")
        tallies.append(stored(met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), tally[0].alias("p"), tally[1].alias("q"))))
        del listed, shared, dealt, met
        release(spark)
    often = " OR ".join(f"(shiftrightunsigned({c}, {5 * k}) & 31) >= {votes}" for c in "pq" for k in range(12))
    found = []
    # All tallies' pairs in slices, for the same reason.
    for k in range(SLICES):
        summed = reduce(DataFrame.unionByName, tallies).where(F.pmod(F.xxhash64("a", "b"), F.lit(SLICES)) == k)
        summed = summed.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in "npq"))
        found.append(cut(summed.where(f"n >= 32 OR (n >= {votes} AND ({often}))").select("a", "b")))
        del summed
        release(spark)
    for frame in tallies:
        discard(frame)
    pairs = reduce(DataFrame.unionByName, found)

    # Candidates are dealt by pairs of blocks of pictures: a picture's points go once to each
    # pair of blocks that needs them, however many candidates it has there.
    ours = heads.select("rep", "points")
    weight = ours.agg(F.sum(F.length("points"))).first()[0] or 0
    blocks = max(math.ceil(math.sqrt(2 * n)), math.ceil(weight / block_bytes))
    parts = blocks * (blocks + 1) // 2
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    low, high = F.least(of("a"), of("b")), F.greatest(of("a"), of("b"))
    asked = pairs.select((low + F.floor(high * (high + 1) / 2)).cast("bigint").alias("part"), "a", "b")
    sent = asked.select("part", F.explode(F.array("a", "b")).alias("rep")).distinct().join(ours, "rep")
    sent = sent.select("part", F.col("rep").alias("a"), F.lit(None).cast("bigint").alias("b"), "points")
    both = sent.unionByName(asked.withColumn("points", F.lit(None).cast("binary")))
    # Points stand before the candidates of their part.
    both = both.repartitionById(min(parts, 4 * n), F.col("part").cast("int")).sortWithinPartitions("part", F.col("b").asc_nulls_first())

    def verify(batches):
        part, held = None, {}
        for batch in batches:
            left, right = [], []
            for at, a, b, points in zip(*(batch.column(c).to_pylist() for c in ("part", "a", "b", "points"))):
                if at != part:
                    part, held = at, {}
                if b is None:
                    held[a] = np.frombuffer(points, POINT)
                elif same_picture(held[a], held[b], inliers):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
        settle()

    area = components(both.mapInArrow(verify, "a bigint, b bigint"))
    least = nodes.select(F.col("node").alias("component"), F.col("id").alias("class_id"))
    named = nodes.join(area, "node", "left").withColumn("component", F.coalesce("component", "node")).join(least, "component").select("node", "d1", "d2", "class_id")
    count = ours.select(F.col("rep").alias("node"), (F.length("points") / F.lit(size)).cast("int").alias("n_points"))
    named = named.join(count, "node", "left").select("d1", "d2", "class_id", F.coalesce("n_points", F.lit(0)).alias("n_points"))
    out = good.join(named, ["d1", "d2"]).select("id", "n_points", "class_id")
    rest = rows.where("d1 IS NULL").select("id", F.lit(0).alias("n_points"), F.col("id").alias("class_id"))
    return out.unionByName(rest).select(F.col("id").alias(id_col), "n_points", "class_id", F.expr("id <=> class_id").alias("kept"))


def scene(seed: int, side: int = 96) -> np.ndarray:
    """A synthetic picture: overlapping rectangles and discs of random greys."""
    rng = np.random.default_rng(seed + (1 << 32))
    out = np.full((side, side), rng.integers(60, 200), np.float32)
    yy, xx = np.ogrid[:side, :side]
    for x, y, a, b, grey, round_ in zip(*(rng.integers(0, m, 26) for m in (side, side, 22, 22, 256, 2))):
        if round_:
            out[(xx - x) ** 2 + (yy - y) ** 2 <= (4 + a // 2) ** 2] = grey
        else:
            out[y : y + 4 + b, x : x + 4 + a] = grey
    return out


def edited(x: np.ndarray, seed: int) -> np.ndarray:
    """An edited copy: cropped, turned by a right angle, relit or noisy."""
    rng = np.random.default_rng(seed)
    way = seed // 8 % 4
    if way == 0:
        y, z = rng.integers(0, 13, 2)
        return x[y : y + 84, z : z + 84]
    if way == 1:
        return np.rot90(x).copy()
    if way == 2:
        return x * 0.8 + 25
    return x + rng.normal(0, 3, x.shape)


def rendered(table: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """A media column for a table that has none: a picture for each id; ids of 7 modulo 8 get an edited copy of the picture before."""
    kind = dict(table.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            made = [None if i is None else encode_pgm(edited(scene(i - 1), i) if i % 8 == 7 else scene(i)) for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=[id_col, "image"])

    return table.select(id_col).mapInArrow(run, f"`{id_col}` {kind}, image binary")
