import struct
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from sparkseek.llm.media import _box, _resize, decode, describe, edited, encode_pgm, image_copies, same_picture, scene
from sparkseek.llm.queries import op9_media_copies

SMALL = "/root/testdata/sf0.001"


def test_query_finds_the_edited_copies(spark):
    got = {r["vec_id"]: r for r in op9_media_copies(spark, SMALL).collect()}
    assert len(got) == 500
    for i, r in got.items():
        assert r["class_id"] == (i - 1 if i % 8 == 7 else i) and r["kept"] == (i % 8 != 7)


def test_equals_brute_force(spark):
    raw = {i: encode_pgm(edited(scene(i // 4 * 4), 8 * i) if i % 4 else scene(i)) for i in range(40)}
    raw |= {100 + i: raw[i] for i in range(0, 40, 5)}
    points = {i: describe(decode(x)) for i, x in raw.items()}
    up = {i: i for i in raw}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in raw:
        for j in raw:
            if i < j and (raw[i] == raw[j] or same_picture(points[i], points[j])):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(raw.items()), "id bigint, image binary")
    for size in (2048, 8):
        assert {r["id"]: r["class_id"] for r in image_copies(df, block_rows=size).collect()} == {i: root(i) for i in raw}


def test_recall_of_edited_copies_of_small_and_large_pictures(spark):
    rng, raw, large = np.random.default_rng(4), {}, set()
    for i in range(0, 160, 8):
        k = i // 8 % 3 + 1
        x = np.block([[scene(9 * i + 3 * r + c) for c in range(k)] for r in range(k)])
        n = len(x)
        small = _resize(x, 0.8)
        edits = [x, x + rng.normal(0, 12, x.shape), small + rng.normal(0, 8, small.shape), _box(x, 1)]
        if k > 1:
            edits += [_resize(_box(x, 1), 0.5), x[n // 4 : n // 4 + n // 2, n // 4 : n // 4 + n // 2], _resize(_box(x[: 3 * n // 4, : 3 * n // 4], 1), 0.6)]
            large |= {i + j for j in range(4, 7)}
        raw |= {i + j: encode_pgm(y) for j, y in enumerate(edits)}
    points = {i: describe(decode(x)) for i, x in raw.items()}
    alike = {i for i in raw if i % 8 and same_picture(points[i // 8 * 8], points[i])}
    assert len(large & alike) >= 0.9 * len(large) and len(alike) >= 90
    got = {r["id"]: r["class_id"] for r in image_copies(spark.createDataFrame(list(raw.items()), "id bigint, image binary")).collect()}
    assert all(c // 8 == i // 8 for i, c in got.items())
    assert sum(got[i] == i // 8 * 8 for i in alike) >= 0.98 * len(alike)


def turned(x, degrees):
    h, w = x.shape
    a = np.deg2rad(degrees)
    yy, xx = np.mgrid[:h, :w]
    cy, cx = (h - 1) / 2, (w - 1) / 2
    y = (np.cos(a) * (yy - cy) - np.sin(a) * (xx - cx) + cy).clip(0, h - 1.001)
    z = (np.sin(a) * (yy - cy) + np.cos(a) * (xx - cx) + cx).clip(0, w - 1.001)
    i, k, fy, fz = y.astype(int), z.astype(int), y % 1, z % 1
    return (x[i, k] * (1 - fz) + x[i, k + 1] * fz) * (1 - fy) + (x[i + 1, k] * (1 - fz) + x[i + 1, k + 1] * fz) * fy


EDITS = {
    "turned by 10": lambda x: turned(x, 10), "turned by 30": lambda x: turned(x, 30), "turned by 77": lambda x: turned(x, 77),
    "scaled to 0.7": lambda x: _resize(_box(x, 1), 0.7), "scaled to 0.8": lambda x: _resize(x, 0.8), "scaled to 1.4": lambda x: _resize(x, 1.4),
    "cropped to three quarters": lambda x: x[len(x) // 8 :, len(x) // 8 :][: len(x) * 3 // 4, : len(x) * 3 // 4],
    "cropped to half": lambda x: x[len(x) // 4 :, len(x) // 4 :][: len(x) // 2, : len(x) // 2],
}


def test_recall_of_all_pairs_consensus_by_edit(spark):
    for side, n, sure in ((1, 30, 5), (2, 12, 8)):
        raw = {}
        for i in range(n):
            x = np.block([[scene(977 * i + 2 * r + c) for c in range(side)] for r in range(side)])
            raw |= {16 * i: encode_pgm(x)} | {16 * i + k + 1: encode_pgm(f(x)) for k, f in enumerate(EDITS.values())}
        points = {i: describe(decode(x)) for i, x in raw.items()}
        alike = {i for i in raw if i % 16 and same_picture(points[i // 16 * 16], points[i])}
        got = {r["id"]: r["class_id"] for r in image_copies(spark.createDataFrame(list(raw.items()), "id bigint, image binary")).collect()}
        assert all(c // 16 == i // 16 for i, c in got.items())
        for k in range(len(EDITS)):
            some = {i for i in alike if i % 16 == k + 1}
            assert sum(got[i] == i // 16 * 16 for i in some) >= 0.9 * len(some), (side, k)
        # Edits of which the consensus itself finds nearly all copies.
        assert sum(sum(i % 16 == k + 1 for i in alike) >= 0.9 * n for k in range(len(EDITS))) >= sure


def test_unlike_pictures_under_one_id(spark):
    a, b = scene(1), scene(2)
    rows = [(5, a), (5, b), (6, a * 0.8 + 20), (7, b * 0.8 + 20), (7, scene(3))]
    df = spark.createDataFrame([(i, encode_pgm(x), 0, 0) for i, x in rows], "id bigint, image binary, node int, d1 int")
    got = sorted((r["id"], r["class_id"]) for r in image_copies(df).collect())
    assert got == [(5, 5), (5, 5), (6, 5), (7, 5), (7, 7)]


def png(x, filters):
    h, w = x.shape
    rows, before = b"", np.zeros(w, int)
    for i in range(h):
        line, kind = x[i].astype(int), filters[i % len(filters)]
        left, corner = np.append(0, line[:-1]), np.append(0, before[:-1])
        p = left + before - corner
        paeth = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        guess = [0, left, before, (left + before) // 2, paeth][kind]
        rows += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        before = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_decoders():
    x = scene(3)
    assert np.allclose(decode(encode_pgm(x)), np.rint(x)) and np.allclose(decode(png(np.rint(x).astype(np.uint8), [0, 1, 2, 3, 4])), np.rint(x))
    assert decode(b"P6 # note\n1 1 255\n\x00\x03\x06").tolist() == [[3.0]]
    assert decode(b"GIF89a") is None and decode(b"P5\n9 9\n255\n") is None and decode(b"\x89PNG\r\n\x1a\n") is None and decode(None) is None


def test_edges(spark):
    x = bytearray(encode_pgm(scene(1)))
    rows = [(1, None), (2, None), (3, bytearray(b"")), (4, bytearray(b"no image")), (5, bytearray(b"no image")), (None, x), (6, x), (6, x), (7, x), (8, bytearray(encode_pgm(np.full((90, 90), 9)))), (9, bytearray(encode_pgm(np.zeros((2, 1)))))]
    df = spark.createDataFrame([(*r, "c") for r in rows], "id bigint, image binary, points string")
    got = sorted(((r["id"], r["class_id"], r["kept"]) for r in image_copies(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (None, None, True), (6, 6, True), (6, 6, True), (7, 6, False), (8, 8, True), (9, 9, True)], key=str)
    assert image_copies(df.where(F.lit(False))).collect() == []


def test_candidates_share_the_points_they_need(spark):
    """Many candidates a picture: points are shuffled once for each pair of blocks, and the tables' tallies go."""
    raw = {i: encode_pgm(scene(i)) for i in range(100)}
    df = spark.createDataFrame(list(raw.items()), "id bigint, image binary")
    points = sum(len(describe(decode(x)).tobytes()) for x in raw.values())
    gateway, folder = spark.sparkContext._gateway, Path(spark.conf.get("spark.checkpoint.dir"))

    def shuffled():
        status = spark.sparkContext._jsc.sc().statusStore()
        found = status.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    # Small tables would be broadcast.
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before, kept = shuffled(), {p.name for p in folder.glob("stored-*")}
        # Every pair that meets is a candidate.
        got = {r["id"]: r["class_id"] for r in image_copies(df, votes=1).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {i: i for i in raw}
    # Four partitions make three blocks; the candidates' own rows are short.
    assert max(v for k, v in shuffled().items() if k not in before) <= 4 * points
    # The rows and the points stay; of the eight tables' tallies nothing does.
    assert len({p.name for p in folder.glob("stored-*")} - kept) == 2


def test_blocks_of_candidates(spark):
    raw = {10 * i + k: encode_pgm(scene(i) + k) for i in range(8) for k in range(10)}
    df = spark.createDataFrame(list(raw.items()), "id bigint, image binary")
    assert {r["id"]: r["class_id"] for r in image_copies(df, block_bytes=20000).collect()} == {i: i // 10 * 10 for i in raw}
