import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkseek.llm.packing import default_tokenizer, encoder, file_order, pack, pack_documents, sequences, supersteps, sweep
from sparkseek.llm.queries import op3_best_fit_packing

SMALL = "/root/testdata/sf0.001"


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def place(counts, capacity):
    plan = supersteps(counts, capacity)
    spots = defaultdict(list)
    for i, (n, rank, first, k, offset) in enumerate(plan):
        end = plan[i + 1][1] if i + 1 < len(plan) and plan[i + 1][0] == n else counts[n]
        for r in range(end - rank):
            spots[first + r // k].append((offset + n * (r % k), n))
    return spots


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_supersteps_are_best_fit_decreasing(lengths):
    spots = place(Counter(lengths), 40)
    assert sorted(n for s in spots.values() for _, n in s) == sorted(lengths)
    for s in spots.values():
        ends = np.cumsum([n for _, n in sorted(s)])
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= 40
    assert len(spots) == best_fit_decreasing(lengths, 40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(0, 5))
def test_sweep_places_every_piece(lengths, release):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    sequence, offset, loose = sweep(lengths, 40, release)
    held = defaultdict(list)
    for s, o, n, x in zip(sequence, offset, lengths, loose):
        held[s].append((o, n, x))
    for s in held.values():
        s.sort()
        assert [o for o, _, _ in s] == [0, *np.cumsum([n for _, n, _ in s])[:-1]] and sum(n for _, n, _ in s) <= 40 and len({x for *_, x in s}) == 1
    assert len(held) == best_fit_decreasing(list(lengths), 40) and sum(s[0][2] for s in held.values()) <= release


def test_shards_pack_about_as_well_as_one(spark):
    rng = np.random.default_rng(5)
    for k, lengths in enumerate((rng.integers(1, 2049, 6000), np.minimum(2048, rng.geometric(1 / 300, 6000)), np.full(3000, 700), np.append(np.full(2000, 1100), rng.integers(1, 30, 4000)))):
        df = spark.createDataFrame([(i, 0, int(n), i, "x") for i, n in enumerate(lengths)], "doc_id bigint, piece int, length bigint, rank bigint, shard string")
        want = best_fit_decreasing(lengths.tolist(), 2048)
        for order, size, fan in ((None, 300, 4), ("rank", 500, 16)):
            got = pack(df, shard_rows=size, fan=fan, order_col=order).toPandas()
            assert sorted(got.doc_id) == list(range(len(lengths))) and (got.shard == "x").all()
            got = got.sort_values(["sequence_id", "offset"])
            before = got.groupby("sequence_id").length.cumsum() - got.length
            assert (before == got.offset).all() and got.groupby("sequence_id").length.sum().max() <= 2048
            # Shards hold the same mix of lengths; windows, here small ones, don't.
            assert want <= got.sequence_id.nunique() <= want * (1.03 if order else 1.01) + 2, (k, order, want, got.sequence_id.nunique())
        # A window's sequences hold its own documents only, but those packed again with other windows' emptiest.
        ids, window = got.sequence_id.to_numpy(), got["rank"].to_numpy() // 500
        level = ids >> 22 & 15
        assert (ids >> 26 == window // 16**level * 16**level).all() and (level == 0).mean() > 0.5


def test_file_order(spark, tmp_path):
    df = spark.range(1000).repartitionByRange(7, F.col("id").desc()).sortWithinPartitions(F.col("id").desc())
    df.write.parquet(str(tmp_path / "x"))
    got = file_order(spark.read.parquet(str(tmp_path / "x")), "at").collect()
    assert sorted((r["at"], r["id"]) for r in got) == [(i, 999 - i) for i in range(1000)]
    assert file_order(spark.createDataFrame([(1, "a")], "id int, path string"), "at").collect()[0]["at"] == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("ab  \n\t1²'s!_é東😀\x1c\x85 ​﻿")) | st.characters(codec="utf-8"), max_size=40))
def test_encoder_equals_tokenizer_file(text):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert list(encoder(default_tokenizer())(text)) == own.encode(text, add_special_tokens=False).ids


def test_query_equals_brute_force(spark):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [r.asDict() for r in op3_best_fit_packing(spark, SMALL).collect()]
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    docs = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    assert len(by) == len(docs)
    for d in docs:
        ids = np.array([*own.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(by[d["doc_id"]], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(-(-len(ids) // 2048))) and all(r["length"] == 2048 for r in parts[1:])
        at = 0
        for r in parts:
            assert r["start"] == at and zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in held.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(held) == best_fit_decreasing([r["length"] for r in rows], 2048)


def test_edges(spark):
    rows = [(1, None, 0), (1, "", 0), (None, "a<|endoftext|>b", 0), (2, "word " * 5000, 0), (2, "x" * 20_000 + " " * 5_000, 0), (3, "tie", 0), (4, "tie", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, offset int")
    own = Tokenizer.from_file(default_tokenizer())
    placed = pack_documents(df, keep_ids=True).collect()
    made = {r["sequence_id"]: np.frombuffer(bytes(r["ids"]), "<u4") for r in sequences(spark.createDataFrame(placed)).collect()}
    assert sum(len(x) for x in made.values()) == sum(len(own.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    for r in placed:
        assert made[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]].tobytes() == bytes(r["ids"])
    assert pack_documents(df.limit(0)).collect() == []
