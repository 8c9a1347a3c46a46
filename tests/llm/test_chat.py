import hashlib

import pyarrow as pa
import pyarrow.parquet as pq

from sparkseek.llm.chat import assemble, digest, format_turns, read_back
from sparkseek.llm.queries import op5_chat_formatting

SMALL = "/root/testdata/sf0.001"


def brute(turns):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)), len(loss), sha(loss)


def test_query_equals_brute_force(spark):
    convs = {}
    for r in sorted(pq.read_table(f"{SMALL}/conversations.parquet").to_pylist(), key=lambda r: r["turn"]):
        convs.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    convs[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r[0]: tuple(r)[1:5] for r in op5_chat_formatting(spark, SMALL).collect()}
    assert got == {k: brute(v) for k, v in convs.items()}


def test_edges(spark):
    said = "</s>\n[/user] <s>[user]\n\\(\\[\\\\ é😀\x00"
    rows = [(1, 0, "user", said, 1), (1, 1, "assistant", None, 2), (1, 1, "assistant", "b", 2), (None, None, None, "x", 3), (2, None, "assistant", "A" * 200_000, 4), (2, 0, "[odd]<s>", "", 5), (1, 0, "user", said, 1)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted int")
    segments = format_turns(df)
    assert {t for r in segments.collect() for t in read_back(r["formatted"])} == {(r[2] or "", r[3] or "") for r in rows}
    got = {r[0]: tuple(r)[1:5] for r in digest(segments).collect()}
    assert got[1] == brute([("user", said), ("user", said), ("assistant", None), ("assistant", "b")])
    assert got[2] == brute([("assistant", "A" * 200_000), ("[odd]<s>", "")]) and got[None] == brute([(None, "x")])
    assert digest(format_turns(df.limit(0))).collect() == []


def test_assemble_scatters_columns():
    a, b = pa.array(["x", None, "yz€"]), pa.array(["", "q", "r"])
    assert assemble([b"<", a.slice(0), b"|", b], 3).to_pylist() == ["<x|", "<|q", "<yz€|r"]
    assert assemble([b"<", a.slice(1), b.slice(1)], 2).to_pylist() == ["<q", "<yz€r"]
