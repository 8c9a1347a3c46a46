"""Chat formatting by columnar byte assembly.

The turns of a batch become one byte buffer: segment lengths and cumulative
offsets are numpy arrays, and headers and contents are scattered into one
preallocated buffer that Arrow wraps without another copy.

Template: each turn is `<s>[ROLE]\\n` + text + `\\n[/ROLE]</s>\\n`, where ROLE is the
turn's role. Texts and roles are escaped so that no control string survives inside
them: `\\` becomes `\\\\`, `[` becomes `\\(` , `]` becomes `\\)` and `<` becomes `\\{`.
Escaping is reversible, so turns are read back exactly.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Escapes of the template.
ESCAPES = {"\\": "\\\\", "[": "\\(", "]": "\\)", "<": "\\{"}
BACK = {v[1]: k for k, v in ESCAPES.items()}
UNESCAPE = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"<s>\[([^\[\]]*)\]\n([^\[\]<]*)\n\[/\1\]</s>\n")


def escape(values: pa.Array) -> pa.Array:
    for plain, safe in ESCAPES.items():
        values = pc.replace_substring(values, plain, safe)
    return values


def unescape(text: str) -> str:
    return UNESCAPE.sub(lambda m: BACK[m[1]], text) if "\\" in text else text


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array."""
    values = pc.fill_null(values.cast(pa.large_string()), "")
    raw = values.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64, count=len(values) + 1 + values.offset)[values.offset :]
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return offsets, data


def assemble(segments: list[pa.Array | bytes], n: int) -> pa.LargeStringArray:
    """Concatenate segments row by row into one preallocated buffer.

    segments: string arrays of `n` rows, or constants.
    """
    parts = []
    for s in segments:
        if isinstance(s, bytes):
            data = np.frombuffer(s, dtype=np.uint8)
            parts.append((np.zeros(n, np.int64), np.full(n, len(s), np.int64), data))
        else:
            offsets, data = _bytes(s)
            parts.append((offsets[:-1], np.diff(offsets), data))
    lengths = np.stack([p[1] for p in parts], axis=1)  # row, segment
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    starts = ends - lengths
    total = int(ends[-1, -1]) if n else 0
    out = np.empty(total, dtype=np.uint8)
    for k, (source, length, data) in enumerate(parts):
        moved = int(length.sum())
        if not moved:
            continue
        # For each byte of this segment in all rows: where it comes from and where it goes.
        step = np.arange(moved, dtype=np.int64) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(starts[:, k], length) + step] = data[np.repeat(source, length) + step]
    offsets = np.concatenate([[0], ends[:, -1]]) if n else np.zeros(1, np.int64)
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The formatted segment of each turn: (conv_id, turn, position key, formatted, loss_start, loss_end).

    A conversation is its segments one after the other by turn (ties: role, then text;
    null turns first); `loss_start` and `loss_end` are code point offsets in the segment
    of the text that is trained on, equal unless the role is assistant. A null role or
    text counts as empty. Rows are independent, so a conversation of any length is
    assembled by many tasks; repeated rows stay; columns besides the four are ignored.
    """
    cols = turns.select(
        turns[conv_col].alias("conv"), turns[turn_col].alias("turn"),
        F.coalesce(turns[role_col], F.lit("")).alias("role"), F.coalesce(turns[text_col], F.lit("")).alias("text"),
    )
    conv_kind, turn_kind = dict(cols.dtypes)["conv"], dict(cols.dtypes)["turn"]

    def run(batches):
        for big in batches:
            for batch in _pieces(big):
                n = batch.num_rows
                role, text = escape(batch.column("role")), escape(batch.column("text"))
                made = assemble([b"<s>[", role, b"]\n", text, b"\n[/", role, b"]</s>\n"], n)
                head = pc.add(pc.utf8_length(role), 6).cast(pa.int64())
                size = pc.if_else(pc.equal(batch.column("role"), "assistant"), pc.utf8_length(text), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("conv"), batch.column("turn"), batch.column("role"), batch.column("text"), made.cast(pa.string()), head, pc.add(head, size)],
                    names=["conv", "turn", "role", "text", "formatted", "loss_start", "loss_end"],
                )

    made = cols.mapInArrow(run, f"conv {conv_kind}, turn {turn_kind}, role string, text string, formatted string, loss_start bigint, loss_end bigint")
    return made.withColumnsRenamed({"conv": conv_col, "turn": turn_col})


def _pieces(batch: pa.RecordBatch, limit: int = 8 << 20):
    from .common import slices

    yield from slices(batch, "text", limit)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of formatted text."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError("not formatted text")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def digest(segments: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", partitions: int | None = None) -> DataFrame:
    """Per conversation, read back from its segments: turns, digests and lengths.

    SHA-256 has to see a conversation's turns in order, so its rows go to one task,
    sorted by Spark (which spills) and streamed: the task holds one turn and the running
    hash states, never the conversation.
    """
    key = F.struct(F.col(turn_col), F.col("role"), F.col("text"))
    rows = segments.select(F.col(conv_col).alias("conv"), key.alias("key"), "formatted", "loss_start", "loss_end")
    n = partitions or int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "conv").sortWithinPartitions("conv", "key").select("conv", "formatted", "loss_start", "loss_end")
    kind = dict(rows.dtypes)["conv"]
    schema = f"conv {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def run(batches):
        names = [x.split()[0] for x in schema.split(", ")]
        started, current, state = False, None, None

        def done():
            return (current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        arrow = None
        for batch in batches:
            arrow = batch.schema.field("conv").type
            out = []
            for conv, text, a, b in zip(*(batch.column(k).to_pylist() for k in ("conv", "formatted", "loss_start", "loss_end"))):
                if not started or conv != current:
                    if started:
                        out.append(done())
                    started, current, state = True, conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_back(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                loss = unescape(text[a:b])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(text)
            if out:
                yield _rows(out, names, arrow)
        if started:
            yield _rows([done()], names, arrow)

    return rows.mapInArrow(run, schema).withColumnRenamed("conv", conv_col)


def _rows(out, names, conv):
    kinds = [conv, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), kinds)], names=names)
