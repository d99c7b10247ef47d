"""Chat formatting by columnar byte assembly.

A batch of turns becomes one byte buffer: numpy computes the lengths of all segments (header, content, footer), their offsets
by a running sum and the scatter indices, and copies the segments into one preallocated buffer that Arrow then reads.

Template: `<|im_start|>` role newline text `<|im_end|>` newline. Inside roles and texts a backslash is doubled and a control string gets
a backslash after its first character, so no control string can occur there, and dropping each backslash that stands before a
character restores the text exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

START, STOP = "<|im_start|>", "<|im_end|>\n"
#: Control strings of the template and of other common ones. Fixed values.
CONTROL = ("<|", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>")
_SUSPECT = r"\\|<\||\[/?INST\]|</?s>|<</?SYS>>"
#: A conversation longer than this many bytes is given out in parts, at turns, one after the other.
PART_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20
TARGET_ROLE = "assistant"


def escape(column: pa.Array, role: bool = False) -> pa.Array:
    column = column.cast(pa.large_string()).fill_null("")
    if not pc.any(pc.match_substring_regex(column, _SUSPECT + (r"|\n" if role else ""))).as_py():
        return column
    column = pc.replace_substring(column, "\\", "\\\\")
    for x in (*CONTROL, *(("\n",) if role else ())):
        column = pc.replace_substring(column, x, x[0] + "\\" + x[1:] if x != "\n" else "\\\n")
    return column


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def assemble(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates string columns row by row: the bytes and the offsets of all segments (rows times columns, and the end)."""
    rows, width = len(columns[0]), len(columns)
    sources, starts, lengths = [], np.empty((rows, width), np.int64), np.empty((rows, width), np.int64)
    base = 0
    for k, c in enumerate(columns):
        _, at, data = c.buffers()
        at = np.frombuffer(at, np.int64)[c.offset : c.offset + rows + 1]
        own = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        starts[:, k], lengths[:, k] = at[:-1] - at[0] + base, np.diff(at)
        sources.append(own)
        base += len(own)
    source, offsets = np.concatenate(sources), np.concatenate([[0], np.cumsum(lengths.ravel())])
    out = np.empty(offsets[-1], np.uint8)
    flat, begin = lengths.ravel(), starts.ravel()
    row = 0
    while row < len(flat):  # blocks bound the index arrays
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1)
        stop = min(stop, len(flat))
        index = np.arange(offsets[stop] - offsets[row]) + np.repeat(begin[row:stop] - (offsets[row:stop] - offsets[row]), flat[row:stop])
        out[offsets[row] : offsets[stop]] = source[index]
        row = stop
    return out, offsets


_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.large_string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order of conv_id and turn -> parts of conversations; loss spans are byte positions in the part's UTF-8."""
    conv, part, held, spans, size = None, 0, [], [], 0
    done: list[tuple] = []

    def close():
        nonlocal held, spans, size, part
        if held:
            done.append((conv, part, b"".join(held), [a for a, _ in spans], [b for _, b in spans]))
            part += 1
        held, spans, size = [], [], 0

    def flush():
        rows = list(zip(*done))
        data = pa.array([x.decode() for x in rows[2]], pa.large_string())
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), data, pa.array(rows[3], pa.list_(pa.int64())), pa.array(rows[4], pa.list_(pa.int64()))], schema=_PARTS)

    begun = False
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        role, text = b.column(1), b.column(2)
        one = lambda s: pa.array([s] * n, pa.large_string())
        data, at = assemble([one(START), escape(role, True), one("\n"), escape(text), one(STOP)])
        at = np.append(at[:-1].reshape(n, 5), np.full((1, 5), at[-1]), axis=0)
        ids = b.column(0).to_pylist()
        target = pc.equal(role.cast(pa.string()), TARGET_ROLE).fill_null(False).to_pylist()
        for r in range(n):
            if not begun or ids[r] != conv:
                close()
                conv, part, begun = ids[r], 0, True
            elif size >= PART_BYTES:
                close()
            if target[r]:
                spans.append((size + int(at[r, 3] - at[r, 0]), size + int(at[r, 4] - at[r, 0])))
            turn = data[at[r, 0] : at[r + 1, 0]].tobytes()
            held.append(turn)
            size += len(turn)
        if len(done) >= 256 or sum(len(x[2]) for x in done) > PART_BYTES:
            yield flush()
            done = []
    close()
    if done:
        yield flush()


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, part, formatted, loss_starts, loss_ends: one row per conversation (several parts, in order and next to each other, if it is very long).

    Null texts and roles are empty. Turns come in order of turn (null first), ties by role and text. Repeated rows are turns of their own. A null
    conv_id is a conversation. An empty table gives an empty table; extra columns are ignored.
    """
    prepare(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(_format, "conv_id long, part long, formatted string, loss_starts array<long>, loss_ends array<long>")


_TURN = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(STOP), re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digest(batches):
    """Reads formatted parts back."""
    conv, state, done = None, None, []

    def close():
        if state:
            done.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    for b in batches:
        for c, part, formatted, starts, ends in zip(*(x.to_pylist() for x in b.columns)):
            if part == 0:
                close()
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            raw = formatted.encode()
            for s, e in zip(starts, ends):
                text = unescape(raw[s:e].decode())
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(formatted)
        if len(done) > 500:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*done), _DIGEST)], schema=_DIGEST)
            done = []
    close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*done), _DIGEST)], schema=_DIGEST)


def chat_digest(conversations: DataFrame) -> DataFrame:
    """What a reader gets back from the formatted conversations: counts and digests."""
    parts = format_chats(conversations)
    return parts.select("conv_id", "part", "formatted", "loss_starts", "loss_ends").mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _escaped_sql(column: str, role: bool = False) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for x in CONTROL:
        out = f"replace({out}, '{x}', '{x[0]}\\{x[1:]}')"
    return f"replace({out}, chr(10), '\\' || chr(10))" if role else out


#: DuckDB SQL for op3: the digest of the table and conversation -7.
CHAT_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum({len(START) + 1 + len(STOP)} + length({_escaped_sql("role", True)}) + length({_escaped_sql("text")})) AS formatted_chars
  FROM t GROUP BY 1
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
