"""Chat formatting by columnar byte assembly.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts the escape character ``\\x1b``
and the first character of a control string are preceded by ``\\x1b``, and line breaks of a role are written
``\\x1bn``; reading undoes it, so any text comes back as it was. Assistant texts are under the loss mask.

A batch of turns is assembled at once: the byte lengths of all segments (fixed header, role, line break, text, fixed footer) give
cumulative offsets, offsets give the place of every source byte, and one numpy scatter per kind of segment fills a
preallocated buffer that becomes the data of an Arrow column. Turns stream in order of conversation and turn, so a
conversation of any length is never held whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, ESCAPE = "<|im_start|>", "<|im_end|>", "\x1b"
ASSISTANT = "assistant"
FORMAT = "conv_id long, turn long, seq long, formatted string, loss_start long, loss_end long"


def escaped(column: pa.Array, role: bool = False) -> pa.Array:
    out = pc.replace_substring(column.fill_null(""), ESCAPE, ESCAPE + ESCAPE)
    for s in (START, END):
        out = pc.replace_substring(out, s, ESCAPE + s)
    return pc.replace_substring(out, "\n", ESCAPE + "n") if role else out


def unescaped(text: str, role: bool = False) -> str:
    out, at = [], 0
    while (i := text.find(ESCAPE, at)) >= 0:
        out.append(text[at:i])
        nxt = text[i + 1:i + 2]
        out.append("\n" if role and nxt == "n" else nxt)
        at = i + 2
    return "".join(out) + text[at:]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and start-and-end offsets of a string column."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], "<i8")[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def assemble(roles: pa.Array, texts: pa.Array) -> pa.Array:
    """One formatted string per turn, made in a single buffer."""
    n = len(roles)
    head, middle, foot = (np.frombuffer(x.encode(), np.uint8) for x in (START, "\n", END + "\n"))
    role_data, role_at = _bytes(escaped(roles, role=True))
    text_data, text_at = _bytes(escaped(texts))
    sizes = np.empty((n, 5), np.int64)
    sizes[:, 0], sizes[:, 2], sizes[:, 4] = len(head), len(middle), len(foot)
    sizes[:, 1], sizes[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(sizes.ravel()).reshape(n, 5)
    starts = ends - sizes
    buffer = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, fixed in ((0, head), (2, middle), (4, foot)):
        buffer[(starts[:, k, None] + np.arange(len(fixed))).ravel()] = np.tile(fixed, n)
    for k, data, at in ((1, role_data, role_at), (3, text_data, text_at)):
        # Source byte i of row r goes to the row's start plus its place in the row.
        shift = np.repeat(starts[:, k] - at[:-1], sizes[:, k])
        buffer[np.arange(at[0], at[-1]) + shift] = data[at[0]:at[-1]]
    offsets = np.concatenate(([0], ends[:, -1])) if n else np.zeros(1, np.int64)
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(buffer)])


def format_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn, seq (place among the task's rows), formatted, and the half-open range of code points in
    ``formatted`` that is under the loss mask (empty for other roles).

    Rows come out sorted by conversation, turn, role and text within partitions, a conversation in one partition; joined in
    that order they are the conversation's text. Null roles and texts count as empty, null turns come first, null
    conversations are one conversation; repeated rows are repeated turns; extra columns are ignored; no rows give none.
    """
    def run(batches):
        seq = 0
        for b in batches:
            made = assemble(b.column(2), b.column(3))
            lengths = pc.utf8_length(made).to_numpy(zero_copy_only=False)
            loss = pc.equal(b.column(2), ASSISTANT).fill_null(False).to_numpy(zero_copy_only=False)
            start = len(START) + len(ASSISTANT) + 1
            first = np.where(loss, start, 0).astype(np.int64)
            last = np.where(loss, lengths - len(END) - 1, 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.arange(seq, seq + len(lengths))), made.cast(pa.string()), pa.array(first), pa.array(last)],
                names=["conv_id", "turn", "seq", "formatted", "loss_start", "loss_end"])
            seq += len(lengths)

    rows = conversations.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                                F.col(role).alias("role"), F.col(text).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, FORMAT)


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not (formatted.startswith(START) and formatted.endswith(END + "\n")):
        raise ValueError("no formatted turn")
    role, _, text = formatted[len(START):-len(END) - 1].partition("\n")
    return unescaped(role, role=True), unescaped(text)


def digest(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from formatted turns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns stream through running hashes in the order of ``seq``; memory holds a batch and the states of one conversation.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        now, state = None, None
        out: list[tuple] = []

        def close():
            n, turns, chars, loss, size = state
            out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        def rows():
            cols = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
            out.clear()
            return batch

        for b in batches:
            for conv, made, first, last in zip(*(b.column(i).to_pylist() for i in range(4))):
                if state is None or conv != now:
                    if state is not None:
                        close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(made)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if last > first:
                    masked = unescaped(made[first:last])
                    state[2] += len(masked)
                    state[3].update(masked.encode("utf-8", "surrogatepass"))
                state[4] += len(made)
            yield rows()
        if state is not None:
            close()
            yield rows()

    ordered = turns.select("conv_id", "formatted", "loss_start", "loss_end", "seq").repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
