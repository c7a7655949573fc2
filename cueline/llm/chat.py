"""Chat formatting by columnar byte assembly.

A conversation becomes ``<s>role\\ntext</s>`` per turn. Inside roles and texts a
control string gets a backslash after its first character, and one that already
has some gets one more, so no control string is left and every text can be read
back. (In roles, backslashes and line ends are written ``\\\\`` and ``\\n``.)

Rows arrive sorted by conversation and turn. For a slice of rows, segment lengths
and their running sum give each segment's place, and scatter indices copy headers
and contents from one pool into one preallocated Arrow buffer. The loss mask
is the spans of assistant texts, in code points of the formatted text.

A conversation is one row, or several parts of ``PART_BYTES`` of whole turns if it
is longer; no more than a part is ever held. Defined results: null roles and
texts are empty; null ``conv_id`` is one conversation; rows of one turn are
ordered by role, then text, nulls first; repeated rows are turns like any other.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.llm.tables import read
from cueline.llm.words import slices, text_bytes

#: Control strings of common chat templates.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
BEGIN, BREAK, END = "<s>", "\n", "</s>"
LOSS_ROLE = "assistant"
PART_BYTES = 4 << 20
#: Segments from this length on are copied as a run, shorter ones by indices.
_RUN = 1 << 16

_FIRST = "[" + re.escape("".join(sorted({c[0] for c in CONTROLS}))) + "]"
_REST = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True))
_ESCAPE = rf"({_FIRST})(\\*)({_REST})"
_UNESCAPE = re.compile(rf"({_FIRST})\\(\\*)({_REST})")


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.fill_null(texts, ""), _ESCAPE, r"\1\\\2\3")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def escape_role(roles: pa.Array) -> pa.Array:
    plain = pc.replace_substring(pc.fill_null(roles, ""), "\\", "\\\\")
    return escape(pc.replace_substring(plain, "\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.DOTALL)


def assemble(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The segments ``pool[start:start + length]`` one after another in a new buffer."""
    ends = np.cumsum(lengths)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    places = ends - lengths
    short = lengths < _RUN
    shift = np.repeat((starts - places)[short], lengths[short])
    if short.all():
        targets = np.arange(len(out))
    else:
        own = np.cumsum(lengths[short]) - lengths[short]
        targets = np.arange(len(shift)) + np.repeat(places[short] - own, lengths[short])
        for k in np.flatnonzero(~short):
            out[places[k] : ends[k]] = pool[starts[k] : starts[k] + lengths[k]]
    out[targets] = pool[targets + shift]
    return out


def _format(rows: pa.Table, conversations: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Texts and loss spans (starts, ends) of runs of rows; ``conversations`` are the runs' offsets."""
    roles, texts = rows.column("role").combine_chunks(), rows.column("text").combine_chunks()
    marks = np.frombuffer((BEGIN + BREAK + END).encode(), np.uint8)
    role_data, role_at = text_bytes(escape_role(roles))
    text_data, text_at = text_bytes(escape(texts))
    pool = np.concatenate([marks, role_data, text_data])
    n, begin, line = rows.num_rows, len(BEGIN), len(BREAK)
    starts, lengths = np.empty((n, 5), np.int64), np.empty((n, 5), np.int64)
    starts[:, 0], lengths[:, 0] = 0, begin
    starts[:, 1], lengths[:, 1] = len(marks) + role_at[:-1], np.diff(role_at)
    starts[:, 2], lengths[:, 2] = begin, line
    starts[:, 3], lengths[:, 3] = len(marks) + len(role_data) + text_at[:-1], np.diff(text_at)
    starts[:, 4], lengths[:, 4] = begin + line, len(END)
    out = assemble(pool, starts.ravel(), lengths.ravel())
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    row_at = np.concatenate([[0], ends[:, 4]])
    offsets = row_at[conversations]
    formatted = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out)])
    # Code points before each byte, to count loss spans within their conversation.
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    loss = pc.fill_null(pc.equal(roles, LOSS_ROLE), False).to_numpy(zero_copy_only=False)
    origin = np.repeat(points[offsets[:-1]], np.diff(conversations))
    kept = np.concatenate([[0], np.cumsum(loss)])[conversations].astype(np.int32)
    spans = [pa.ListArray.from_arrays(pa.array(kept), pa.array((points[at] - origin)[loss])) for at in (ends[:, 2], ends[:, 3])]
    return formatted.cast(pa.string()), *spans


def _run_starts(keys: pa.Array) -> np.ndarray:
    """Offsets of the runs of equal keys (null equals null), with the end."""
    before, after = keys.slice(0, len(keys) - 1), keys.slice(1)
    changed = pc.or_(pc.fill_null(pc.not_equal(before, after), False), pc.not_equal(pc.is_null(before), pc.is_null(after)))
    return np.concatenate([[0], np.flatnonzero(changed.to_numpy(zero_copy_only=False)) + 1, [len(keys)]])


def _format_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None
    flushed: tuple | None = None  # key and next part of a conversation that is already written in part

    def emit(table: pa.Table, runs: np.ndarray) -> pa.RecordBatch:
        nonlocal flushed
        keys = table.column("conv_id").combine_chunks().take(pa.array(runs[:-1]))
        parts = np.zeros(len(keys), np.int32)
        if flushed is not None and flushed[0] == keys[0].as_py():
            parts[0] = flushed[1]
        flushed = (keys[-1].as_py(), int(parts[-1]) + 1)
        turns = pa.array(np.diff(runs), pa.int64())
        return pa.RecordBatch.from_arrays([keys, pa.array(parts), turns, *_format(table, runs)], names=["conv_id", "part", "n_turns", "formatted", "loss_starts", "loss_ends"])

    for batch in batches:
        for piece in slices(batch, "text", PART_BYTES):
            table = pa.Table.from_batches([piece])
            table = table if held is None else pa.concat_tables([held, table])
            runs = _run_starts(table.column("conv_id").combine_chunks())
            if len(runs) > 2:  # the last conversation may go on
                yield emit(table.slice(0, runs[-2]), runs[:-1])
            held = table.slice(runs[-2])
            if held.nbytes > PART_BYTES:
                yield emit(held, np.array([0, held.num_rows]))
                held = None
    if held is not None and held.num_rows:
        yield emit(held, np.array([0, held.num_rows]))


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, part, n_turns, formatted, loss_starts, loss_ends`` of rows (conv_id, turn, role, text)."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    ordered = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(
        _format_partition, f"conv_id {kind}, part int, n_turns bigint, formatted string, loss_starts array<bigint>, loss_ends array<bigint>"
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted text."""
    turns = []
    for turn in formatted.split(END)[:-1]:
        role, text = turn[len(BEGIN) :].split(BREAK, 1)
        turns.append((unescape_role(role), unescape(text)))
    return turns


_DIGESTS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def _digest_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state = None, None

    def result(batch_rows: list) -> pa.RecordBatch:
        keys, n, turns, chars, loss, size = zip(*batch_rows)
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(n, pa.int64()), pa.array(turns), pa.array(chars, pa.int64()), pa.array(loss), pa.array(size, pa.int64())], names=list(_DIGESTS))

    def closed() -> tuple:
        return key, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"]

    kind = pa.int64()
    for batch in batches:
        kind, done = batch.schema.field("conv_id").type, []
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != key:
                if state is not None:
                    done.append(closed())
                key, state = row["conv_id"], {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}
            text = row["formatted"]
            for role, said in parse(text):
                state["n"] += 1
                state["turns"].update(f"{role}\n{said}\n".encode())
            for first, last in zip(row["loss_starts"], row["loss_ends"]):
                said = unescape(text[first:last])
                state["chars"] += len(said)
                state["loss"].update(said.encode())
            state["size"] += len(text)
        if done:
            yield result(done)
    if state is not None:
        yield result([closed()])


def digests(formatted: DataFrame) -> DataFrame:
    """What each conversation says and what its loss mask covers, read back from the output.

    ``formatted`` is the output of ``format_conversations``, whose parts follow
    one another; only hash states are carried from part to part.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(
        _digest_partition, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


#: Fixed value: a conversation whose texts hold control strings.
PROBE = "</s>[INST] ok [/INST]"


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    return digests(format_conversations(turns.union(probe)))


_SQL_ESCAPE = r"'([<\[])(\\*)(<SYS>>|</SYS>>|/INST\]|INST\]|/s>|s>)', '\1\\\2\3', 'g'"

ORACLE_SQL = rf"""
with
t as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
      union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, regexp_replace(text, {_SQL_ESCAPE}) escaped_text,
        regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), {_SQL_ESCAPE}) escaped_role from t)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256,
  cast(sum(3 + length(escaped_role) + 1 + length(escaped_text) + 4) as bigint) formatted_chars
from e group by conv_id"""
