"""Operator 13: chat formatting by columnar byte assembly.

A turn is written as "### Name: text </turn>" and a line feed.  Inside texts and the
names of other roles a backslash quotes each backslash, each # that follows a #, and the
slash of "</turn>", so neither control string can stand there; reading drops a quoting
backslash.  All turns of a batch are assembled at once: numpy computes the length of
each segment (header, quoted text, end), cumulative offsets, and for every byte the
place it goes to, and headers and contents are copied into one preallocated buffer,
which becomes an Arrow string array without another copy.  The loss mask is the spans of
code points that hold the texts of the assistant.

A conversation is written in parts, of PART_TURNS turn numbers each, and parts are dealt
to tasks by conversation and part: a conversation that holds a third of all rows is
formatted by many tasks.  A part with more rows or bytes than fit in one buffer (repeated
turn numbers) is cut into pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from suitestat.llm.common import bound_batches, release

OPEN, END = "### ", " </turn>\n"
NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {name: role for role, name in NAMES.items()}
LEARNED = "assistant"
PART_TURNS = 512
#: Bytes of texts assembled into one buffer; a longer text has its own.
BUFFER = 32 << 20
#: Rows of one part that are held at once.
HELD_ROWS = 4096

_QUOTED = re.compile(r"\\|(?<=#)#|(?<=<)/(?=turn>)")
_UNQUOTE = re.compile(r"\\(.)", re.DOTALL)


def quote(text: str) -> str:
    return _QUOTED.sub(lambda m: "\\" + m[0], text)


def unquote(text: str) -> str:
    return _UNQUOTE.sub(r"\1", text) if "\\" in text else text


def header(role: str) -> bytes:
    """"### Assistant: " for the three known roles, "### =name: " with a quoted name for others."""
    return (OPEN + (NAMES.get(role) or "=" + quote(role).replace(":", "\\:")) + ": ").encode()


def assemble(roles: list[str], raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all turns, byte offsets of the turns, and (start, stop) bytes of each turn's text.

    raw: bytes of the texts; off: their offsets, one more than there are texts.
    """
    n = len(roles)
    size = np.diff(off)
    # Bytes that get a backslash: it stands before them.
    quoted = raw == 92
    first = np.zeros(len(raw) + 1, bool)
    first[off[:-1]] = True  # the bytes that begin a text: nothing before them counts
    hash_ = raw == 35
    quoted[1:] |= hash_[1:] & hash_[:-1] & ~first[1 : len(raw)]
    if len(raw) >= 7:
        end = np.ones(len(raw) - 6, bool)
        for i, c in enumerate(b"</turn>"):
            end &= raw[i : len(raw) - 6 + i] == c
        at = np.flatnonzero(end)
        at = at[np.searchsorted(off, at, side="right") == np.searchsorted(off, at + 6, side="right")]
        quoted[at + 1] = True
    extra = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(quoted, out=extra[1:])
    kinds = list(dict.fromkeys(roles))
    number = {r: i for i, r in enumerate(kinds)}
    kind = np.fromiter((number[r] for r in roles), np.int64, n)
    heads = [np.frombuffer(header(r), np.uint8) for r in kinds]
    close = np.frombuffer(END.encode(), np.uint8)
    head = np.array([len(h) for h in heads], np.int64)[kind] if n else np.zeros(0, np.int64)
    body = size + extra[off[1:]] - extra[off[:-1]]
    place = np.zeros(n + 1, np.int64)
    np.cumsum(head + body + len(close), out=place[1:])
    out = np.empty(int(place[-1]), np.uint8)
    start = place[:-1] + head
    stop = start + body
    # Texts: where each byte goes, with the backslashes up to it.
    to = np.repeat(start - off[:-1] - extra[off[:-1]], size)
    to += np.arange(len(raw))
    to += extra[1:]
    out[to] = raw
    out[to[quoted] - 1] = 92
    for k, h in enumerate(heads):
        out[place[:-1][kind == k][:, None] + np.arange(len(h))] = h
    out[stop[:, None] + np.arange(len(close))] = close
    return out, place, start, stop


def format_chats(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, part (long), piece (int), n_turns (long), formatted (string), loss (array<struct<start:int,stop:int>>, code points of formatted).

    A conversation is its rows in the order of part and piece: part is the turn number
    divided by PART_TURNS, so most have one row.  Turns are in order of turn, then role,
    then text; a null turn comes first, in part null; rows that repeat are turns of their
    own.  Null roles and texts are empty; a null key is a conversation of its own.  An empty table gives
    an empty table; other columns of df don't come out.  Memory is bounded by BUFFER or one text.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    own = StructType.fromDDL("part long, piece int, n_turns long, formatted string, loss array<struct<start:int,stop:int>>")
    if key.lower() in {f.name.lower() for f in own}:
        raise ValueError(f"the key can't be named {key}")
    spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def build(rows: pa.Table, ids: list, parts: list, pieces: list[int], first: np.ndarray) -> pa.RecordBatch:
        """A row for each group of rows: groups begin at first."""
        column = rows.column("r").combine_chunks() if rows.num_rows else pa.array([], pa.string())
        roles = [r or "" for r in column.to_pylist()]
        data = pa.concat_arrays(rows.column("t").chunks) if rows.num_rows else pa.array([], pa.large_binary())
        off = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        out, place, start, stop = assemble(roles, raw, off - off[0])
        edge = np.append(first, len(roles))
        # Offsets in code points: bytes that don't continue a character, counted up to a place.
        points = np.zeros(len(out) + 1, np.int64)
        np.cumsum((out & 0xC0) != 0x80, out=points[1:])
        group = np.repeat(np.arange(len(first)), np.diff(edge))
        base = points[place[first]][group]
        learned = np.array([r == LEARNED for r in roles], bool)
        loss = pa.StructArray.from_arrays([pa.array((points[x] - base)[learned], pa.int32()) for x in (start, stop)], names=["start", "stop"])
        loss_off = np.searchsorted(np.flatnonzero(learned), edge)
        formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(place[edge].astype(np.int64)), pa.py_buffer(out))
        columns = [pa.array(ids, id_type), pa.array(parts, pa.int64()), pa.array(pieces, pa.int32()), pa.array(np.diff(edge), pa.int64()), formatted.cast(pa.string()), pa.ListArray.from_arrays(pa.array(loss_off, pa.int32()), loss).cast(spans)]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        now: tuple | None = None  # the part whose rows are held, and its piece
        piece = 0

        def emit(rows: pa.Table) -> pa.RecordBatch:
            nonlocal now, piece
            marks = list(zip(rows.column("k").to_pylist(), rows.column("p").to_pylist(), strict=True))
            first = [i for i, m in enumerate(marks) if not i or m != marks[i - 1]]
            pieces = []
            for i in first:
                piece = piece + 1 if marks[i] == now else 0
                now = marks[i]
                pieces.append(piece)
            return build(rows, [marks[i][0] for i in first], [marks[i][1] for i in first], pieces, np.array(first, np.int64))

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows.set_column(3, "t", rows.column("t").cast(pa.large_binary()))
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            # What may go on in the next batch is held back; what is large goes piece by piece.
            marks = list(zip(rows.column("k").to_pylist(), rows.column("p").to_pylist(), strict=True))
            edge = len(marks)
            while edge and marks[edge - 1] == marks[-1]:
                edge -= 1
            sizes = np.cumsum(pc.binary_length(rows.column("t")).to_numpy())
            if len(marks) - edge >= HELD_ROWS or len(sizes) and sizes[-1] - (sizes[edge - 1] if edge else 0) >= BUFFER:
                edge = len(marks)
            begin = 0
            while begin < edge:
                done = sizes[begin - 1] if begin else 0
                upto = min(edge, max(begin + 1, int(np.searchsorted(sizes, done + BUFFER, side="right"))))
                if upto < edge:  # not within a part that would fit into the next buffer
                    back = upto
                    while back > begin and marks[back] == marks[back - 1]:
                        back -= 1
                    upto = back if back > begin else upto
                yield emit(rows.slice(begin, upto - begin))
                begin = upto
            held = rows.slice(edge) if edge < len(marks) else None
        if held is not None:
            yield emit(held)
        release()

    part = F.floor(F.col(turn) / PART_TURNS).cast("long")
    rows = bound_batches(df).select(F.col(key).alias("k"), part.alias("p"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("t"), F.col(turn).alias("n"))
    schema = StructType().add(key, df.schema[key].dataType)
    for field in own:
        schema = schema.add(field)
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(df.schema[key].dataType)
    return rows.repartition("k", "p").sortWithinPartitions("k", "p", "n", "r", "t").select("k", "p", "r", "t").mapInArrow(run, schema)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation or part."""
    turns = formatted.split(END)
    if turns.pop():
        raise ValueError("text after the last turn")
    for turn in turns:
        name, colon, text = turn.partition(": ")
        while name.startswith(f"{OPEN}=") and colon and (len(name) - len(name.rstrip("\\"))) % 2:  # a quoted colon belongs to the name
            more, colon, text = text.partition(": ")
            name += ": " + more
        if not colon or not name.startswith(OPEN):
            raise ValueError("a turn without a header")
        name = name[len(OPEN) :]
        yield (unquote(name[1:]) if name.startswith("=") else ROLES[name]), unquote(text)


def read_turns(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, part, piece, at (int), role, text of each turn of format_chats()' rows: its inverse, with null texts as empty ones."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                turns = list(parse(one.column(3)[0].as_py()))
                same = [pa.concat_arrays([one.column(i)] * len(turns)) if turns else one.column(i).slice(0, 0) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(range(len(turns)), pa.int32()), pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string())], names=schema.names)

    frame = bound_batches(chats).select(key, "part", "piece", "formatted")
    schema = frame.drop("formatted").schema
    for field in StructType.fromDDL("at int, role string, text string"):
        schema = schema.add(field)
    return frame.mapInArrow(run, schema)


def read_digests(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """A row for each conversation, read back from format_chats()' rows.

    key, n_turns, turns_sha256 (role, line feed, text, line feed of each turn), loss_chars,
    loss_sha256 (what stands under the loss mask, unquoted) and formatted_chars.  The parts
    of a conversation stream past its hashes in order; what is kept is their state.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, None
        for batch in batches:
            done = []
            for i, text, spans in zip(*(batch.column(c).to_pylist() for c in (0, 3, 4)), strict=True):
                if open_ is None or i != now:
                    if open_ is not None:
                        done.append((now, *close(open_)))
                    now, open_ = i, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    open_[0] += 1
                    open_[1].update(f"{role}\n{said}\n".encode())
                for s in spans:
                    learned = unquote(text[s["start"] : s["stop"]])
                    open_[2] += len(learned)
                    open_[3].update(learned.encode())
                open_[4] += len(text)
            yield pack(done)
        if open_ is not None:
            yield pack([(now, *close(open_))])
        release()

    def close(x: list) -> tuple:
        return x[0], x[1].hexdigest(), x[2], x[3].hexdigest(), x[4]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(chats.schema[key].dataType)
    schema = StructType().add(key, chats.schema[key].dataType)
    for field in StructType.fromDDL("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"):
        schema = schema.add(field)
    frame = bound_batches(chats).select(key, "part", "piece", "formatted", "loss")
    return frame.repartition(key).sortWithinPartitions(key, "part", "piece").mapInArrow(run, schema)
