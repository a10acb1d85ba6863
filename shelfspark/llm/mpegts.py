"""MPEG transport streams as a media column: writing, parsing and checking.

`mux` stores a payload losslessly as one private elementary stream: a program association
table, a program map table, then elementary (PES) packets with presentation times, the
first transport packet of each marked as a random-access point with a clock reference.
`demux` reads a stream back: it parses the program tables (with their CRC), follows the
elementary stream's packet identifier, checks continuity counters, reassembles the
elementary packets and returns their times and random-access points.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added, free, utf8

#: Fixed values of the transport stream format.
PACKET = 188
SYNC = 0x47
PAT_PID = 0x0000
PRIVATE_STREAM = 0xBD
PRIVATE_TYPE = 0x06
CLOCK = 90_000

#: Layout chosen here.
PMT_PID = 0x0100
DATA_PID = 0x0101
PROGRAM = 1
PES_BYTES = 9_600  # payload of one elementary packet; a multiple of the padding unit
PES_TICKS = 3_600  # 40 ms between elementary packets
UNIT = 192


def _crc_table() -> np.ndarray:
    table = np.zeros(256, np.uint32)
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
        table[i] = c & 0xFFFFFFFF
    return table


_CRC = _crc_table().tolist()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc32_mpeg(head + body))


def _table_packet(pid: int, section: bytes) -> bytes:
    head = struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10)
    return (head + b"\x00" + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(PAT_PID, _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE_TYPE, 0xE000 | DATA_PID, 0xF000)))


def _stamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 29 & 0x0E) | 1, t >> 22 & 0xFF, (t >> 14 & 0xFE) | 1, t >> 7 & 0xFF, (t << 1 & 0xFE) | 1])


def _read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def _pes(payload: bytes, number: int, counter: int) -> np.ndarray:
    """Transport packets (rows) of one elementary packet."""
    time = number * PES_TICKS & (1 << 33) - 1
    head = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + struct.pack(">H", len(payload) + 8) + b"\x84\x80\x05" + _stamp(2, time)
    data = np.frombuffer(head + payload, np.uint8)
    first = 176  # bytes beside header (4) and adaptation field (8) of the first packet
    rest = max(0, len(data) - first)
    n = 1 + -(-rest // 184)
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0] = SYNC
    out[:, 1] = DATA_PID >> 8
    out[:, 2] = DATA_PID & 0xFF
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 0x0F
    # first packet: start flag, adaptation field with random access and clock reference
    out[0, 1] |= 0x40
    out[0, 3] |= 0x20
    base = time
    fill = max(0, first - len(data))
    out[0, 4:6] = (7 + fill, 0x50)
    out[0, 6:12] = (base >> 25 & 0xFF, base >> 17 & 0xFF, base >> 9 & 0xFF, base >> 1 & 0xFF, (base & 1) << 7 | 0x7E, 0)
    out[0, 12 + fill :] = data[: first - fill]
    full, last = divmod(rest, 184)
    body = data[first:]
    if full:
        out[1 : 1 + full, 4:] = body[: 184 * full].reshape(full, 184)
    if last:  # stuffing in an adaptation field, so that the data ends the packet
        pad = 184 - last
        out[-1, 3] |= 0x20
        out[-1, 4] = pad - 1
        if pad > 1:
            out[-1, 5] = 0
        out[-1, PACKET - last :] = body[184 * full :]
    return out


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream."""
    parts, counter = [TABLES], 0
    for number, at in enumerate(range(0, len(payload), PES_BYTES)):
        rows = _pes(payload[at : at + PES_BYTES], number, counter)
        counter = counter + len(rows) & 0x0F
        parts.append(rows.tobytes())
    return b"".join(parts)


@dataclass
class Stream:
    """What a transport stream holds; times in 90 kHz ticks, points as packet numbers."""

    payload: bytes = b""
    packets: int = 0
    program: int = -1
    pmt_pid: int = -1
    data_pid: int = -1
    stream_type: int = -1
    errors: int = 0
    elementary: int = 0
    times: list[int] = field(default_factory=list)
    points: list[int] = field(default_factory=list)
    clocks: list[int] = field(default_factory=list)

    def feature(self) -> str:
        span = self.times[-1] - self.times[0] if self.times else 0
        return (f"packets={self.packets};program={self.program};pmt={self.pmt_pid};pid={self.data_pid};type={self.stream_type}"
                f";pes={self.elementary};errors={self.errors};first={self.times[0] if self.times else -1};span={span}"
                f";access={len(self.points)};last_access={self.points[-1] if self.points else -1}")


def _tables(rows: np.ndarray, pid: np.ndarray, want: int) -> bytes:
    """The section that a table's first packet carries."""
    at = np.flatnonzero((pid == want) & (rows[:, 1] & 0x40 != 0))
    if not len(at):
        raise ValueError(f"no table on packet identifier {want}")
    row = rows[at[0]].tobytes()
    start = 4 + (1 + row[4] if row[3] & 0x20 else 0)
    start += 1 + row[start]
    size = 3 + (struct.unpack(">H", row[start + 1 : start + 3])[0] & 0x0FFF)
    section = row[start : start + size]
    if crc32_mpeg(section):
        raise ValueError("table checksum differs")
    return section


def demux(media: bytes) -> Stream:
    """Parse a transport stream; raises ValueError where its frame or tables are broken.

    Continuity faults are counted; a duplicate packet (same counter as the one before) is
    dropped, as the format asks.
    """
    if len(media) % PACKET or not media:
        raise ValueError("not whole packets")
    rows = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != SYNC).any():
        raise ValueError("lost synchronisation")
    pid = (rows[:, 1].astype(np.int64) & 0x1F) << 8 | rows[:, 2]
    out = Stream(packets=len(rows))
    pat = _tables(rows, pid, PAT_PID)
    out.program, out.pmt_pid = (x & m for x, m in zip(struct.unpack(">HH", pat[8:12]), (0xFFFF, 0x1FFF)))
    pmt = _tables(rows, pid, out.pmt_pid)
    skip = 12 + (struct.unpack(">H", pmt[10:12])[0] & 0x0FFF)
    out.stream_type, out.data_pid = pmt[skip], struct.unpack(">H", pmt[skip + 1 : skip + 3])[0] & 0x1FFF
    where = np.flatnonzero(pid == out.data_pid)
    data = rows[where]
    flags = data[:, 3] >> 4
    counter = (data[:, 3] & 0x0F).astype(np.int64)
    carries = flags & 1 == 1
    step = np.diff(counter) & 0x0F
    out.errors = int((step[carries[1:]] > 1).sum() + (step[~carries[1:]] != 0).sum()) if len(step) else 0
    again = np.concatenate([[False], (step == 0) & carries[1:]]) if len(data) else np.zeros(0, bool)
    out.errors += int(((rows[where, 1] & 0x80) != 0).sum())
    field_size = np.where(flags & 2 == 2, 1 + data[:, 4].astype(np.int64), 0)
    starts = data[:, 1] & 0x40 != 0
    has = (flags & 2 == 2) & (data[:, 4] > 0)
    access = has & (data[:, 5] & 0x40 != 0)
    out.points = where[access].tolist()
    for row in data[has & (data[:, 5] & 0x10 != 0)]:
        b = row[6:12].tolist()
        out.clocks.append(b[0] << 25 | b[1] << 17 | b[2] << 9 | b[3] << 1 | b[4] >> 7)
    keep = carries & ~again
    mask = np.arange(PACKET)[None, :] >= (4 + field_size)[:, None]
    mask &= keep[:, None]
    size = mask.sum(1)
    flat = data[mask].tobytes()
    ends = np.cumsum(size)
    begin = (ends - size)[starts & keep].tolist()
    pieces = []
    for a, b in zip(begin, [*begin[1:], len(flat)]):
        head = flat[a : a + 9]
        if head[:3] != b"\x00\x00\x01":
            raise ValueError("no elementary packet at a start flag")
        length = struct.unpack(">H", head[4:6])[0]
        if head[7] & 0x80:
            out.times.append(_read_stamp(flat[a + 9 : a + 14]))
        end = a + 6 + length if length else b
        pieces.append(flat[a + 9 + head[8] : min(b, end)])
    out.elementary, out.payload = len(pieces), b"".join(pieces)
    return out


def padded(text: bytes) -> bytes:
    """The text with spaces up to a positive multiple of UNIT bytes."""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b" ")


def store(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with a binary column `media` (replaced where it is there): the text's padded bytes as
    a transport stream.  Null text: empty.  Other columns pass through.  Empty table: empty."""
    kept = docs.drop(media)
    schema = added(kept, f"`{media}` binary")
    [temp] = free(docs, "llm_text")

    def run(batches):
        for batch in batches:
            got = [mux(padded(x.as_buffer().to_pybytes())) for x in batch.columns[-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.binary())], names=[*batch.schema.names[:-1], media])

    return docs.withColumn(temp, utf8(text)).select(*(F.col(f"`{c}`") for c in kept.columns), temp).mapInArrow(run, schema)


RESULTS = ("payload", "packets", "errors", "pts", "random_access", "problem")


def read(streams: DataFrame, media: str = "media", prefix: str = "") -> DataFrame:
    """streams with what its transport streams hold: payload, packets, errors, pts (array of
    ticks), random_access (array of packet numbers) and problem (null, or why it can't be
    read, with the others null).  `prefix` is put before these names; where one is taken
    nevertheless, that is an error.  Null media: a problem."""
    names = [prefix + n for n in RESULTS]
    if taken := {n.lower() for n in names} & {c.lower() for c in streams.columns}:
        raise ValueError(f"streams has columns {sorted(taken)}: give a prefix")
    kinds = ("binary", "long", "long", "array<long>", "array<long>", "string")
    schema = added(streams, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def one(raw):
        try:
            s = demux(raw or b"")
        except (ValueError, struct.error, IndexError) as e:
            return (None,) * 5 + (str(e),)
        return s.payload, s.packets, s.errors, s.times, s.points, None

    def run(batches):
        for batch in batches:
            got = list(zip(*(one(x.as_py()) for x in batch.column(media)))) or [[]] * 6
            more = [pa.array(list(v), f.type) for v, f in zip(got, list(target)[-6:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=target.names)

    return streams.mapInArrow(run, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document about its stored stream: sizes, checksums of what is read back,
    and a feature string of the parsed stream.  Equal texts give equal values; a null text is
    empty; null or repeated ids stay; an empty table gives no rows."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for value in batch.column("text"):
                raw = value.as_buffer().to_pybytes()
                media = mux(padded(raw))
                back = demux(media)
                for column, v in zip(out, (len(raw), len(back.payload), hashlib.sha256(back.payload).hexdigest(),
                                           zlib.crc32(back.payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), back.feature())):
                    column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], names=[
                id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = (f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
              "media_bytes long, media_sha256 string, feature string")
    return docs.select(F.col(id_col), utf8(text).alias("text")).mapInArrow(run, schema)
