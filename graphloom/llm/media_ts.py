"""MPEG transport streams as a media column: mux, demux, and a table of access units.

``mux`` wraps any bytes into a single-program transport stream (PAT, PMT, one private
elementary stream whose PES packets carry timestamps and random-access points).
``demux`` parses any transport stream of 188-byte packets: program tables,
continuity counters, reassembled elementary packets.

Nulls: a null payload is empty. Media that is null, empty or not a whole number of packets
starting with the sync byte yields no programs and ``errors`` > 0 for the bytes that do not fit.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import documents, table, utf8

PACKET, SYNC = 188, 0x47
PMT_PID, ES_PID, PRIVATE_DATA, STREAM_ID = 0x1000, 0x100, 0x06, 0xBD
UNIT_BYTES, TICKS = 16384, 3600  # an access unit's payload, and its duration on the 90 kHz clock


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def psi_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, number >> 8, number & 255, 0xC1, 0, 0])
    return head + body + psi_crc(head + body).to_bytes(4, "big")


def _psi_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


TABLES = _psi_packet(0, _section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))) + _psi_packet(
    PMT_PID, _section(2, 1, bytes([0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0, PRIVATE_DATA, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0]))
)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 14, (pts >> 22) & 255, (pts >> 14) & 254 | 1, (pts >> 7) & 255, (pts << 1) & 254 | 1])


def mux(payload: bytes, unit_bytes: int = UNIT_BYTES) -> bytes:
    """A transport stream with ``payload`` cut into access units of at most ``unit_bytes``."""
    out, counter = [TABLES], 0
    for n, at in enumerate(range(0, len(payload), unit_bytes)):
        unit = payload[at : at + unit_bytes]
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(n * TICKS) + unit
        packets = max(1, -(-(len(pes) + 2) // 184))
        a = np.full((packets, PACKET), 0xFF, np.uint8)
        a[:, :4] = (SYNC, ES_PID >> 8, ES_PID & 255, 0x10)
        a[:, 3] |= ((counter + np.arange(packets)) & 15).astype(np.uint8)
        counter += packets
        a[0, 1] |= 0x40  # a unit starts here
        fill = packets * 184 - 2 - len(pes)  # stuffing, all of it in the last packet
        data = np.frombuffer(pes, np.uint8)
        starts = np.full(packets, 4)
        starts[0] = 6
        a[0, 3] |= 0x20
        a[0, 4:6] = (1, 0x40)  # an adaptation field that marks a random-access point
        if fill:
            starts[-1] += fill
            a[-1, 3] |= 0x20
            a[-1, 4] = starts[-1] - 5
            if starts[-1] > 5:
                a[-1, 5] = 0x40 if packets == 1 else 0
        a[np.arange(PACKET) >= starts[:, None]] = data
        out.append(a.tobytes())
    return b"".join(out)


@dataclass
class Unit:
    pid: int
    pts: int | None
    dts: int | None
    random_access: bool
    offset: int  # of its data in the elementary stream
    data: bytes


@dataclass
class Stream:
    programs: dict[int, int] = field(default_factory=dict)  # program -> PMT's PID
    kinds: dict[int, int] = field(default_factory=dict)  # elementary PID -> stream type
    units: list[Unit] = field(default_factory=list)
    packets: int = 0
    discontinuities: int = 0
    errors: int = 0


def _sections(a: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> Iterator[bytes]:
    """Whole sections with a right CRC among a PID's packets."""
    data, ends = b"", []
    for r in rows:
        part = a[r, starts[r] :].tobytes()
        if a[r, 1] & 0x40 and part:
            data += part[1 : 1 + part[0]]
            ends.append(data)
            data = part[1 + part[0] :]
        else:
            data += part
    for s in [*ends, data]:
        while len(s) > 3 and s[0] != 0xFF:
            size = 3 + ((s[1] & 15) << 8 | s[2])
            if size <= len(s) and size >= 12 and psi_crc(s[:size]) == 0:
                yield s[:size]
            s = s[size:]


def _time(b: bytes) -> int:
    return (b[0] & 14) << 29 | b[1] << 22 | (b[2] & 254) << 14 | b[3] << 7 | b[4] >> 1


def demux(media: bytes | None) -> Stream:
    s = Stream()
    whole = len(media or b"") // PACKET
    if not whole:
        s.errors = len(media or b"")
        return s
    a = np.frombuffer(media, np.uint8, whole * PACKET).reshape(-1, PACKET)
    good = (a[:, 0] == SYNC) & (a[:, 1] < 0x80)
    s.packets, s.errors = whole, int((~good).sum()) + len(media) % PACKET
    pids = (a[:, 1].astype(np.int64) & 31) << 8 | a[:, 2]
    adapted, loaded, counters = (a[:, 3] & 0x20) > 0, (a[:, 3] & 0x10) > 0, a[:, 3] & 15
    starts = np.minimum(4 + np.where(adapted, 1 + a[:, 4].astype(np.int64), 0), PACKET)
    flags = np.where(adapted & (a[:, 4] > 0), a[:, 5], 0)
    of = lambda pid: np.flatnonzero(good & (pids == pid))
    for x in _sections(a, starts, of(0)):
        for i in range(8, len(x) - 4, 4) if x[0] == 0 else ():
            if number := x[i] << 8 | x[i + 1]:
                s.programs[number] = (x[i + 2] & 31) << 8 | x[i + 3]
    for pmt in dict.fromkeys(s.programs.values()):
        for x in _sections(a, starts, of(pmt)):
            i = 12 + ((x[10] & 15) << 8 | x[11]) if x[0] == 2 else len(x)
            while i + 5 <= len(x) - 4:
                s.kinds[(x[i + 1] & 31) << 8 | x[i + 2]] = x[i]
                i += 5 + ((x[i + 3] & 15) << 8 | x[i + 4])
    for pid in s.kinds:
        rows = of(pid)
        rows = rows[loaded[rows]]
        if not len(rows):
            continue
        step = (np.diff(counters[rows].astype(np.int64)) & 15) != 1
        step &= (flags[rows[1:]] & 0x80) == 0
        again = step & (np.diff(counters[rows].astype(np.int64)) == 0) & (a[rows[1:], 4:] == a[rows[:-1], 4:]).all(axis=1)
        s.discontinuities += int((step & ~again).sum())
        rows = rows[np.concatenate(([True], ~again))]  # a packet may be sent twice
        body = a[rows][np.arange(PACKET) >= starts[rows, None]].tobytes()
        at = np.concatenate(([0], np.cumsum(PACKET - starts[rows])))
        first = np.flatnonzero(a[rows, 1] & 0x40)
        bounds, total = [*at[first].tolist(), int(at[-1])], 0
        for k, r in enumerate(rows[first]):
            pes = body[bounds[k] : bounds[k + 1]]
            if len(pes) < 9 or pes[:3] != b"\0\0\1":
                s.errors += 1
                continue
            size = pes[4] << 8 | pes[5]
            data = pes[9 + pes[8] : 6 + size if size else None]
            pts = _time(pes[9:14]) if pes[7] & 0x80 and len(pes) >= 14 else None
            dts = _time(pes[14:19]) if pes[7] & 0x40 and len(pes) >= 19 else pts
            s.units.append(Unit(pid, pts, dts, bool(flags[r] & 0x40), total, data))
            total += len(data)
    return s


def encode_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text, padded with zero bytes to a positive multiple of 64, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b)
            media = [mux(t + bytes(64 - len(t) % 64 if len(t) % 64 or not t else 0)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return documents(docs, id_col, text_col).select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


UNITS = "array<struct<pid:int, stream_type:int, pts:long, dts:long, random_access:boolean, offset:long, length:long>>"


def access_units(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds what the stored streams hold: packets, discontinuities, errors, units and the payload itself.

    One row in, one row out. ``payload`` joins the data of the elementary streams in table order. Columns that are named like one of these
    are passed on as carried_<name>.
    """
    more = ["packets", "discontinuities", "errors", "units", "payload"]
    kept = media.select(*(F.col(c).alias(f"carried_{c}" if c in more else c) for c in media.columns))
    media_col = f"carried_{media_col}" if media_col in more else media_col
    unit = pa.struct([("pid", pa.int32()), ("stream_type", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()), ("offset", pa.int64()), ("length", pa.int64())])
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(unit), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [demux(x) for x in b.column(media_col).to_pylist()]
            units = [[{"pid": u.pid, "stream_type": s.kinds[u.pid], "pts": u.pts, "dts": u.dts, "random_access": u.random_access, "offset": u.offset, "length": len(u.data)} for u in s.units] for s in found]
            new = [[s.packets for s in found], [s.discontinuities for s in found], [s.errors for s in found], units, [b"".join(u.data for u in s.units) for s in found]]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, t) for x, t in zip(new, types, strict=True))], [*b.schema.names, *more])

    schema = T._parse_datatype_string(f"packets long, discontinuities long, errors long, units {UNITS}, payload binary")
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *schema.fields]))


def digests(units: DataFrame) -> DataFrame:
    """The digest columns of the query, from what was read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, n, media, packets, gaps, errors, units, payload in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media", "packets", "discontinuities", "errors", "units", "payload")), strict=True):
                points = sum(u["random_access"] for u in units)
                feature = f"packets={packets};units={len(units)};random_access={points};last_pts={units[-1]['pts'] if units else -1};discontinuities={gaps};errors={errors}"
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return units.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(access_units(encode_payloads(table(spark, sf_dir, "documents"))))
