"""MPEG transport streams as media columns: from packets of 188 bytes to timed elementary units.

``demux`` reads a binary column. For each stream it finds the packet grid (and finds it again after damage), reads the
program association and program map tables with their checksums, checks the continuity counter of each stream,
reassembles the packets of the elementary streams and reads their timestamps and random-access points. ``mux`` is the
other way; ``film`` makes a stream of a document's text, for want of films among the tables.

All of a stream is in one row, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import doc_id, documents

PACKET, SYNC = 188, 0x47
TEXT_PID, META_PID, PMT_PID = 0x100, 0x101, 0x1000
#: Characters of a unit, 90 kHz ticks between units, and units between random-access points of ``film``.
UNIT, TICKS, ACCESS = 1000, 3600, 8


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32(data: bytes) -> int:
    """The checksum of the tables; 0 over a section with its checksum."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8) & 0xFFFFFFFF ^ _CRC[c >> 24 ^ b]
    return c


@dataclass
class Unit:
    pid: int
    payload: bytes
    pts: int | None = None
    dts: int | None = None
    random_access: bool = False
    continuous: bool = True
    program: int | None = None
    stream_type: int | None = None


@dataclass
class Stream:
    units: list[Unit] = field(default_factory=list)
    packets: int = 0
    skipped_bytes: int = 0
    errors: int = 0
    scrambled: int = 0
    duplicates: int = 0
    gaps: int = 0
    bad_tables: int = 0
    programs: dict[int, int] = field(default_factory=dict)  # program -> pid of its map
    types: dict[int, tuple[int, int]] = field(default_factory=dict)  # pid -> (program, stream type)


def _stamp(kind: int, t: int) -> bytes:
    t &= (1 << 33) - 1
    return bytes([kind << 4 | (t >> 29 & 14) | 1, t >> 22 & 255, (t >> 14 & 254) | 1, t >> 7 & 255, (t << 1 & 254) | 1])


def _ticks(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + crc32(head + body).to_bytes(4, "big")


class Muxer:
    """Writes units of one program."""

    def __init__(self, types: dict[int, int], program: int = 1, pmt_pid: int = PMT_PID):
        self.out: list[bytes] = []
        self.counter: dict[int, int] = {}
        self.clock_pid = min(types)
        self.pmt_pid = pmt_pid
        self.pat = b"\0" + _section(0, 1, program.to_bytes(2, "big") + (0xE000 | pmt_pid).to_bytes(2, "big"))
        streams = b"".join(bytes([t]) + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\0" for pid, t in types.items())
        self.pmt = b"\0" + _section(2, program, (0xE000 | self.clock_pid).to_bytes(2, "big") + b"\xf0\0" + streams)

    def tables(self) -> None:
        for pid, section in ((0, self.pat), (self.pmt_pid, self.pmt)):
            for i in range(0, len(section), PACKET - 4):
                part = section[i : i + PACKET - 4]
                self.out.append(self._head(pid, not i, 1) + part + b"\xff" * (PACKET - 4 - len(part)))

    def _head(self, pid: int, first: bool, control: int) -> bytes:
        c = self.counter[pid] = (self.counter.get(pid, -1) + 1) & 15
        return bytes([SYNC, first << 6 | pid >> 8, pid & 255, control << 4 | c])

    def unit(self, u: Unit) -> None:
        stamps = b"" if u.pts is None else _stamp(2 if u.dts is None else 3, u.pts) + (b"" if u.dts is None else _stamp(1, u.dts))
        size = 3 + len(stamps) + len(u.payload)
        pes = b"\0\0\1\xbd" + (size if size < 65536 else 0).to_bytes(2, "big") + bytes([0x80, (0 if u.pts is None else 0x80 if u.dts is None else 0xC0), len(stamps)]) + stamps + u.payload
        at, first = 0, True
        while at < len(pes):
            extra = b""
            if first:
                flags = u.random_access << 6
                if u.pid == self.clock_pid and u.pts is not None:
                    base = max(0, (u.pts if u.dts is None else u.dts) - 9000) & (1 << 33) - 1
                    extra = bytes([flags | 0x10]) + (base << 15 | 0x7E00).to_bytes(6, "big")
                elif flags:
                    extra = bytes([flags])
            room = PACKET - 4 - (len(extra) + 1 if extra else 0)
            part = pes[at : at + room]
            spare = room - len(part)
            if spare:
                if not extra:
                    spare -= 1
                    extra = b"\0" if spare else b""
                    spare -= bool(spare)
                    field_ = bytes([len(extra) + spare]) + extra + b"\xff" * spare
                else:
                    field_ = bytes([len(extra) + spare]) + extra + b"\xff" * spare
            else:
                field_ = bytes([len(extra)]) + extra if extra else b""
            self.out.append(self._head(u.pid, first, 3 if field_ else 1) + field_ + part)
            at += len(part)
            first = False


def mux(units: Iterable[Unit], types: dict[int, int], program: int = 1) -> bytes:
    """A stream of the units, in order, its tables repeated at each random-access point."""
    m = Muxer(types, program)
    m.tables()
    for i, u in enumerate(units):
        if i and u.random_access:
            m.tables()
        m.unit(u)
    return b"".join(m.out)


def _grid(data: bytes, at: int) -> int:
    """Next place from ``at`` on where packets begin: three sync bytes in a row, as far as the data goes; -1 for none."""
    while 0 <= at <= len(data) - PACKET:
        at = data.find(SYNC, at)
        if at < 0 or at > len(data) - PACKET:
            return -1
        if all(data[p] == SYNC for p in (at + PACKET, at + 2 * PACKET) if p < len(data)):
            return at
        at += 1
    return -1


class _Tables:
    """Sections of one pid."""

    def __init__(self):
        self.buffer: bytearray | None = None

    def feed(self, first: bool, data: bytes) -> Iterator[bytes]:
        if first:
            if not data:
                return
            skip = data[0] + 1
            if self.buffer is not None:
                self.buffer += data[1:skip]
                yield from self._whole()
            self.buffer = bytearray(data[skip:])
        elif self.buffer is not None:
            self.buffer += data
        else:
            return
        yield from self._whole()

    def _whole(self) -> Iterator[bytes]:
        while self.buffer is not None and len(self.buffer) >= 3:
            if self.buffer[0] == 0xFF:
                self.buffer = None
                return
            size = 3 + (int.from_bytes(self.buffer[1:3], "big") & 0xFFF)
            if len(self.buffer) < size:
                return
            yield bytes(self.buffer[:size])
            del self.buffer[:size]


def _pes(pid: int, data: bytes, random_access: bool, continuous: bool, kind: tuple[int, int]) -> Unit | None:
    if len(data) < 6 or data[:3] != b"\0\0\1":
        return None
    size = int.from_bytes(data[4:6], "big")
    end = 6 + size if size else len(data)
    continuous &= end <= len(data)
    u = Unit(pid, b"", None, None, random_access, continuous, *kind)
    if data[3] in (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xFF, 0xF2, 0xF8):  # stream ids without the optional header
        u.payload = data[6:end]
        return u
    if len(data) < 9:
        return None
    flags, head = data[7] >> 6, 9 + data[8]
    if flags & 2 and len(data) >= 14 and data[8] >= 5:
        u.pts = _ticks(data[9:14])
        if flags == 3 and len(data) >= 19 and data[8] >= 10:
            u.dts = _ticks(data[14:19])
    u.payload = data[head:end]
    return u


def read(data: bytes) -> Stream:
    """All units of a stream by pid in order of arrival, with what was wrong.

    A unit is ``continuous`` unless a packet of it is missing or it ends early. A repeated packet is read once. Packets
    with the error flag or scrambled are passed over; those of pids that no program names are counted alone.
    """
    s = Stream()
    tables = {0: _Tables()}
    last: dict[int, tuple[int, bytes]] = {}
    parts: dict[int, list] = {}  # pid -> [pieces, random access, continuous]
    done: dict[int, list[Unit]] = {}

    def close(pid: int) -> None:
        pieces, access, whole = parts.pop(pid)
        if u := _pes(pid, b"".join(pieces), access, whole, s.types[pid]):
            done.setdefault(pid, []).append(u)

    at = 0
    while (start := at if at <= len(data) - PACKET and data[at] == SYNC else _grid(data, at)) >= 0:
        s.skipped_bytes += start - at
        packet = data[start : start + PACKET]
        at = start + PACKET
        s.packets += 1
        if packet[1] & 0x80:
            s.errors += 1
            continue
        pid, first, control, counter = (packet[1] & 0x1F) << 8 | packet[2], packet[1] >> 6 & 1, packet[3] >> 4 & 3, packet[3] & 15
        if pid == 0x1FFF:
            continue
        begin, access, jump = 4, False, False
        if control & 2:
            size = packet[4]
            begin = 5 + size
            if size:
                jump, access = bool(packet[5] & 0x80), bool(packet[5] & 0x40)
        if not control & 1 or begin > PACKET:
            continue
        if packet[3] & 0xC0:
            s.scrambled += 1
            continue
        gap = False
        if (before := last.get(pid)) and not jump:
            if before[0] == counter and before[1][4:] == packet[4:]:
                s.duplicates += 1
                continue
            gap = counter != (before[0] + 1) & 15
            s.gaps += gap
        last[pid] = counter, packet
        body = packet[begin:]
        if pid in tables:
            if gap:
                tables[pid].buffer = None
            for section in tables[pid].feed(bool(first), body):
                if crc32(section):
                    s.bad_tables += 1
                    continue
                number, rest = int.from_bytes(section[3:5], "big"), section[8:-4]
                if not section[5] & 1:  # not yet in force
                    continue
                if section[0] == 0 and pid == 0:
                    for i in range(0, len(rest) - 3, 4):
                        program, to = int.from_bytes(rest[i : i + 2], "big"), int.from_bytes(rest[i + 2 : i + 4], "big") & 0x1FFF
                        if program:
                            s.programs[program] = to
                            tables.setdefault(to, _Tables())
                elif section[0] == 2 and s.programs.get(number) == pid:
                    i = 4 + (int.from_bytes(rest[2:4], "big") & 0xFFF)
                    while i + 5 <= len(rest):
                        s.types[int.from_bytes(rest[i + 1 : i + 3], "big") & 0x1FFF] = number, rest[i]
                        i += 5 + (int.from_bytes(rest[i + 3 : i + 5], "big") & 0xFFF)
            continue
        if pid not in s.types:
            continue
        if gap and pid in parts:
            size = int.from_bytes((head := b"".join(parts[pid][0]))[4:6], "big")
            if size and len(head) >= 6 + size:
                close(pid)  # it was whole before the gap
            else:
                parts[pid][2] = False
        if first:
            if pid in parts:
                close(pid)
            parts[pid] = [[body], access, True]
        elif pid in parts:
            parts[pid][0].append(body)
            parts[pid][1] |= access
    s.skipped_bytes += len(data) - at
    for pid in list(parts):
        close(pid)
    s.units = [u for pid in sorted(done) for u in done[pid]]
    return s


def demux(media: DataFrame, payload: bool = False) -> DataFrame:
    """(doc_id, program, pid, stream_type, unit, pts, dts, random_access, continuous, n_bytes, md5[, payload]) of ``media`` (doc_id, media).

    A row for each unit of each elementary stream, units counted from 0 by pid. ``pts`` and ``dts``: ticks of 90 kHz,
    33 bits as stored; null where the unit has none, ``dts`` also where it equals ``pts``. A null or empty stream, or
    one without packets or tables, gives no rows. A null doc_id stays null; repeated rows are each read. An empty table
    gives no rows. Further columns are not read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out, size = [], 0
            for d, data in zip(f["_d"], f["media"]):
                count: dict[int, int] = {}
                for u in read(bytes(data)).units if data is not None else ():
                    n = count[u.pid] = count.get(u.pid, -1) + 1
                    out.append((d, u.program, u.pid, u.stream_type, n, u.pts, u.dts, u.random_access, u.continuous, len(u.payload), hashlib.md5(u.payload).hexdigest(), *([u.payload] if payload else [])))
                    size += len(u.payload)
                if size > 16_000_000:
                    yield frame(out)
                    out, size = [], 0
            yield frame(out)

    names = "_d program pid stream_type unit pts dts random_access continuous n_bytes md5".split() + ["payload"] * payload

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"pts": "Int64", "dts": "Int64"})

    own = media.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("_d"), F.col("media").cast("binary").alias("media"))
    out = own.mapInPandas(run, "_d bigint, program int, pid int, stream_type int, unit int, pts bigint, dts bigint, random_access boolean, continuous boolean, n_bytes bigint, md5 string" + ", payload binary" * payload)
    return out.select(doc_id(), *names[1:])


def film(docs: DataFrame) -> DataFrame:
    """(doc_id, media): the text of each document as a stream of timed units of ``UNIT`` characters, and its language beside it; null for a null text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"_d": f["_d"], "media": [filmed(t, lang) for t, lang in zip(f["text"], f["lang"])]})

    d = documents(docs, F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    return d.mapInPandas(run, "_d bigint, media binary").select(doc_id(), "media")


def filmed(text: str | None, lang: str) -> bytes | None:
    if text is None:
        return None
    units = [Unit(META_PID, lang.encode())]
    for i, at in enumerate(range(0, len(text), UNIT)):
        units.append(Unit(TEXT_PID, text[at : at + UNIT].encode(), 90000 + TICKS * i, 90000 + TICKS * i - TICKS // 2, i % ACCESS == 0))
    return mux(units, {TEXT_PID: 0x06, META_PID: 0x15})


SQL = """
SELECT doc_id, 1 AS program, 256 AS pid, 6 AS stream_type, CAST(i AS INTEGER) AS unit, CAST(90000 + 3600 * i AS BIGINT) AS pts, CAST(90000 + 3600 * i - 1800 AS BIGINT) AS dts,
       i % 8 = 0 AS random_access, true AS continuous, CAST(strlen(c) AS BIGINT) AS n_bytes, md5(c) AS md5
FROM (SELECT doc_id, i, substr(text, i * 1000 + 1, 1000) AS c FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS i FROM documents))
UNION ALL
SELECT doc_id, 1, 257, 21, 0, NULL, NULL, false, true, strlen(coalesce(lang, '')), md5(coalesce(lang, '')) FROM documents WHERE text IS NOT NULL
"""
