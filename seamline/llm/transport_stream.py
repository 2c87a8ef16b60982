"""Media columns: MPEG transport streams written from payload bytes, then parsed back.

The writer emits a program association table, a program map table and one private elementary stream in PES packets of
at most ``UNIT_BYTES``, each beginning with a random-access point, a clock reference and a presentation timestamp. The
reader takes any aligned 188-byte stream: it follows the tables (with their CRC), checks continuity counters per PID
(a packet may be sent twice, and its copy is left out; a declared discontinuity is no break), reassembles elementary
packets, lists timestamps with their random-access flags, and reads the clock references.

Streams are stored as a table in the shared folder, and what is reported of them is read back from there.

Defined cases: a null text is empty and stored as 192 blanks; a stream of the wrong length or without sync bytes, or with
a damaged table, raises ``ValueError``; equal payloads give equal streams; repeated rows stay repeated; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seamline.llm.arrow import append_columns, texts_of
from seamline.llm.storage import written

PACKET = 188
SYNC = 0x47
PROGRAM_PID, STREAM_PID, STREAM_TYPE, STREAM_ID = 0x1000, 0x100, 0x06, 0xBD
#: Payload bytes of one elementary packet; at 25 packets a second.
UNIT_BYTES = 32 * 1024
TICKS = 90_000 // 25
#: Payloads are padded with blanks to a positive multiple of this.
BLOCK = 192


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        table.append(c & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2, as program tables carry it."""
    c = 0xFFFFFFFF
    for byte in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ byte]
    return c


def _table_packet(pid: int, table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    section = head + body
    section += section_crc(section).to_bytes(4, "big")
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(0, 0, 1, (1).to_bytes(2, "big") + (0xE000 | PROGRAM_PID).to_bytes(2, "big")) + _table_packet(
    PROGRAM_PID, 2, 1, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"
)


def _stamp(ticks: int) -> bytes:
    return bytes([0x21 | (ticks >> 29) & 0x0E, (ticks >> 22) & 0xFF, 0x01 | (ticks >> 14) & 0xFE, (ticks >> 7) & 0xFF, 0x01 | (ticks << 1) & 0xFE])


def write_stream(payload: bytes) -> bytes:
    """A transport stream that carries ``payload``."""
    out = [TABLES]
    counter = 0
    for n, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        ticks = n * TICKS % (1 << 33)
        unit = payload[at : at + UNIT_BYTES]
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(ticks) + unit
        clock = (ticks << 15 | 0x7E00).to_bytes(6, "big")
        first, rest = pes[:176], pes[176:]
        # The first packet has 8 bytes of adaptation field: length, random access and clock flags, clock.
        stuffing = 176 - len(first)
        out.append(bytes([SYNC]) + (0x4000 | STREAM_PID).to_bytes(2, "big") + bytes([0x30 | counter, 7 + stuffing, 0x50]) + clock + b"\xff" * stuffing + first)
        counter = (counter + 1) % 16
        whole = len(rest) // 184
        if whole:
            packets = np.empty((whole, PACKET), dtype=np.uint8)
            packets[:, 0] = SYNC
            packets[:, 1] = STREAM_PID >> 8
            packets[:, 2] = STREAM_PID & 0xFF
            packets[:, 3] = 0x10 | (counter + np.arange(whole)) % 16
            packets[:, 4:] = np.frombuffer(rest, dtype=np.uint8, count=whole * 184).reshape(whole, 184)
            out.append(packets.tobytes())
            counter = (counter + whole) % 16
        last = rest[whole * 184 :]
        if last:
            gap = 184 - len(last)
            fill = bytes([gap - 1]) + (b"\x00" + b"\xff" * (gap - 2) if gap > 1 else b"")
            out.append(bytes([SYNC]) + STREAM_PID.to_bytes(2, "big") + bytes([0x30 | counter]) + fill + last)
            counter = (counter + 1) % 16
    return b"".join(out)


@dataclass
class Parsed:
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    packets: int = 0
    breaks: int = 0
    repeats: int = 0
    units: list[tuple[int, bool, bytes]] = field(default_factory=list)
    #: Clock references of the streams' packets, in ticks of 27 MHz.
    clocks: list[int] = field(default_factory=list)

    @property
    def payload(self) -> bytes:
        return b"".join(u[2] for u in self.units)


def _section(packet: bytes, start: int) -> bytes:
    at = start + 1 + packet[start]
    size = 3 + (int.from_bytes(packet[at + 1 : at + 3], "big") & 0xFFF)
    section = packet[at : at + size]
    if len(section) < size or section_crc(section):
        raise ValueError("damaged program table")
    return section


def read_stream(data: bytes) -> Parsed:
    """Tables, continuity and elementary packets ``(timestamp, random access, bytes)`` of an aligned transport stream."""
    if not data or len(data) % PACKET:
        raise ValueError("not a whole number of packets")
    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    got = Parsed(packets=len(rows))
    pids = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    adapted, loaded = (rows[:, 3] & 0x20) > 0, (rows[:, 3] & 0x10) > 0
    starts = np.where(adapted, 5 + rows[:, 4].astype(np.int32), 4)
    opens = (rows[:, 1] & 0x40) > 0
    for i in np.flatnonzero((pids == 0) & opens & loaded):
        section = _section(rows[i].tobytes(), int(starts[i]))
        for k in range(8, len(section) - 4, 4):
            number, pid = int.from_bytes(section[k : k + 2], "big"), int.from_bytes(section[k + 2 : k + 4], "big") & 0x1FFF
            if number:
                got.programs[number] = pid
    for pid in set(got.programs.values()):
        for i in np.flatnonzero((pids == pid) & opens & loaded):
            section = _section(rows[i].tobytes(), int(starts[i]))
            k = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
            while k + 5 <= len(section) - 4:
                got.streams[int.from_bytes(section[k + 1 : k + 3], "big") & 0x1FFF] = section[k]
                k += 5 + (int.from_bytes(section[k + 3 : k + 5], "big") & 0xFFF)
    for pid in sorted(got.streams):
        mine = np.flatnonzero((pids == pid) & loaded)
        counters = rows[mine, 3].astype(np.int16) & 0x0F
        again = np.zeros(len(mine), dtype=bool)
        for i in np.flatnonzero(np.diff(counters) == 0) + 1:
            # The clock reference of a copy may differ; what it carries may not.
            again[i] = not again[i - 1] and (rows[mine[i], starts[mine[i]] :] == rows[mine[i - 1], starts[mine[i - 1]] :]).all() if starts[mine[i]] == starts[mine[i - 1]] else False
        got.repeats += int(again.sum())
        mine, counters = mine[~again], counters[~again]
        flags = np.where(adapted[mine] & (rows[mine, 4] > 0), rows[mine, 5], 0)
        got.breaks += int((((np.diff(counters) % 16) != 1) & (flags[1:] & 0x80 == 0)).sum())
        for row in rows[mine[(flags & 0x10 > 0) & (rows[mine, 4] >= 7)]]:
            clock = int.from_bytes(row[6:12].tobytes(), "big")
            got.clocks.append((clock >> 15) * 300 + (clock & 0x1FF))
        offsets = starts[mine]
        lengths = np.maximum(PACKET - offsets, 0)
        joined = rows[mine][np.arange(PACKET) >= offsets[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])
        heads = np.flatnonzero(opens[mine])
        for h, nxt in zip(heads, [*heads[1:], len(mine)], strict=True):
            pes = joined[ends[h] : ends[nxt]]
            if pes[:3] != b"\x00\x00\x01":
                got.breaks += 1
                continue
            size = int.from_bytes(pes[4:6], "big")
            body = pes[9 + pes[8] : 6 + size if size else None]
            p = pes[9:14]
            ticks = (p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1 if pes[7] & 0x80 else -1
            row = rows[mine[h]]
            got.units.append((ticks, bool(row[3] & 0x20 and row[4] and row[5] & 0x40), body))
    return got


def padded(raw: bytes) -> bytes:
    """``raw`` and blanks up to a positive multiple of ``BLOCK``."""
    return raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b" ")


def describe(parsed: Parsed) -> str:
    points = ",".join(str(t) for t, entry, _ in parsed.units if entry)
    stamps = ",".join(str(t) for t, _, _ in parsed.units)
    return (
        f"programs={len(parsed.programs)};streams={','.join(f'{p}:{k}' for p, k in sorted(parsed.streams.items()))};packets={parsed.packets};"
        f"continuity_breaks={parsed.breaks};repeats={parsed.repeats};units={len(parsed.units)};pts={stamps};random_access={points};pcr={','.join(map(str, parsed.clocks))}"
    )


MEDIA = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
READ = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("media", T.BinaryType()),
    ]
)


def stored_media(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, the texts' UTF-8 bytes and their transport streams, read from the table that they are stored in."""

    def make(part) -> list:
        raw = [t.encode() for t in texts_of(part, text_col)]
        return [[len(r) for r in raw], [write_stream(padded(r)) for r in raw]]

    return written(append_columns(df, keep, text_col, MEDIA, make), "media")


def read_media(stored: DataFrame, keep: list[str], with_media: bool = True) -> DataFrame:
    """``keep`` columns, what reading the streams of ``stored_media`` gives, and the streams unless declined."""
    made = READ if with_media else T.StructType(READ.fields[:-1])

    def make(part) -> list:
        column = lambda c: part.column(part.schema.get_field_index(c)).to_pylist()
        rows = []
        for n_bytes, media in zip(column("n_bytes"), column("media"), strict=True):
            parsed = read_stream(media)
            back = parsed.payload
            row = [n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), describe(parsed)]
            rows.append([*row, media] if with_media else row)
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in made]

    return append_columns(stored, keep, "media", made, make, more=["n_bytes"])


def media_columns(df: DataFrame, keep: list[str], text_col: str = "text", with_media: bool = True) -> DataFrame:
    """``keep`` columns, the stored stream (``media``, unless declined) and what reading it back gives. See the module docstring."""
    keep = [k for k in keep if k.lower() not in {f.name for f in READ}]
    return read_media(stored_media(df, keep, text_col), keep, with_media)
