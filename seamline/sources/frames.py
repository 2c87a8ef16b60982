"""Layer III frames and ID3 chapters of binary content, as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bit rates in kilobits per second and sample rates by MPEG version.
MPEG1_KBPS = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
MPEG2_KBPS = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Marks of an encoder's first frame, sought in this many body bytes, and its least share of filling.
TAG_MARKS, TAG_WINDOW, TAG_FILL = (b"Xing", b"Info", b"LAME", b"VBRI"), 200, 0.10


def syncsafe(four: bytes) -> int:
    """Twenty-eight bits from the low seven of each byte."""
    value = 0
    for byte in four:
        value = value << 7 | byte & 0x7F
    return value


def leading_tag_size(data: bytes) -> int:
    """Bytes of a leading ID3v2 tag; 0 without one."""
    return 10 + syncsafe(data[6:10]) if data[:3] == b"ID3" and len(data) >= 10 else 0


def frame_header(data: bytes, at: int) -> tuple[int, int, float] | None:
    """Length in bytes, bits per second and seconds of the frame that begins at ``at``; None if none does."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer, rate_no, hertz_no = data[at + 1] >> 3 & 3, data[at + 1] >> 1 & 3, data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if version == 1 or layer != 1 or rate_no in (0, 15) or hertz_no == 3:
        return None
    bits = 1000 * (MPEG1_KBPS if version == 3 else MPEG2_KBPS)[rate_no]
    hertz, samples = SAMPLE_RATES[version][hertz_no], 1152 if version == 3 else 576
    return samples // 8 * bits // hertz + (data[at + 2] >> 1 & 1), bits, samples / hertz


def is_tag_frame(frame: bytes) -> bool:
    """Whether a frame carries an encoder's mark and enough filling."""
    body = frame[4:]
    if not body or not any(m in body[:TAG_WINDOW] for m in TAG_MARKS):
        return False
    return sum(body.count(bytes([b])) for b in (0x00, 0x55, 0xAA)) / len(body) > TAG_FILL


def frames(data: bytes) -> Iterator[tuple[int, int, int, float, bool]]:
    """Offset, length, bits per second, seconds and tag flag of each whole frame after the leading tag."""
    at = leading_tag_size(data)
    while at < len(data):
        head = frame_header(data, at)
        if head is None:
            at = data.find(b"\xff", at + 1)
            if at < 0:
                return
        elif at + head[0] > len(data):
            return
        else:
            yield at, *head, is_tag_frame(data[at : at + head[0]])
            at += head[0]


def id3_frames(data: bytes) -> Iterator[tuple[str, bytes, bytes]]:
    """Name, flags and body of each frame of a leading v2.3 or v2.4 tag without unsynchronisation or extended header."""
    size = leading_tag_size(data)
    if not size or data[3] not in (3, 4) or data[5] & 0xC0:
        return
    at, stop = 10, min(size, len(data))
    while at + 10 <= stop:
        name = data[at : at + 4]
        if not all(0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A for c in name):
            return
        length = syncsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        if length <= 0 or at + 10 + length > stop:
            return
        yield name.decode(), data[at + 8 : at + 10], data[at + 10 : at + 10 + length]
        at += 10 + length


def chapters(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """Start and end in milliseconds, then in bytes, of each chapter frame without flags."""
    for name, flags, body in id3_frames(data):
        end = body.find(b"\0")
        if name == "CHAP" and flags == b"\0\0" and 0 <= end and len(body) >= end + 17:
            yield tuple(int.from_bytes(body[end + 1 + k : end + 5 + k], "big") for k in (0, 4, 8, 12))


#: An offset that means none, and the greatest 32-bit number.
NO_OFFSET = MOST_U32 = 0xFFFFFFFF


def shifted(value: int, cuts: list[tuple[int, int]]) -> int:
    """``value`` less the part of the cuts that lies before it."""
    return value - sum(max(0, min(value, stop) - start) for start, stop in cuts)


def shift_chapters(data: bytes, times: list[tuple[int, int]], places: list[tuple[int, int]]) -> bytes:
    """``data`` with the times and offsets of its chapter frames moved by cuts in milliseconds and bytes; offsets that mean none stay."""
    out, at = bytearray(data), 10
    for name, flags, body in id3_frames(data):
        end = body.find(b"\0")
        if name == "CHAP" and flags == b"\0\0" and 0 <= end and len(body) >= end + 17:
            for k, cuts in ((0, times), (4, times), (8, places), (12, places)):
                start = at + 10 + end + 1 + k
                value = int.from_bytes(data[start : start + 4], "big")
                if k < 8 or value != NO_OFFSET:
                    out[start : start + 4] = min(max(shifted(value, cuts), 0), MOST_U32).to_bytes(4, "big")
        at += 10 + len(body)
    return bytes(out)


def first_audio_byte(data: bytes) -> int:
    """Where the first frame begins; the length if there is none."""
    return next((f[0] for f in frames(data)), len(data))


#: Fixed value: a last segment of fewer seconds is no segment of its own.
LEAST_TAIL = 2.0


def segment_scan(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """Segments of each binary value: id, segment, start_byte, end_byte, start_seconds, seconds; none without a frame.

    A segment begins with the first frame and at each encoder's first frame after it; the last begins no segment if less
    than ``LEAST_TAIL`` seconds follow. A segment ends where the next begins, the last where the value ends.
    """
    w = Window.partitionBy(id_col).orderBy("frame_no")
    opens = F.when(F.col("is_tag") & (F.col("frame_no") > 0), 1).otherwise(0)
    before = F.coalesce(F.sum("seconds").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    marked = frame_rows(df, id_col, content_col).withColumns({"part": F.sum(opens).over(w), "before": before})
    parts = marked.groupBy(id_col, "part").agg(F.min("offset").alias("start_byte"), F.min("before").alias("start_seconds"), F.sum("seconds").alias("seconds"))
    whole = Window.partitionBy(id_col)
    last = F.max("part").over(whole)
    tail = F.max(F.when(F.col("part") == last, F.col("seconds"))).over(whole)
    joined = F.when((last >= 1) & (tail < LEAST_TAIL) & (F.col("part") == last), F.col("part") - 1).otherwise(F.col("part"))
    parts = parts.withColumn("segment", joined).groupBy(id_col, "segment")
    parts = parts.agg(F.min("start_byte").alias("start_byte"), F.min("start_seconds").alias("start_seconds"), F.sum("seconds").alias("seconds"))
    sizes = df.select(id_col, F.octet_length(content_col).cast("long").alias("size"))
    after = F.lead("start_byte").over(Window.partitionBy(id_col).orderBy("segment"))
    return parts.join(sizes, id_col).select(id_col, "segment", "start_byte", F.coalesce(after, "size").alias("end_byte"), "start_seconds", "seconds")


def frame_rows(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """One row per frame of each binary value: id, frame_no, offset, length, bits_per_second, seconds, is_tag."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for k in range(batch.num_rows):
                found = list(frames(batch.column(1)[k].as_py() or b""))
                if found:
                    columns = [pa.array(c) for c in zip(*found, strict=True)]
                    numbers = pa.array(range(len(found)), pa.int64())
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([k] * len(found))), numbers, *columns], ["id", "frame_no", "offset", "length", "bits_per_second", "seconds", "is_tag"])

    return df.select(id_col, content_col).mapInArrow(run, f"id {kind}, frame_no long, offset long, length long, bits_per_second long, seconds double, is_tag boolean")
