"""Made sound, frames and chapters, for the operators that no driver table has input for."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from seamline.operators.landmarks import HERTZ
from seamline.sources.frames import chapters, shift_chapters


def sound(seconds: float, seed: int, hertz: int = HERTZ) -> np.ndarray:
    """Blocks of a quarter of a second, each of three tones and a click of noise at its start."""
    rng = np.random.default_rng(seed)
    size = hertz // 4
    t = np.arange(size) / hertz
    parts = []
    for _ in range(int(seconds * 4)):
        block = sum(rng.uniform(0.1, 0.2) * np.sin(2 * np.pi * f * t) for f in rng.uniform(200, 4000, 3))
        block[: hertz // 100] += rng.uniform(-0.2, 0.2, hertz // 100)
        parts.append(block)
    return np.concatenate(parts).astype(np.float32)


def clips(spark: SparkSession) -> DataFrame:
    """``(id, hertz, samples)``: clip 2, and clip 1 that holds it, softer, between other sound."""
    known = sound(8, 1)
    heard = np.concatenate([sound(12, 2), 0.7 * known, sound(9, 3)])
    return spark.createDataFrame([(1, HERTZ, heard.tolist()), (2, HERTZ, known.tolist())], "id long, hertz int, samples array<float>")


def frame(rate: int, mark: bytes = b"", padding: int = 0) -> bytes:
    """A frame of MPEG-2 layer III at 22,050 Hz without sound, for the ``rate``-th bit rate; ``mark`` stands in its body."""
    kbps = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)[rate]
    size = 72 * kbps * 1000 // 22050 + padding
    return (bytes([0xFF, 0xF3, rate << 4 | padding << 1, 0]) + mark).ljust(size, b"\0")


def streams(spark: SparkSession) -> DataFrame:
    """``(id, content)``: one encode; two; two and a tail of a second; a leading tag and dirt; nothing; no frames."""
    encode = lambda n: frame(9, b"Xing") + frame(9) * n
    tag = b"ID3\x03\0\0\0\0\0\x14" + bytes(20)
    values = [encode(200), encode(200) + encode(150), encode(200) + encode(150) + encode(40), tag + b"dirt" + encode(100) + b"\xff\xf3", b"", b"no frames here"]
    return spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values)], "id long, content binary")


def chapter_tag(rows: list[tuple[int, int, int, int]], version: int = 3) -> bytes:
    """An ID3 tag of chapter frames, each of start and end in milliseconds and in bytes."""
    syncsafe = lambda n: bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])
    out = b""
    for n, row in enumerate(rows):
        body = f"chp{n}".encode() + b"\0" + b"".join(v.to_bytes(4, "big") for v in row)
        out += b"CHAP" + (syncsafe(len(body)) if version == 4 else len(body).to_bytes(4, "big")) + b"\0\0" + body
    return b"ID3" + bytes([version, 0, 0]) + syncsafe(len(out)) + out


#: Chapters before, across, inside and behind a cut of 5 to 8 seconds and bytes 10,000 to 40,000, one without offsets.
CHAPTERS = [(0, 5000, 0, 10_000), (6000, 10_000, 0xFFFFFFFF, 0xFFFFFFFF), (6000, 7500, 20_000, 30_000), (10_000, 14_000, 50_000, 80_000)]


def chapter_rows(spark: SparkSession, times: list[tuple[int, int]], places: list[tuple[int, int]]) -> DataFrame:
    """``(version, chapter, cut, start, stop, from_byte, to_byte)`` of the made chapters before and after cuts."""
    rows = []
    for version in (3, 4):
        tag = chapter_tag(CHAPTERS, version)
        for cut, data in ((False, tag), (True, shift_chapters(tag, times, places))):
            rows += [(version, n, cut, *c) for n, c in enumerate(chapters(data))]
    return spark.createDataFrame(rows, "version int, chapter int, cut boolean, start long, stop long, from_byte long, to_byte long")
