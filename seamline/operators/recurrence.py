"""Recurrence at any offset: where the blocks of known byte strings stand in others, not only at block borders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seamline.operators.byte_diff import BASE, window_hashes

#: Known blocks that one pass sends to every task, unless a single string has more; ``recurrences`` takes as many passes as it needs.
MOST_BLOCKS = 1 << 20


def known_blocks(content: bytes, size: int) -> list[tuple[int, str]]:
    """Place and SHA-256 of each whole block."""
    return [(k, hashlib.sha256(content[at : at + size]).hexdigest()) for k, at in enumerate(range(0, len(content) - size + 1, size))]


def place_free(hashes: np.ndarray, length: int, size: int) -> np.ndarray:
    """``window_hashes`` of strings of unequal length made comparable: raised to the power that a string of 2**31 has."""
    return hashes * np.uint64(pow(BASE, (1 << 31) - length + size, 1 << 64))


def groups_of(known: list[tuple[int, bytes]], size: int) -> list[list[tuple[int, bytes]]]:
    """``known`` in order, cut into groups of at most ``MOST_BLOCKS`` whole blocks; a longer string is a group of its own."""
    groups: list[list[tuple[int, bytes]]] = [[]]
    held = 0
    for k, content in known:
        if groups[-1] and held + len(content) // size > MOST_BLOCKS:
            groups.append([])
            held = 0
        groups[-1].append((k, content))
        held += len(content) // size
    return groups


def recurrences(df: DataFrame, known: list[tuple[int, bytes]], size: int, least: int) -> DataFrame:
    """``(id, content)`` rows against known byte strings: id, known_id, start (of the run, in bytes) and blocks.

    Every window of ``size`` bytes is hashed; windows whose hash is a known block's give alignments, and each alignment is
    verified by digest, block by block. The longest verified run of an alignment counts, the earliest on ties, if it has
    ``least`` blocks. The known side goes in groups of ``MOST_BLOCKS`` blocks, one pass over ``df`` each; neither side is capped.
    """
    passes = [_one_pass(df, group, size, least) for group in groups_of(known, size)]
    return reduce(DataFrame.unionByName, passes)


def _one_pass(df: DataFrame, known: list[tuple[int, bytes]], size: int, least: int) -> DataFrame:
    table: dict[int, list[tuple[int, int]]] = {}
    digests: dict[int, list[str]] = {}
    for k, content in known:
        digests[k] = [d for _, d in known_blocks(content, size)]
        hashes = place_free(window_hashes(content, size), len(content), size)[::size].tolist()
        for n, h in enumerate(hashes):
            table.setdefault(h, []).append((k, n))
    wanted = np.array(sorted(table), dtype=np.uint64)

    def matches(data: bytes) -> Iterator[tuple[int, int, int]]:
        hashes = place_free(window_hashes(data, size), len(data), size)
        hits = np.flatnonzero(np.isin(hashes, wanted))
        aligned = sorted({(k, at - n * size) for at in hits.tolist() for k, n in table[int(hashes[at])] if at >= n * size})
        for k, start in aligned:
            best, run = (0, 0), 0
            for n, digest in enumerate(digests[k]):
                at = start + n * size
                run = run + 1 if hashlib.sha256(data[at : at + size]).hexdigest() == digest else 0
                if run > best[0]:
                    best = (run, at - (run - 1) * size)
            if best[0] >= least:
                yield k, best[1], best[0]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *m) for k, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in matches(content.as_py() or b"")]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "known_id", "start", "blocks"])

    return df.mapInArrow(find, "id long, known_id long, start long, blocks long")
