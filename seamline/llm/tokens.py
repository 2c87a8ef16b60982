"""Vectorised token features: runs of one character class in many texts, with hashes and shapes, from UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE, LETTER, DIGIT, MARK = 0, 1, 2, 3
#: Shapes: five kinds of character, an upper-case start, eight lengths, and whether the run repeats one of the two before.
SHAPES = 1 << 10


def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind, bits = np.full(256, MARK, dtype=np.uint8), np.full(256, 16, dtype=np.uint8)
    for b in range(256):
        c = chr(b)
        if b <= 32:
            kind[b], bits[b] = SPACE, 0
        elif b >= 128:
            kind[b], bits[b] = LETTER, 4
        elif c.isalpha():
            kind[b], bits[b] = LETTER, 2 if c.isupper() else 1
        elif c.isdigit():
            kind[b], bits[b] = DIGIT, 8
    return kind, bits


KIND, BITS = _classes()
_random = np.random.default_rng(20)
BYTE_KEYS = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
PLACE_KEYS = _random.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


@dataclass
class Runs:
    """Class runs of many texts; those of text ``i`` are ``offsets[i]:offsets[i + 1]``."""

    hashes: np.ndarray
    shapes: np.ndarray
    offsets: np.ndarray


def class_runs(texts: list[str]) -> Runs:
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, dtype=np.int64)
    kind = KIND[data]
    starts = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    length = np.diff(np.append(starts, len(data)))
    place = (np.arange(len(data), dtype=np.int64) - np.repeat(starts, length)) & 63
    hashes = mixed(np.add.reduceat(BYTE_KEYS[data] * PLACE_KEYS[place], starts))
    bits = np.bitwise_or.reduceat(BITS[data], starts)
    shapes = bits.astype(np.int32) | (BITS[data[starts]] == 2).astype(np.int32) << 5 | np.minimum(length, 7).astype(np.int32) << 6
    solid = kind[starts] != SPACE
    offsets = np.concatenate([[0], np.searchsorted(starts[solid], ends)]).astype(np.int64)
    hashes, shapes = hashes[solid], shapes[solid]
    place = np.arange(len(hashes)) - np.repeat(offsets[:-1], np.diff(offsets))
    again = np.zeros(len(hashes), dtype=bool)
    for back in (1, 2):
        again[back:] |= (hashes[back:] == hashes[:-back]) & (place[back:] >= back)
    return Runs(hashes, shapes | again.astype(np.int32) << 9, offsets)


def pooled_means(table: np.ndarray, ids: np.ndarray, offsets: np.ndarray, chunk: int = 1 << 16) -> np.ndarray:
    """Mean of ``table[ids]`` over each segment, in chunks of bounded memory; empty segments give zero."""
    out = np.zeros((len(offsets) - 1, table.shape[1]), dtype=np.float64)
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(len(counts)), counts)
    for at in range(0, len(ids), chunk):
        own = owner[at : at + chunk]
        cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[cuts]] += np.add.reduceat(table[ids[at : at + chunk]], cuts, axis=0)
    return out / np.maximum(counts, 1)[:, None]
