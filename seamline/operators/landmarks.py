"""Spectral landmarks of sampled sound, and matching by votes for an offset.

Extraction is a numpy kernel per clip, matching is a DataFrame plan: an equi-join on hashes that carry their frames as lists,
votes, and a window. Hashes that are frequent in both clips are counted by transforms in numpy, not pair by pair.
Decoding of compressed sound is not part of this module; clips arrive as samples.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sampling rate, frame and hop in samples, least bin, peaks kept per frame, partners per peak, their reach.
HERTZ, FRAME, HOP, LEAST_BIN, PEAKS, FANOUT, REACH = 11025, 1024, 512, 4, 4, 6, 63
#: A peak's floor above the mean and below the maximum, and its neighbourhood in frames and bins.
OVER_MEAN, UNDER_MAX, NEAR_FRAMES, NEAR_BINS = 1.5, 12.0, 2, 3
#: Votes and seconds that a match needs.
LEAST_VOTES, LEAST_SECONDS = 20, 5.0
#: A clip is matched in blocks of two to this power of frames; a hash that a block has this often is dense.
BLOCK_BITS, DENSE = 20, 32
#: Pairs of frames held at once, steps that all offsets take together, and offsets that are better followed one by one.
_PAIRS, _STEPS, _FEW = 1 << 20, 4096, 256


def resampled(samples: np.ndarray, hertz: int) -> np.ndarray:
    """Mono samples at ``HERTZ`` by linear interpolation; channels, if any, are the second axis and are averaged."""
    mono = samples.mean(axis=1) if samples.ndim == 2 else samples
    if not len(mono):
        return mono.astype(np.float32)
    places = np.arange(0, len(mono) - 1 + 1e-9, hertz / HERTZ)
    return np.interp(places, np.arange(len(mono)), mono).astype(np.float32)


def log_power(samples: np.ndarray) -> np.ndarray:
    """Natural logarithm of the power of bins 0 to 511, one row for each frame."""
    count = (len(samples) - FRAME) // HOP + 1
    if count < 1:
        return np.zeros((0, FRAME // 2), dtype=np.float32)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)
    spectrum = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:count] * hann, axis=1)[:, : FRAME // 2]
    return np.log(np.abs(spectrum) ** 2 + 1e-12).astype(np.float32)


def peaks(power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of strict local maxima over the frame's floor, at most ``PEAKS`` a frame, by frame and bin."""
    frames, bins = power.shape
    if frames <= 2 * NEAR_FRAMES:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    heard = power[:, LEAST_BIN:]
    floor = np.maximum(heard.mean(1) + OVER_MEAN, heard.max(1) - UNDER_MAX)
    good = (power >= floor[:, None]) & (np.arange(bins) >= LEAST_BIN)
    good[:NEAR_FRAMES] = good[-NEAR_FRAMES:] = False
    padded = np.pad(power, ((NEAR_FRAMES, NEAR_FRAMES), (NEAR_BINS, NEAR_BINS)), constant_values=-np.inf)
    for f in range(2 * NEAR_FRAMES + 1):
        for b in range(2 * NEAR_BINS + 1):
            if (f, b) != (NEAR_FRAMES, NEAR_BINS):
                good &= power > padded[f : f + frames, b : b + bins]
    at, which = np.nonzero(good)
    stay = np.ones(len(at), dtype=bool)
    edges = np.append(np.searchsorted(at, np.unique(at)), len(at))
    for a, b in zip(edges, edges[1:], strict=False):
        if b - a > PEAKS:
            stay[a:b] = False
            stay[a + np.array(strongest_places(power[at[a:b], which[a:b]].tolist()))] = True
    return at[stay], which[stay]


def strongest_places(values: list[float]) -> list[int]:
    """Which of a frame's peaks, in order of bin, are kept: a stronger one takes the place of the first of the weakest."""
    held = list(range(min(PEAKS, len(values))))
    for new in range(len(held), len(values)):
        weakest = min(range(len(held)), key=lambda k: values[held[k]])
        if values[new] > values[held[weakest]]:
            held[weakest] = new
    return held


def landmarks(samples: np.ndarray, hertz: int = HERTZ) -> tuple[np.ndarray, np.ndarray]:
    """Frames and 24-bit hashes: each peak with its next ``FANOUT`` peaks at most ``REACH`` frames later."""
    at, which = peaks(log_power(resampled(samples, hertz)))
    later = np.searchsorted(at, at, side="right")
    frames, hashes = [], []
    for n in range(FANOUT):
        other = later + n
        ok = other < len(at)
        ok[ok] = at[other[ok]] - at[ok] <= REACH
        mine, theirs = np.flatnonzero(ok), other[ok]
        frames.append(at[mine])
        hashes.append(which[mine] << 15 | which[theirs] << 6 | at[theirs] - at[mine])
    frames, hashes = np.concatenate(frames), np.concatenate(hashes)
    order = np.lexsort((hashes, frames))
    return frames[order], hashes[order]


def landmark_rows(clips: DataFrame) -> DataFrame:
    """``(id, frame, hash)`` of ``(id long, hertz int, samples array<float>)`` clips; a null clip has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, hertz, samples in zip(*[batch.column(c) for c in ("id", "hertz", "samples")], strict=True):
                if samples.is_valid:
                    frames, hashes = landmarks(np.asarray(samples.values, dtype=np.float32), hertz.as_py())
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(frames), pa.int64()), pa.array(frames, pa.int64()), pa.array(hashes, pa.int64())], ["id", "frame", "hash"])

    return clips.select("id", "hertz", "samples").mapInArrow(run, "id long, frame long, hash long")


def whole_matches(heard: DataFrame, known: DataFrame, least_votes: int = LEAST_VOTES, least_seconds: float = LEAST_SECONDS) -> DataFrame:
    """``match_landmarks``, and of the matches of a known clip that overlap within a clip only the one with the most votes."""
    found = match_landmarks(heard, known, least_votes, least_seconds)
    return keep_apart(found, ["id", "known_id"], "from_frame", "to_frame", "votes")


def landmark_floors(rows: DataFrame, least: int = 64, least_distinct: int = 48, seconds: tuple[float, float] = (5.0, 600.0), frame_seconds: float = HOP / HERTZ) -> DataFrame:
    """``(id, landmarks, hashes, enough)`` of ``(id, frame, hash)`` rows: whether a clip has the landmarks, distinct hashes and length to be known by."""
    counts = rows.groupBy("id").agg(F.count(F.lit(1)).alias("landmarks"), F.count_distinct("hash").alias("hashes"), ((F.max("frame") - F.min("frame")) * frame_seconds).alias("_length"))
    enough = (F.col("landmarks") >= least) & (F.col("hashes") >= least_distinct) & F.col("_length").between(*seconds)
    return counts.select("id", "landmarks", "hashes", enough.alias("enough"))


def earliest(heard: np.ndarray, known: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first frames at which two series of masks meet, by place (an offset plus ``len(known) - 1``), for places at which they do.

    Every offset starts where both series have begun and goes on until it meets. Those that are left after ``_STEPS`` steps,
    or are few, are followed one by one in growing slices.
    """
    found = np.empty(len(places), dtype=np.int64)
    left = np.arange(len(places))
    at = np.maximum(places - (len(known) - 1), 0)
    beside = at - places + (len(known) - 1)
    for _ in range(_STEPS):
        if len(left) <= _FEW:
            break
        met = (heard[at] & known[beside]) != 0
        found[left[met]] = at[met]
        left, at, beside = left[~met], at[~met] + 1, beside[~met] + 1
    for i, a, b in zip(left.tolist(), at.tolist(), beside.tolist(), strict=True):
        width = 256
        while True:
            width = min(2 * width, len(heard) - a, len(known) - b)
            if width < 1:
                raise ArithmeticError("an offset has votes, and no frame has them")
            met = heard[a : a + width] & known[b : b + width] != 0
            if met.any():
                found[i] = a + int(met.argmax())
                break
            a, b = a + width, b + width
    return found


def dense_votes(heard: list[np.ndarray], known: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets with votes, their votes, and the first and last heard frame of each, exactly; a list of frames of either side for each hash.

    The votes of a hash are the correlation of its two series. Hashes with more pairs than offsets are counted by Fourier
    transforms, if there are enough of them that offsets meet early, as their frames are looked for by ``earliest``; the
    pairs of the others are listed, at most ``size ** 1.5`` of the first kind, and ``size`` for each of the second.
    """
    begin, known_begin = min(int(x.min()) for x in heard), min(int(x.min()) for x in known)
    sides = [(*np.unique(a - begin, return_counts=True), *np.unique(b - known_begin, return_counts=True)) for a, b in zip(heard, known, strict=True)]
    length, known_length = max(int(s[0][-1]) for s in sides) + 1, max(int(s[2][-1]) for s in sides) + 1
    size = length + known_length - 1
    n, first, last = np.zeros(size, dtype=np.int64), np.full(size, length), np.full(size, -1)
    points = 1 << (size - 1).bit_length()

    def exact(s: tuple) -> bool:  # repeated rows may be too many for rounding
        return float(s[1] @ s[1]) ** 0.5 * float(s[3] @ s[3]) ** 0.5 < 1e9

    crowded = [s for s in sides if len(s[0]) * len(s[2]) >= size and exact(s)]
    if sum(len(s[0]) * len(s[2]) for s in crowded) ** 2 < size**3:
        crowded = []
    taken = {id(s) for s in crowded}
    for a, a_times, b, b_times in (s for s in sides if id(s) not in taken):
        step = max(1, _PAIRS // len(b))
        for k in range(0, len(a), step):
            part = a[k : k + step]
            places = (part[:, None] + (known_length - 1 - b)).ravel()
            frames = np.repeat(part, len(b))
            np.add.at(n, places, (a_times[k : k + step, None] * b_times).ravel())
            np.minimum.at(first, places, frames)
            np.maximum.at(last, places, frames)
    for k in range(0, len(crowded), 64):
        product = np.zeros(points // 2 + 1, dtype=np.complex128)
        masks, known_masks = np.zeros(length, dtype=np.uint64), np.zeros(known_length, dtype=np.uint64)
        for bit, (a, a_times, b, b_times) in enumerate(crowded[k : k + 64]):
            product += np.fft.rfft(np.bincount(a, a_times), points) * np.fft.rfft(np.bincount(known_length - 1 - b, b_times), points)
            masks[a] |= np.uint64(1 << bit)
            known_masks[b] |= np.uint64(1 << bit)
        votes = np.rint(np.fft.irfft(product, points)[:size]).astype(np.int64)
        n += votes
        places = np.flatnonzero(votes)
        first[places] = np.minimum(first[places], earliest(masks, known_masks, places))
        last[places] = np.maximum(last[places], length - 1 - earliest(masks[::-1].copy(), known_masks[::-1].copy(), size - 1 - places))
    places = np.flatnonzero(n)
    return places - (known_length - 1) + begin - known_begin, n[places], first[places] + begin, last[places] + begin


def _block_votes(rows: pa.Table) -> pa.Table:
    """The votes of two blocks, of rows of ``(id, known_id, _frames, _known)``, one for each hash."""
    sides = [[x.values.to_numpy(zero_copy_only=False) for x in rows.column(c)] for c in ("_frames", "_known")]
    counted = dense_votes(*sides)
    ids = [pa.repeat(rows.column(c)[0], len(counted[0])) for c in ("id", "known_id")]
    return pa.Table.from_arrays([*ids, *[pa.array(x, pa.int64()) for x in counted]], ["id", "known_id", "offset", "n", "first", "last"])


def _by_hash(rows: DataFrame) -> DataFrame:
    """``(id, _block, hash, _frames)``: the frames of each hash in a block of a clip as a list."""
    frame = F.col("frame").cast("long")
    placed = rows.select("id", F.shiftright(frame, BLOCK_BITS).alias("_block"), "hash", frame.alias("_frame"))
    # Dealt before any filter, so that all uses of equal rows share one exchange.
    return placed.repartition("id", "_block", "hash").groupBy("id", "_block", "hash").agg(F.collect_list("_frame").alias("_frames"))


def offset_counts(heard: DataFrame, known: DataFrame) -> DataFrame:
    """``(id, known_id, offset, n, first, last)``: equal hashes by clips and offset, and the first and last heard frame of them.

    Lists of frames are joined, not frames. Where a hash is dense in both blocks, ``dense_votes`` counts all such hashes of
    two blocks in one task, which holds their lists and a few arrays as long as both blocks. Other lists are paired by
    the plan: one of them has less than ``DENSE`` frames. Rows without a frame or hash have no offset.
    """
    joined = _by_hash(heard).join(_by_hash(known).select(F.col("id").alias("known_id"), F.col("_block").alias("_known_block"), "hash", F.col("_frames").alias("_known")), "hash")
    dense = (F.size("_frames") >= DENSE) & (F.size("_known") >= DENSE)
    types = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    schema = f"id {types['id']}, known_id {types['known_id']}, offset long, n long, first long, last long"
    counted = joined.where(dense).groupBy("id", "known_id", "_block", "_known_block").applyInArrow(_block_votes, schema)
    fewer = F.size("_frames") <= F.size("_known")
    short, long_ = F.when(fewer, F.col("_frames")).otherwise(F.col("_known")), F.when(fewer, F.col("_known")).otherwise(F.col("_frames"))
    paired = joined.where(~dense).select("id", "known_id", fewer.alias("_fewer"), long_.alias("_long"), F.explode(short).alias("_x"))
    paired = paired.select("id", "known_id", "_fewer", "_x", F.explode("_long").alias("_y"))
    frame, other = F.when(F.col("_fewer"), F.col("_x")).otherwise(F.col("_y")), F.when(F.col("_fewer"), F.col("_y")).otherwise(F.col("_x"))
    paired = paired.select("id", "known_id", (frame - other).alias("offset"), F.lit(1).cast("long").alias("n"), frame.alias("first"), frame.alias("last"))
    votes = paired.unionByName(counted).groupBy("id", "known_id", "offset")
    return votes.agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def match_landmarks(heard: DataFrame, known: DataFrame, least_votes: int = LEAST_VOTES, least_seconds: float = LEAST_SECONDS) -> DataFrame:
    """Where known clips recur: id, known_id, offset, votes, from_frame, to_frame.

    An offset wins if the votes there and beside it reach ``least_votes`` and neither neighbour has more. Votes are
    summed before they are dealt.
    """
    votes = offset_counts(heard, known)
    near = Window.partitionBy("id", "known_id").orderBy("offset").rangeBetween(-1, 1)
    summed = votes.select("id", "known_id", "offset", "n", F.sum("n").over(near).alias("votes"), F.max("n").over(near).alias("_most"), F.min("first").over(near).alias("from_frame"), F.max("last").over(near).alias("to_frame"))
    long_enough = (F.col("to_frame") - F.col("from_frame")) * (HOP / HERTZ) >= least_seconds
    won = summed.where((F.col("votes") >= least_votes) & (F.col("n") == F.col("_most")) & long_enough)
    frame = heard.schema["frame"].dataType
    offset = heard.select((F.col("frame") - F.lit(None).cast(known.schema["frame"].dataType)).alias("offset")).schema["offset"].dataType
    return won.select("id", "known_id", F.col("offset").cast(offset).alias("offset"), "votes", F.col("from_frame").cast(frame).alias("from_frame"), F.col("to_frame").cast(frame).alias("to_frame"))


def keep_apart(matches: DataFrame, keys: list[str], start: str, stop: str, strength: str) -> DataFrame:
    """Strongest first, the matches of a key that overlap no stronger kept one (half-open); ties go to the earlier.

    A greedy choice within one key: rows are dealt by key and sorted, and a task holds a batch and one connected stretch of
    overlaps, not a whole key.
    """

    def chosen(stretch: pa.Table) -> pa.Table:
        rows = zip(*[stretch.column(c).to_pylist() for c in (strength, start, stop)], strict=True)
        begins: list = []
        ends: list = []
        kept = []
        for _, a, b, i in sorted((-v, a, b, i) for i, (v, a, b) in enumerate(rows)):
            at = bisect_left(begins, b)  # kept spans are apart, so only the last that begins before the end can overlap
            if not at or ends[at - 1] <= a:
                begins.insert(at, a)
                ends.insert(at, b)
                kept.append(i)
        return stretch.take(sorted(kept))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, reach = None, None, None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            table = now if held is None else pa.concat_tables([held, now])
            first = 0 if held is None else held.num_rows
            cuts = []
            columns = [now.column(c).to_pylist() for c in (*keys, start, stop)]
            for i, (*k, a, b) in enumerate(zip(*columns, strict=True)):
                if k != key or a >= reach:
                    cuts.append(first + i)
                    key, reach = k, b
                reach = max(reach, b)
            edges = [0, *[c for c in cuts if c]]
            out = [chosen(table.slice(x, y - x)) if y - x > 1 else table.slice(x, 1) for x, y in zip(edges, edges[1:], strict=False)]
            held = table.slice(edges[-1])
            if out:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
        if held is not None and held.num_rows:
            yield from chosen(held).combine_chunks().to_batches()

    return matches.repartition(*keys).sortWithinPartitions(*keys, start, stop).mapInArrow(choose, matches.schema)
