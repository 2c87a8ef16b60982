"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints of ``BLOCKS`` equal blocks that differ in at most ``radius`` bits agree in all but ``radius`` blocks, so the
distinct fingerprints are gathered by every such choice of blocks. Within a gathering, the 64 bit planes are stored
vertically: one word operation compares 64 pairs of lanes, carry-save counters add up the differing bits, and words all of
whose lanes have exceeded the radius are abandoned. Gatherings of more than ``TILE`` are cut into tiles and compared tile
by tile, so that no task holds more than two tiles. Each comparison emits a spanning forest of its links, which keeps
every connection without listing all pairs; components follow by contraction.

Defined cases: a null text has no words; a text without words has fingerprint zero and is linked like any other; fewer
words than a shingle are one shingle; equal texts have equal fingerprints and one component; repeated rows stay repeated;
a null id takes part, and never names a component unless all its ids are null; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.llm import similar_texts
from seamline.llm.arrow import append_columns, quoted
from seamline.llm.components import component_labels
from seamline.llm.storage import scratch, written

SEED = 42
BLOCKS, TILE = 4, 1024


def simhash(text: str | None, words_per_shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text's word shingles, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, and words end at the six ASCII blanks
    if not words:
        return 0
    k = words_per_shingle
    spans = zip(*(words[i:] for i in range(k)), strict=False) if len(words) > k else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.array([digest(join(s), SEED) for s in spans], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprints(df: DataFrame, keep: list[str], text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """``keep`` columns plus fp, the fingerprint as a signed long."""

    def make(part) -> list:
        texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
        return [np.array([simhash(t, words_per_shingle) for t in texts], dtype=np.uint64).view(np.int64).tolist()]

    return append_columns(df, keep, text_col, T.StructType([T.StructField("fp", T.LongType())]), make)


# ---- bit-sliced comparison


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 planes of the fingerprints' bits: lane ``i`` is bit ``i % 64`` of word ``i // 64``; one spare word of zeros."""
    words = len(fps) // 64 + 2
    out = np.zeros((64, words * 8), dtype=np.uint8)
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return out.view("<u8")


def lanes_within(planes: np.ndarray, shift: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """Of the valid lanes, those ``i`` for which fingerprints ``i`` and ``i + shift`` differ in at most ``radius`` bits."""
    packed = np.zeros(-(-len(valid) // 64) * 8, dtype=np.uint8)
    bits = np.packbits(valid, bitorder="little")
    packed[: len(bits)] = bits
    live = packed.view("<u8")
    at = np.flatnonzero(live)
    live = live[at]
    hop, rest = divmod(shift, 64)
    width = (radius + 1).bit_length()
    counters = [np.zeros(len(at), dtype=np.uint64) for _ in range(width)]
    over = np.zeros(len(at), dtype=np.uint64)
    last = planes.shape[1] - 1
    for b in range(64):
        if not len(at):
            break
        plane = planes[b]
        other = plane[np.minimum(at + hop, last)]
        if rest:
            other = other >> np.uint64(rest) | plane[np.minimum(at + hop + 1, last)] << np.uint64(64 - rest)
        carry = plane[at] ^ other
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b % 8 == 7:
            # A lane is out once its count, or an overflow of it, is over the radius.
            above, equal = over.copy(), ~np.zeros(len(at), dtype=np.uint64)
            for k in range(width - 1, -1, -1):
                if radius >> k & 1:
                    equal &= counters[k]
                else:
                    above |= equal & counters[k]
                    equal &= ~counters[k]
            live &= ~above
            stay = live != 0
            if not stay.all():
                at, live, over = at[stay], live[stay], over[stay]
                counters = [c[stay] for c in counters]
    if not len(at):
        return np.zeros(0, dtype=np.int64)
    bits = np.unpackbits(live.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, bit = np.nonzero(bits)
    return at[word] * 64 + bit


def forest(fps: np.ndarray, groups: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest, as index pairs, of the links within groups; equal ``groups`` stand together."""
    edges: list[tuple[int, int]] = []
    if len(fps) < 2:
        return edges
    cuts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    sizes = np.diff(np.append(cuts, len(fps)))
    size_of, group_no = np.repeat(sizes, sizes), np.repeat(np.arange(len(cuts)), sizes)
    floor = 1
    for ceiling in (4, 16, 64, 256, 1024, len(fps)):
        mine = np.flatnonzero((size_of > floor) & (size_of <= ceiling))
        floor = max(floor, ceiling)
        if not len(mine):
            continue
        own, planes = group_no[mine], bit_planes(fps[mine])
        parent = list(range(len(mine)))

        def root(i: int, parent=parent) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for shift in range(1, int(size_of[mine].max())):
            valid = own[shift:] == own[:-shift]
            if not valid.any():
                break
            for i in lanes_within(planes, shift, valid, radius).tolist():
                a, b = root(i), root(i + shift)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    edges.append((int(mine[i]), int(mine[i + shift])))
    return edges


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Edges ``(a, b)`` between fingerprints of the one-column table ``distinct`` (fp) that keep every connection."""
    width = 64 // BLOCKS
    masks = [_signed(sum(((1 << width) - 1) << width * k for k in kept)) for kept in combinations(range(BLOCKS), BLOCKS - radius)]
    spread = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "shared"))
    spread = written(spread, "gathered")
    counts = spread.groupBy("choice", "shared").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = spread.join(written(counts, "gatherings"), ["choice", "shared"])
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    tiled = sized.select("fp", "choice", "shared", tiles.alias("tiles"), F.pmod(F.xxhash64("fp"), tiles).cast("int").alias("tile"))
    paired = tiled.select("fp", "choice", "shared", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    paired = paired.select("fp", "choice", "shared", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"))
    key = ["choice", "shared", "lo", "hi"]
    ordered = paired.repartition(*key).sortWithinPartitions(*key)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = [np.asarray(batch.column(batch.schema.get_field_index(k))).astype(np.int64) for k in ("fp", *key)]
            held = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
            new = np.any([c[1:] != c[:-1] for c in held[1:]], axis=0)
            ends = np.flatnonzero(new)
            if len(ends):
                cut = int(ends[-1]) + 1
                yield found([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held is not None:
            yield found(held)

    def found(rows: list[np.ndarray]) -> pa.RecordBatch:
        fps = rows[0].view(np.uint64)
        groups = np.cumsum(np.concatenate([[False], np.any([c[1:] != c[:-1] for c in rows[1:]], axis=0)]))
        pairs = np.array(forest(fps, groups, radius), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(rows[0][pairs[:, 0]]), pa.array(rows[0][pairs[:, 1]])], ["a", "b"])

    return ordered.mapInArrow(compare, "a long, b long")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits) and component_id (the smallest id reachable)."""
    if not 0 <= radius < BLOCKS:
        raise ValueError("the radius must be smaller than the number of blocks")
    source = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    with scratch(df.sparkSession):
        marked = written(fingerprints(source, ["id"], "text", words_per_shingle), "fingerprints", read_later=True)
        distinct = written(marked.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
        labels = component_labels(links(distinct.select("fp"), radius))
        named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
        named = written(named, "named")
        least = written(named.groupBy("label").agg(F.min("first").alias("component_id")), "components")
        by_fp = written(named.join(least, "label").select("fp", "component_id"), "by-fingerprint", read_later=True)
    return marked.join(by_fp, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``df`` with one row of each group of similar texts, the one with the smallest id.

    Texts are linked where SimHash makes them candidates and their shingles' exact Jaccard similarity is at least
    ``similarity``; texts without words are alike. Rows are told apart, not ids: rows of one id and unlike texts belong to
    their own groups; of rows of one group and the smallest id, the text with the smallest hash stays, once. Rows without
    an id stay, as no component can name them.
    """
    # Columns travel under places for names, so that none can clash with those made here.
    places = {n: f"c{i}" for i, n in enumerate(df.columns)}
    key, text = places[id_col], places[text_col]
    numbered = df.select(*[F.col(quoted(n)).alias(c) for n, c in places.items()], F.monotonically_increasing_id().alias("number"))
    with scratch(df.sparkSession):
        marked = written(similar_texts.sketched(numbered, text, words_per_shingle, similarity), "sketched", read_later=True)
        labels = similar_texts.set_labels(marked, text, similarity, words_per_shingle)
        rows = marked.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.xxhash64(text).alias("digest"), "number", "_set")
        rows = rows.join(labels, "_set", "left").select("id", "digest", "number", F.coalesce("label", "_set").alias("label"))
        rows = written(rows, "labelled")
        groups = rows.groupBy("label").agg(F.min(F.struct("id", "digest", "number"))["number"].alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        gone = rows.join(written(groups.select("label", "first"), "groups"), "label").where("number <> first").select("number")
        gone = written(gone, "gone", read_later=True)
    return marked.join(gone, "number", "left_anti").select(*[F.col(c).alias(n) for n, c in places.items()])
