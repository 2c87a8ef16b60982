"""Texts whose word shingles overlap: SimHash candidates by bit-sliced comparison, checked by exact Jaccard similarity.

Equal shingle sets are one set, and a set has a SimHash fingerprint of as many bits as the similarity needs. Its first
``SCREEN`` bits are compared; the others are cut into blocks of ``BLOCK`` bits, and sets that agree in a block are gathered.
Within a gathering, the bits stand in planes: one word operation compares a set with 64 others, and a tree of carry-save
adders counts the differing bits of 64 pairs at once. Every gathering gives a spanning forest of its links, so no list of
pairs is ever made, however large a group of similar texts is; candidate components follow by contraction. The sets of a
component are then compared by their shingles, exactly, and components of the links that hold are the result.

Gatherings of more than ``GATHERED`` sets are cut into tiles and compared tile by tile, and so are candidate components of
more than ``TILE`` sets or ``TILE_SHINGLES`` shingles; a task holds two tiles. Two sets of the similarity agree in no block
with probability ``MISSED`` at most, and differ in too many bits with about as little. Sets of up to ``SMALL`` shingles, whose
fingerprints differ in more bits, also meet wherever they are equal but for one shingle, which for 0.8 is every such pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import acos, ceil, log, log1p, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.llm.arrow import append_columns, quoted
from seamline.llm.components import component_labels
from seamline.llm.storage import written

SEED = 42
SCREEN, BLOCK, MISSED, SMALL = 192, 12, 3e-5, 9
#: Fingerprints of sets of 10 shingles and more differ in at most this much more bits than those of long texts (enumerated
#: to 120 shingles: 0.1611 against 0.1515 at similarity 0.8).
UNEVEN = 1.065
#: Of the compared bits, 4.5 standard deviations more than pairs at the threshold differ in on average are allowed.
SLACK = 4.5
#: Sets of a gathering's tile, rows that are compared at once, and words of one operation.
GATHERED, ROWS, WORDS = 8192, 1 << 16, 4096
#: Sets and shingles of a component's tile, and shingles that are looked up at once.
TILE, TILE_SHINGLES, LOOKED_UP = 1024, 1 << 21, 1 << 20
_FULL = ~np.uint64(0)


def differing(similarity: float) -> float:
    """The share of bits in which the fingerprints of two sets of this Jaccard similarity differ on average, at most."""
    return UNEVEN * acos(2 * similarity / (1 + similarity)) / pi


def tables(similarity: float) -> int:
    """How many blocks it takes for two such sets to agree in one, but for ``MISSED``."""
    agree = (1 - differing(similarity)) ** BLOCK
    return ceil(log(MISSED) / log1p(-agree)) if agree < 1 else 1


def most_bits(similarity: float) -> int:
    """In how many of the ``SCREEN`` bits candidates differ at most."""
    differ = differing(similarity)
    return int(SCREEN * differ + SLACK * (SCREEN * differ * (1 - differ)) ** 0.5)


def shingle_set(text: str | None, words_per_shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; fewer words than a shingle are one shingle."""
    words = (text or "").encode().lower().split()  # as simhash: only A-Z change, and words end at the six ASCII blanks
    if not words:
        return np.zeros(0, dtype=np.uint64)
    k = words_per_shingle
    spans = zip(*(words[i:] for i in range(k)), strict=False) if len(words) > k else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.array([digest(join(s), SEED) for s in spans], dtype=np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; two empty sets are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


# ---- fingerprints


def simhash_bits(shingles: np.ndarray, words: int) -> np.ndarray:
    """The SimHash of a set in ``64 * words`` bits, as zeros and ones: a bit is 1 if set in over half of the shingles."""
    ones = np.zeros(64 * words, dtype=np.int64)
    steps = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(shingles), 255):  # so many fit a count of one byte
        mixed = shingles[at : at + 255, None] + steps
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed ^= mixed >> np.uint64(shift)
            mixed *= np.uint64(factor)
        mixed ^= mixed >> np.uint64(31)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return (2 * ones > len(shingles)).astype(np.uint8)


def _signed(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data, SEED) - (1 << 63)


def sketch(text: str | None, words_per_shingle: int = 5, similarity: float = 0.8) -> tuple[int, int, list[int], list[int], list[int]]:
    """Digest of the shingle set, its size, its compared bits, a key for each block (none for the empty set), and the digests of
    a small set without each of its shingles, where that leaves the similarity."""
    shingles = shingle_set(text, words_per_shingle)
    n, count = len(shingles), tables(similarity)
    if not n:
        return _signed(b""), 0, [0] * (SCREEN // 64), [], []
    bits = simhash_bits(shingles, ceil((SCREEN + BLOCK * count) / 64))
    blocks = bits[SCREEN : SCREEN + BLOCK * count].reshape(count, BLOCK).astype(np.int64) @ (1 << np.arange(BLOCK))
    near = [_signed(np.delete(shingles, i).tobytes()) for i in range(n)] if 1 < n <= SMALL and n - 1 >= similarity * n - 1e-9 else []
    return _signed(shingles.tobytes()), n, np.packbits(bits[:SCREEN]).view(np.int64).tolist(), (blocks + (np.arange(count) << BLOCK)).tolist(), near


def sketched(df: DataFrame, text_col: str = "text", words_per_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``df`` with _set, _size, _bits, _blocks and _near."""

    def make(part) -> list:
        found = [sketch(t, words_per_shingle, similarity) for t in part.column(part.schema.get_field_index(text_col)).to_pylist()]
        return [list(c) for c in zip(*found, strict=True)] or [[]] * 5

    longs = T.ArrayType(T.LongType())
    made = T.StructType([T.StructField("_set", T.LongType()), T.StructField("_size", T.LongType()), T.StructField("_bits", longs), T.StructField("_blocks", T.ArrayType(T.IntegerType())), T.StructField("_near", longs)])
    return append_columns(df, df.columns, text_col, made, make)


# ---- bit-sliced comparison


def bit_planes(bits: np.ndarray) -> np.ndarray:
    """Planes ``(bit, group, word)`` of the zeros and ones ``(group, lane, bit)``: lane ``i`` is bit ``i % 64`` of word ``i // 64``."""
    groups, lanes, width = bits.shape
    out = np.zeros((width, groups, -(-lanes // 64) * 8), dtype=np.uint8)
    packed = np.packbits(np.ascontiguousarray(bits.transpose(2, 0, 1)), axis=2, bitorder="little")
    out[:, :, : packed.shape[2]] = packed
    return out.view("<u8")


def add_planes(planes: Iterator[np.ndarray]) -> list[np.ndarray]:
    """The bits, least first, of how many planes are set in each lane, by carry-save adders."""
    waiting: list[list[np.ndarray]] = []

    def push(plane: np.ndarray, level: int) -> None:
        if level == len(waiting):
            waiting.append([])
        held = waiting[level]
        held.append(plane)
        if len(held) == 3:
            a, b, c = held
            either = a ^ b
            waiting[level] = [either ^ c]
            push(a & b | either & c, level + 1)

    for plane in planes:
        push(plane, 0)
    level = 0
    while level < len(waiting):
        if len(waiting[level]) == 2:
            a, b = waiting[level]
            waiting[level] = [a ^ b]
            push(a & b, level + 1)
        level += 1
    return [held[0] for held in waiting]


def lanes_within(planes: np.ndarray, own: np.ndarray, most: int) -> np.ndarray:
    """Words ``(group, row, word)`` with the lanes that differ from the row in at most ``most`` bits; ``own`` has the rows' bits
    as full or empty words ``(bit, group, row)``."""
    counts = add_planes(planes[b][:, None, :] ^ own[b][:, :, None] for b in range(len(planes)))
    if most >> len(counts):
        return np.full_like(counts[0], _FULL)
    above, equal = np.zeros_like(counts[0]), np.full_like(counts[0], _FULL)
    for k in range(len(counts) - 1, -1, -1):
        if most >> k & 1:
            equal &= counts[k]
        else:
            above |= equal & counts[k]
            equal &= ~counts[k]
    return ~above


def pieces(bits: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """For the zeros and ones ``(group, lane, bit)`` of groups of ``sizes`` lanes, the first lane that each is connected with."""
    groups, lanes, _ = bits.shape
    label = np.tile(np.arange(lanes), (groups, 1))
    planes = bit_planes(bits)
    room = np.arange(planes.shape[2] * 64)
    valid = np.packbits(room < sizes[:, None], axis=1, bitorder="little").view("<u8")
    for at in range(0, lanes, 64):
        rows = np.arange(at, min(at + 64, lanes))
        own = np.negative(bits[:, rows].transpose(2, 0, 1).astype(np.uint64))
        later = np.packbits(room > rows[:, None], axis=1, bitorder="little").view("<u8")[:, at // 64 :]
        found = lanes_within(planes[:, :, at // 64 :], own, most) & later & valid[:, None, at // 64 :]
        for g, r in np.argwhere(found.any(axis=2)).tolist():
            mine = label[g]
            linked = mine[np.flatnonzero(np.unpackbits(found[g, r].view(np.uint8), bitorder="little")) + at]
            roots = {int(mine[at + r]), *linked.tolist()}
            if len(roots) > 1:
                first = min(roots)
                for root in roots - {first}:
                    mine[mine == root] = first
    return label


def forest(bits: np.ndarray, groups: np.ndarray, most: int) -> np.ndarray:
    """Index pairs that connect, within groups, the fingerprints ``bits`` (rows of words) wherever links of at most ``most``
    differing bits do: each with the first one of its piece. Equal ``groups`` stand together."""
    cuts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    sizes = np.diff(np.append(cuts, len(groups)))
    room = np.where(sizes > 64, -(-sizes // 64) * 64, np.select([sizes <= 8, sizes <= 16, sizes <= 32], [8, 16, 32], 64))
    out = [np.zeros((0, 2), dtype=np.int64)]
    for lanes in np.unique(room[sizes > 1]).tolist():
        mine = np.flatnonzero((room == lanes) & (sizes > 1))
        some = max(1, WORDS // (min(lanes, 64) * -(-lanes // 64)))
        for at in range(0, len(mine), some):
            now = mine[at : at + some]
            places = np.minimum(cuts[now, None] + np.arange(lanes), len(groups) - 1)
            label = pieces(np.unpackbits(bits[places].view(np.uint8), axis=2), sizes[now], most)
            g, i = np.nonzero(label != np.arange(lanes))
            out.append(np.stack([places[g, i], places[g, label[g, i]]], axis=1))
    return np.concatenate(out)


def candidate_links(sets: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: links that connect the sets of the table ``sets`` (set, bits, blocks, near) that may be similar."""
    spread = sets.select("set", *[F.col("bits")[i].alias(f"bits{i}") for i in range(SCREEN // 64)], F.explode("blocks").alias("block"))
    # There are no more rows here than there are blocks, whatever the input.
    hot = spread.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / GATHERED).cast("int").alias("tiles")).where("tiles > 1")
    tiled = spread.join(F.broadcast(written(hot, "hot-blocks")), "block", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("set"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    key, names = ["block", "lo", "hi"], ["set", *[f"bits{i}" for i in range(SCREEN // 64)]]
    paired = tiled.select(*names, "block", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"))
    most = most_bits(similarity)

    def found(rows: pa.Table) -> pa.RecordBatch:
        columns = {c: np.asarray(rows.column(c).combine_chunks()) for c in (*names, *key)}
        new = np.any([np.diff(columns[k]) != 0 for k in key], axis=0)
        pairs = forest(np.stack([columns[c] for c in names[1:]], axis=1), np.cumsum(np.concatenate([[False], new])), most)
        return pa.RecordBatch.from_arrays([pa.array(columns["set"][pairs[:, k]]) for k in (0, 1)], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= ROWS:
                rows = pa.Table.from_batches(held)
                ends = np.flatnonzero(np.any([np.diff(np.asarray(rows.column(k).combine_chunks())) != 0 for k in key], axis=0))
                cut = int(ends[-1]) + 1 if len(ends) else 0
                if cut:
                    yield found(rows.slice(0, cut))
                held, count = rows.slice(cut).to_batches(), rows.num_rows - cut
        if count:
            yield found(pa.Table.from_batches(held))

    met = paired.repartition(*key).sortWithinPartitions(*key, "set").mapInArrow(compare, "a long, b long")
    met = met.unionByName(sets.select(F.col("set").alias("a"), F.explode("near").alias("b")))
    # A set of a large group is linked to another first one in most of its blocks, so these are linked to the least of them
    # instead, which connects the same and leaves few different links. A set has no more of them than blocks and tiles.
    firsts = met.groupBy("a").agg(F.min("b").alias("least"), F.collect_set("b").alias("firsts"))
    return firsts.select(F.explode(F.expr("transform(firsts, x -> if(x = least, a, x))")).alias("a"), F.col("least").alias("b")).distinct()


# ---- exact check

#: Rows of sets in the tiles of candidate components.
MET = "component long, lo int, hi int, tile int, set long, size long, bits array<long>"
KEY = ["component", "lo", "hi"]


class Tile:
    """The sets of a pair of tiles of one candidate component."""

    def __init__(self, rows: pa.Table, similarity: float):
        column = lambda c: rows.column(c).combine_chunks()
        self.sets, self.sizes, self.own = (np.asarray(column(c)) for c in ("set", "size", "tile"))
        self.bits = np.asarray(column("bits").flatten()).view(np.uint64).reshape(rows.num_rows, -1)
        self.across = rows.column("lo")[0].as_py() != rows.column("hi")[0].as_py()
        self.similarity, self.most_bits = similarity, most_bits(similarity)

    def candidates(self, i: int) -> np.ndarray:
        """Places after ``i`` of the sets that may be similar to set ``i``."""
        rest = slice(i + 1, None)
        sizes = self.sizes[rest]
        fit = np.minimum(sizes, self.sizes[i]) >= self.similarity * np.maximum(sizes, self.sizes[i])
        if self.across:
            fit &= self.own[rest] != self.own[i]
        near = np.flatnonzero(fit) + i + 1
        small = np.maximum(self.sizes[near], self.sizes[i]) <= SMALL
        return near[small | (np.bitwise_count(self.bits[near] ^ self.bits[i]).sum(1) <= self.most_bits)]

    def hopeful(self) -> np.ndarray:
        """Whether each set has a candidate."""
        out = np.zeros(len(self.sets), dtype=bool)
        for i in range(len(self.sets) - 1):
            near = self.candidates(i)
            out[near] = True
            out[i] |= len(near) > 0
        return out

    def forest(self, shingles: list[np.ndarray]) -> list[tuple[int, int]]:
        """A spanning forest of the links between sets of at least the similarity."""
        known, places = np.unique(np.concatenate(shingles), return_inverse=True)
        ends = np.cumsum([len(x) for x in shingles])
        starts = ends - self.sizes
        marked = np.zeros(len(known), dtype=bool)
        group = np.arange(len(self.sets))
        edges = []
        for i in range(len(self.sets) - 1):
            near = self.candidates(i)
            near = near[group[near] != group[i]]
            marked[places[starts[i] : ends[i]]] = True
            at = 0
            while at < len(near):
                stop = max(at + 1, int(np.searchsorted(np.cumsum(self.sizes[near[at:]]), LOOKED_UP, side="right")) + at)
                some = near[at:stop]
                sizes = self.sizes[some]
                cuts = np.cumsum(sizes) - sizes
                flat = np.repeat(starts[some] - cuts, sizes) + np.arange(sizes.sum())
                both = np.add.reduceat(marked[places[flat]].astype(np.int64), cuts)
                for j in some[both >= self.similarity * (sizes + self.sizes[i] - both)].tolist():
                    if group[i] != group[j]:
                        group[group == group[j]] = group[i]
                        edges.append((int(self.sets[i]), int(self.sets[j])))
                at = stop
            marked[places[starts[i] : ends[i]]] = False
        return edges


def by_tile(rows: DataFrame, use: Callable[[pa.Table], pa.RecordBatch], spec: str) -> DataFrame:
    """``use`` of all rows of each pair of tiles of a candidate component, one pair after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            cuts = np.flatnonzero(np.any([np.diff(np.asarray(held.column(k).combine_chunks())) != 0 for k in KEY], axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], cuts.tolist(), strict=False):
                if b - a > 1:
                    yield use(held.slice(a, b - a))
            held = held.slice(int(cuts[-1])) if len(cuts) else held
        if held is not None and held.num_rows > 1:
            yield use(held)

    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "set").mapInArrow(run, spec)


def hopeful_rows(met: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``met`` that have a candidate in their pair of tiles."""

    def use(rows: pa.Table) -> pa.RecordBatch:
        kept = rows.filter(pa.array(Tile(rows, similarity).hopeful())).combine_chunks()
        return pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in kept.columns], schema=kept.schema)

    return by_tile(met, use, MET)


def set_links(rows: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: a spanning forest of the links in each pair of tiles of ``rows`` with ``shingles``."""

    def use(rows: pa.Table) -> pa.RecordBatch:
        shingles = [np.frombuffer(x, dtype="<u8") for x in rows.column("shingles").to_pylist()]
        pairs = np.array(Tile(rows, similarity).forest(shingles), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return by_tile(rows, use, "a long, b long")


def shingled(texts: DataFrame, words_per_shingle: int) -> DataFrame:
    """``(set, shingles)`` of ``(set, text)``: the sorted hashes as bytes."""

    def make(part) -> list:
        return [[shingle_set(t, words_per_shingle).astype("<u8").tobytes() for t in part.column(part.schema.get_field_index("text")).to_pylist()]]

    return append_columns(texts, ["set"], "text", T.StructType([T.StructField("shingles", T.BinaryType())]), make)


def set_labels(marked: DataFrame, text_col: str = "text", similarity: float = 0.8, words_per_shingle: int = 5) -> DataFrame:
    """``(_set, label)`` of the linked sets of a ``sketched`` and written table; sets have equal labels where they are connected."""
    distinct = marked.groupBy("_set").agg(*[F.any_value(c).alias(c) for c in ("_size", "_bits", "_blocks", "_near")])
    distinct = written(distinct.select(*[F.col(f"_{c}").alias(c) for c in ("set", "size", "bits", "blocks", "near")]), "sets")
    components = component_labels(candidate_links(distinct, similarity)).select(F.col("node").alias("set"), F.col("label").alias("component"))
    near = written(distinct.select("set", "size", "bits").join(components, "set"), "candidates")
    tiles = F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("size") / TILE_SHINGLES)).cast("int")
    shared = near.groupBy("component").agg(F.count(F.lit(1)).alias("n"), tiles.alias("tiles")).where("n > 1").drop("n")
    met = near.join(written(shared, "components"), "component")
    tiled = met.withColumn("tile", F.pmod(F.xxhash64("set"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")}).select(*[c.split(" ")[0] for c in MET.split(", ")])
    rows = written(hopeful_rows(tiled, similarity), "hopeful")
    # A table of its own tells the planner how few they are, so that the texts of the others aren't shuffled.
    needed = written(rows.select(F.col("set").alias("_set")).distinct(), "needed")
    texts = marked.select("_set", F.col(quoted(text_col)).alias("text")).join(needed, "_set", "left_semi")
    shingles = written(shingled(texts.groupBy(F.col("_set").alias("set")).agg(F.any_value("text").alias("text")), words_per_shingle), "shingles")
    links = written(set_links(rows.join(shingles, "set"), similarity), "links")
    return component_labels(links).select(F.col("node").alias("_set"), "label")
