"""Byte-level BPE by corpus-level merge replay.

Documents become chunks: the distinct words of a chunk, and for each document the numbers of its words. Words are dealt
to slots by hash, so that a word of any number of chunks is replayed once in the corpus. In a slot the words are laid end
to end as byte tokens, and an inverted index maps each adjacent token pair to the positions where it stands. Merges are
applied in rank order, every occurrence of a rank's pairs at once (left to right), and only the pairs of the touched
neighbours enter the index again. Words never share a pair, so each word goes through the very merges it would go through
alone. The ids of words travel back to their chunks, where documents are put together and decoded.

What is shuffled is each chunk's distinct words, their ids, and the word numbers, all compressed; no table of words is
sent to every task. A task holds one chunk, or the distinct words of one slot; there is a slot for every partition of the input.

Defined cases: a null text is empty (no ids); a single word of any length is one run of the index (n log n); equal texts
give equal ids; repeated rows stay repeated; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from seamline.llm.arrow import byte_slices, offsets_of, quoted, texts_of
from seamline.llm.vocabularies import load_ranks, public_path, split_pattern

#: Bytes of text of a chunk at most, unless one text is longer, and of the slices in which it is read.
CHUNK_BYTES, SLICE_BYTES = 32 << 20, 1 << 20
#: Bytes of words that are replayed together at most, unless one word is longer, and words that are put together at once.
REPLAY_BYTES, JOINED_WORDS = 1 << 17, 1 << 19
LEAST_SLOTS = 64
#: Ids are smaller than two to this power.
PAIR_BITS = 17


class Replay:
    """Encoder and decoder for one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        #: Rank of the token that a pair of tokens makes, for every pair that makes one.
        self.pairs: dict[int, int] = {}
        for whole, rank in ranks.items():
            for cut in range(1, len(whole)):
                left, right = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                if left is not None and right is not None:
                    self.pairs[left << PAIR_BITS | right] = rank
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.text = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def encode_words(self, words: list[bytes]) -> list[array]:
        """Ids of each word, by replaying the merges over all words together."""
        token: list[int] = []
        after: list[int] = []
        before: list[int] = []
        starts = []
        table, rank_of, bits = self.bytes, self.pairs.get, PAIR_BITS
        for word in words:
            base, n = len(token), len(word)
            starts.append(base)
            if n:
                token += [table[b] for b in word]
                after += range(base + 1, base + n)
                after.append(-1)
                before.append(-1)
                before += range(base, base + n - 1)
        # Positions of every pair that makes a token, and the pairs that wait for their rank's turn.
        index: dict[int, list[int]] = {}
        waiting: dict[int, list[int]] = {}
        heap: list[int] = []

        def enter(pair: int, rank: int, at: int) -> None:
            index[pair] = [at]
            if rank in waiting:
                waiting[rank].append(pair)
            else:
                waiting[rank] = [pair]
                heapq.heappush(heap, rank)

        for i, k in enumerate(after):
            if k >= 0:
                pair = token[i] << bits | token[k]
                if pair in index:
                    index[pair].append(i)
                elif (r := rank_of(pair)) is not None:
                    enter(pair, r, i)
        while heap:
            rank = heapq.heappop(heap)
            pairs = waiting.pop(rank)
            # Different pairs may make the same token; the leftmost goes first whichever it is.
            places = index.pop(pairs[0]) if len(pairs) == 1 else [i for p in pairs for i in index.pop(p)]
            places.sort()
            for i in places:
                k = after[i]
                if k < 0 or rank_of(token[i] << bits | token[k]) != rank:
                    continue
                token[i] = rank
                token[k] = -1
                nxt = after[i] = after[k]
                after[k] = -1
                if nxt >= 0:
                    before[nxt] = i
                    pair = rank << bits | token[nxt]
                    if pair in index:
                        index[pair].append(i)
                    elif (r := rank_of(pair)) is not None:
                        enter(pair, r, i)
                prev = before[i]
                if prev >= 0:
                    pair = token[prev] << bits | rank
                    if pair in index:
                        index[pair].append(prev)
                    elif (r := rank_of(pair)) is not None:
                        enter(pair, r, prev)
        out = []
        for start, word in zip(starts, words, strict=True):
            ids = array("I")
            i = start if word else -1
            while i >= 0:
                ids.append(token[i])
                i = after[i]
            out.append(ids)
        return out

    def encode_texts(self, texts: list[str], splitter) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [splitter.findall(t) for t in texts]
        words = list({w for parts in split for w in parts})
        known = dict(zip(words, self.encode_words([w.encode() for w in words]), strict=True))
        return [b"".join([known[w].tobytes() for w in parts]) for parts in split]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids laid end to end, and the number of bytes of each id."""
        return gathered(self.text, self.starts[ids], self.sizes[ids]), self.sizes[ids]


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that begin at ``starts``, laid end to end."""
    return values[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


@lru_cache(maxsize=2)
def load_replay(path: str) -> Replay:
    return Replay(load_ranks(path))


@lru_cache(maxsize=2)
def load_splitter(pattern: str):
    return regex.compile(pattern)


ENCODED = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("decoded", T.BinaryType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def packed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, each byte plane compressed by itself after the planes' sizes; planes of zeros are left out."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    parts = [pa.compress(p.tobytes(), codec="zstd", asbytes=True) if p.any() else b"" for p in planes]
    return np.array([len(p) for p in parts], dtype="<u4").tobytes() + b"".join(parts)


def unpacked(data: bytes, count: int) -> np.ndarray:
    planes = np.zeros((4, count), dtype=np.uint8)
    at = 16
    for plane, size in zip(planes, np.frombuffer(data[:16], dtype="<u4").tolist(), strict=True):
        if size:
            plane[:] = np.frombuffer(pa.decompress(data[at : at + size], count, codec="zstd"), dtype=np.uint8)
            at += size
    return np.ascontiguousarray(planes.T).view("<u4")[:, 0]


def packed_words(words: list[str]) -> bytes:
    """Words as the size of their sizes, their (packed) sizes in bytes, and their compressed bytes."""
    raw = [w.encode() for w in words]
    sizes = packed(np.array([len(r) for r in raw]))
    return len(sizes).to_bytes(4, "little") + sizes + pa.compress(b"".join(raw), codec="zstd", asbytes=True)


def unpacked_words(data: bytes, count: int) -> list[bytes]:
    stop = 4 + int.from_bytes(data[:4], "little")
    ends = np.cumsum(unpacked(data[4:stop], count), dtype=np.int64).tolist()
    text = pa.decompress(data[stop:], ends[-1], codec="zstd", asbytes=True)
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Words(dict):
    """Distinct words, numbered from 0 as they come."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number

    def numbers(self, words: list[str]) -> array:
        return array("I", map(self.__getitem__, words))


def by_slot(words: list[str], slots: int) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """Slot, places (ascending) and words of each slot that has any."""
    digest = xxhash.xxh64_intdigest
    slot = np.array([digest(w) % slots for w in words], dtype=np.int64)
    order = np.argsort(slot, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(slot[order])) + 1) if len(order) else []:
        yield int(slot[part[0]]), part, [words[i] for i in part]


def replayed(batches: Iterator[pa.RecordBatch], encode) -> Iterator[pa.RecordBatch]:
    """Ids for the rows of words among (place, chunk, n_documents, n_words, numbers, words) rows in order of place: chunk,
    n_words, numbers, how many ids, and the token counts and ids.

    ``encode`` maps a list of byte strings to their ids; each distinct word of a place goes through it once.
    """
    held, known = None, {}
    for batch in batches:
        batch = batch.filter(batch.column(2).is_null())
        slots, many = np.asarray(batch.column(0)), batch.column(3).to_pylist()
        for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(slots)) + 1) if batch.num_rows else []:
            if held != slots[part[0]]:
                held, known = slots[part[0]], {}
            lists = [unpacked_words(batch.column(5)[i].as_py(), many[i]) for i in part.tolist()]
            fresh = list(dict.fromkeys(w for words in lists for w in words if w not in known))
            ends = np.cumsum([len(w) for w in fresh])
            at = 0
            while at < len(fresh):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + REPLAY_BYTES, side="right")))
                known.update(zip(fresh[at:stop], encode(fresh[at:stop]), strict=True))
                at = stop
            found = [[known[w] for w in words] for words in lists]
            counts = [packed(np.array([len(x) for x in ids])) for ids in found]
            joined = [packed(np.frombuffer(b"".join([x.tobytes() for x in ids]), dtype="<u4")) for ids in found]
            kept = [batch.column(k).take(pa.array(part)) for k in (1, 3, 4)]
            sizes = pa.array([sum(map(len, ids)) for ids in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*kept, sizes, pa.array(counts, pa.binary()), pa.array(joined, pa.binary())], ["chunk", "n_words", "numbers", "n_ids", "counts", "ids"])


def encode_documents(df: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None, digests_only: bool = False) -> DataFrame:
    """``keep`` columns, the ids of each whole text, the bytes they decode to, and both digests. See the module docstring.

    ``digests_only`` leaves out the ``ids`` and ``decoded`` columns, so that no text-sized value leaves the worker. A kept
    column whose name is among the made ones gives way to the made one.
    """
    path = path or public_path("byte_bpe_multi_50k.tiktoken")
    pattern = split_pattern()
    made = T.StructType([f for f in ENCODED if not (digests_only and f.name in ("ids", "decoded"))])
    keep = [k for k in keep if k.lower() not in {f.name for f in made}]
    slots = max(LEAST_SLOTS, df.rdd.getNumPartitions())
    places = 2 * slots
    # Columns get places for names here, so that none can clash.
    source = df.select(F.col(quoted(text_col)).alias("text"), *[F.col(quoted(n)).alias(f"k{i}") for i, n in enumerate(keep)])
    fields = [T.StructField(f"k{i}", T.ArrayType(source.schema[f"k{i}"].dataType)) for i in range(len(keep))]
    names = [f.name for f in fields]
    piece = T.StructType([T.StructField("place", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("n_documents", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("numbers", T.BinaryType()), T.StructField("words", T.BinaryType()), T.StructField("ends", T.ArrayType(T.LongType())), *fields])
    kinds = [to_arrow_type(f.dataType) for f in piece]

    def chunk_rows(chunk: int, words: Words, numbers: list[array], parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = lambda v, kind: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v.cast(kind.value_type))
        coded = np.frombuffer(b"".join([n.tobytes() for n in numbers]), dtype="<u4")
        # The commonest word gets the smallest number, so that numbers pack well.
        order = np.argsort(-np.bincount(coded, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), dtype="<u4")
        rank[order] = np.arange(len(words))
        listed_words = list(words)
        for slot, places, mine in by_slot([listed_words[i] for i in order.tolist()], slots):
            row = [pa.array([slot]), pa.array([slots + chunk]), pa.nulls(1, kinds[2]), pa.array([len(mine)]), pa.array([packed(np.diff(places, prepend=0))], pa.binary()), pa.array([packed_words(mine)], pa.binary())]
            yield pa.RecordBatch.from_arrays(row + [pa.nulls(1, k) for k in kinds[6:]], names=piece.names)
        ends = pa.array(offsets_of([len(n) for n in numbers])[1:])
        row = [pa.array([slots + chunk]), pa.nulls(1, kinds[1]), pa.array([len(ends)]), pa.array([len(coded)]), pa.array([packed(rank[coded])], pa.binary()), pa.nulls(1, kinds[5]), listed(ends, kinds[6])]
        kept = [pa.concat_arrays([p.column(p.schema.get_field_index(n)) for p in parts]) for n in names]
        yield pa.RecordBatch.from_arrays(row + [listed(v, k) for v, k in zip(kept, kinds[7:], strict=True)], names=piece.names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, first = load_splitter(pattern), TaskContext.get().partitionId() << 32
        words, numbers, parts, size = Words(), [], [], 0
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_BYTES):
                texts = texts_of(part, "text")
                here = sum(map(len, texts))
                if parts and size + here > CHUNK_BYTES:
                    yield from chunk_rows(first, words, numbers, parts)
                    first, words, numbers, parts, size = first + 1, Words(), [], [], 0
                numbers += [words.numbers(splitter.findall(t)) for t in texts]
                parts.append(part)
                size += here
        if parts:
            yield from chunk_rows(first, words, numbers, parts)

    # Words go to their slots and documents to their chunks' places (which lie beyond the slots) in one exchange, which is
    # computed once and read twice, whole both times, and the ids come to where the documents are.
    sent = source.mapInArrow(cut, piece).repartition(places, "place")
    ids = sent.sortWithinPartitions("place").mapInArrow(lambda batches: replayed(batches, load_replay(path).encode_words), "chunk long, n_words long, numbers binary, n_ids long, counts binary, ids binary")
    parts = ids.repartition(places, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("n_words", "numbers", "n_ids", "counts", "ids")).alias("parts"))
    both = sent.join(parts.withColumnRenamed("chunk", "place"), "place", "left")
    out = T.StructType([*[source.schema[n] for n in names], *made])
    outs = [to_arrow_type(f.dataType) for f in made]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            for i, many in enumerate(column("n_words").to_pylist()):
                if not column("n_documents")[i].is_valid:
                    continue
                size, start, flat = _laid_out(column("parts")[i].as_py() or [])
                ends, coded = np.asarray(column("ends")[i].values), unpacked(column("numbers")[i].as_py(), many)
                at = 0
                while at < len(ends):
                    base = int(ends[at - 1]) if at else 0
                    stop = max(at + 1, int(np.searchsorted(ends, base + JOINED_WORDS, side="right")))
                    values = _documents(load_replay(path), coded[base : ends[stop - 1]], ends[at:stop] - base, size, start, flat)
                    kept = [column(n)[i].values.slice(at, stop - at) for n in names]
                    yield pa.RecordBatch.from_arrays([*kept, *[pa.array(values[f.name], type=k) for f, k in zip(made, outs, strict=True)]], names=out.names)
                    at = stop

    return both.mapInArrow(join, out).select(*[F.col(f"k{i}").alias(n) for i, n in enumerate(keep)], *made.names)


def _laid_out(parts: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token count and first token's place of each word number, and the tokens."""
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype="<u4")
    which = np.concatenate([np.cumsum(unpacked(p["numbers"], p["n_words"]), dtype=np.int64) for p in parts])
    many = np.concatenate([unpacked(p["counts"], p["n_words"]) for p in parts]).astype(np.int64)
    size, start = np.zeros(len(which), dtype=np.int64), np.zeros(len(which), dtype=np.int64)
    size[which], start[which] = many, np.cumsum(many) - many
    return size, start, np.concatenate([unpacked(p["ids"], p["n_ids"]) for p in parts])


def _documents(replay: Replay, coded: np.ndarray, ends: np.ndarray, size: np.ndarray, start: np.ndarray, flat: np.ndarray) -> dict[str, list]:
    """The made columns of documents whose words ``coded`` end at ``ends``."""
    sizes = size[coded]
    ids = gathered(flat, start[coded], sizes)
    token_ends = offsets_of(sizes)[ends]
    text, lengths = replay.decode(ids)
    byte_ends = offsets_of(lengths)[token_ends]
    cut = lambda v, stops: [v[a:b].tobytes() for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
    tokens, back = cut(ids, token_ends), cut(text, byte_ends)
    return {
        "n_tokens": np.diff(token_ends, prepend=0).tolist(),
        "ids": tokens,
        "decoded": back,
        "ids_sha256": [hashlib.sha256(x).hexdigest() for x in tokens],
        "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back],
    }
