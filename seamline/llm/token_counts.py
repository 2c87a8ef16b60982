"""Token counts: batch encoding in an Arrow function that returns lengths only.

Texts are cut at safe boundaries into pieces of about ``PIECE_BYTES``, pieces are gathered into batches of about
``BATCH_BYTES``, and each batch is encoded at once; only the lengths leave the worker. The vocabulary is the byte-level BPE of ``byte_bpe_50k``; its rank file holds
the same tokens as its JSON file, and the rank encoder is several times faster. The JSON library's default treatment of
``<|endoftext|>`` inside a text (one token, never merged with its surroundings) is kept.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); a text with no safe boundary is encoded whole; equal
texts give equal counts; repeated rows stay repeated; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seamline.llm.arrow import append_columns, texts_of
from seamline.llm.vocabularies import load_encoding, public_path, split_pattern

#: Strings that the tokenizer file marks as one token each.
SPECIAL = "<|endoftext|>"
#: Bytes after which the next safe boundary ends a piece.
PIECE_BYTES = 1 << 15
#: Bytes of pieces that are encoded in one call.
BATCH_BYTES = 1 << 20
#: Between a letter or digit and a single space before a letter, and between a letter and the punctuation of scripts that
#: are written without spaces, every tokenizer pattern of this family starts a new match, whatever stands further left or right.
BOUNDARY = regex.compile(r"(?<=[\p{L}\p{N}])(?= \p{L})|(?<=\p{L})(?=[。，、！？；：「」『』（）।።။។])")


def utf8_length(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def safe_pieces(text: str, limit: int = PIECE_BYTES) -> Iterator[str]:
    """Pieces of ``text`` whose token counts add up to that of the whole; their concatenation is ``text``."""
    start, size = 0, utf8_length(text)
    step = max(1, limit * len(text) // size) if size > limit else len(text)
    while len(text) - start > step:
        cut = BOUNDARY.search(text, start + step)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    if start < len(text):
        yield text[start:] if start else text


def balanced_lengths(encode, texts: list[str], batch_bytes: int = BATCH_BYTES) -> list[int]:
    """Token counts per text; ``encode`` maps a list of strings to lists of ids."""
    counts = [0] * len(texts)
    owners: list[int] = []
    pieces: list[str] = []
    held = 0

    def flush() -> None:
        nonlocal held
        for owner, ids in zip(owners, encode(pieces), strict=True):
            counts[owner] += len(ids)
        owners.clear()
        pieces.clear()
        held = 0

    for i, text in enumerate(texts):
        parts = text.split(SPECIAL)
        counts[i] += len(parts) - 1
        for part in parts:
            for piece in safe_pieces(part):
                owners.append(i)
                pieces.append(piece)
                held += utf8_length(piece)
                if held >= batch_bytes:
                    flush()
    if pieces:
        flush()
    return counts


COUNTED = T.StructType(
    [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
)


def count_tokens(df: DataFrame, keep: list[str], text_col: str = "text", limit: int = 1024, path: str | None = None) -> DataFrame:
    """``keep`` columns plus n_bytes (UTF-8), n_tokens and over_limit (``n_tokens > limit``). See the module docstring."""
    path = path or public_path("byte_bpe_50k.tiktoken")
    pattern = split_pattern()

    def make(part) -> list:
        encoding = load_encoding(path, pattern)
        texts = texts_of(part, text_col)
        counts = balanced_lengths(lambda pieces: encoding.encode_ordinary_batch(pieces, num_threads=1), texts)
        return [[utf8_length(t) for t in texts], counts, [n > limit for n in counts]]

    return append_columns(df, keep, text_col, COUNTED, make)
