"""Operator 4: token counts, by batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes, not rows, and long texts are split where no token can cross: before a
single space that follows a character other than white space and precedes one. There the public
byte-level pattern always begins a new piece, so the parts' counts add up to the whole's.

Long runs of white space, of which the pattern makes one piece but for the last character before a word, are
taken out and encoded as that piece, so that the pattern never has to walk back over them.

Defined results. A null text has a null count, an empty one 0. Special tokens in a text are ordinary text.
Texts of any length are counted whole. Each row stands for itself: there are no ties, repeated rows are counted alike,
a null doc_id is carried. An empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.arrays import column, pieces

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BATCH_BYTES, SPLIT_CHARS = 1 << 20, 1 << 16
#: White space as the pattern has it, in runs that are taken out.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{256,}")
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def encoder(path: str):
    """The byte-level encoding of a vocabulary file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def split(text: str, limit: int = SPLIT_CHARS) -> list[str]:
    """Parts of about limit characters, cut only where no token crosses; longer where there is no such place."""
    if len(text) <= limit:
        return [text]
    out, at = [], 0
    while len(text) - at > limit:
        m = _SAFE.search(text, at + limit)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def pieces_of(text: str) -> list[tuple[str, bool]]:
    """The parts of a text, each with whether it is a piece of white space as a whole."""
    out, at = [], 0
    for m in _BLANKS.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += [*((x, False) for x in split(text[at : m.start()]) if x), (text[m.start() : end], True)]
        at = end
    return [*out, *((x, False) for x in split(text[at:]) if x)]


def encode(enc, texts: list[str | None]) -> list[list[list[int]] | None]:
    """The ids of each text by its parts; the parts of all texts are encoded as one batch."""
    parts = [None if t is None else pieces_of(t) for t in texts]
    got = iter(enc.encode_ordinary_batch([x for p in parts if p for x, blank in p if not blank], num_threads=1))
    return [None if p is None else [enc._encode_single_piece(x) if blank else next(got) for x, blank in p] for p in parts]


def lengths(enc, texts: list[str | None]) -> list[int | None]:
    """The token count of each text."""
    return [None if p is None else sum(map(len, p)) for p in encode(enc, texts)]


def _count(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        for p in pieces(batch, "text", BATCH_BYTES):
            text = column(p, "text")
            yield pa.RecordBatch.from_arrays([column(p, "doc_id"), pc.cast(pc.binary_length(text), pa.int64()), pa.array(lengths(enc, text.to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row."""
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(functools.partial(_count, vocabulary), "doc_id bigint, n_bytes bigint, n_tokens bigint")
