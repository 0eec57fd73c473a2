"""Encoding of the whole corpus with a public tokenizer, by monoid tree reduction.

A text is halved until the pieces are short, the pieces are encoded, and neighbours are
joined up the tree.  The join is exact: the pre-tokenizer reads from left to right and never
looks behind, so (1) every pre-token of the left part but those that reach its end is one
of the whole text, and (2) as soon as a pre-token of the re-read window begins where
one of the right part begins, both readings agree from there on.  The window starts at the
last sure pre-token of the left part and grows into the right part until (2) holds.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyral.session import table

TOKENIZER_DIR = os.environ.get("PAPYRAL_TOKENIZER_DIR", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k"
#: Characters of a leaf of the tree.
LEAF = 768
#: First size of the window into the right part, in characters; it doubles.
WINDOW = 32
#: Fixed value: the pre-tokenizer pattern published with this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(directory: str = TOKENIZER_DIR, name: str = TOKENIZER):
    """The byte-level BPE as a tiktoken encoding without special tokens."""
    import tiktoken

    with open(os.path.join(directory, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(PATTERN)


class Piece:
    """A text with its ids: the element of the monoid."""

    __slots__ = ("text", "ids")

    def __init__(self, text: str, ids: np.ndarray):
        self.text, self.ids = text, ids


def _encode(text: str, enc) -> np.ndarray:
    return np.asarray(enc.encode_ordinary(text), dtype=np.int32)


def _tail(text: str) -> int:
    """Where the last sure pre-token of ``text`` begins: those before it are the same whatever follows."""
    split = _splitter()
    reach = WINDOW
    while True:
        at = max(0, len(text) - reach)
        # A pre-token start is certain at 0, and after a change from letter to non-space (never inside a run).
        while at > 0 and not (text[at].isspace() and not text[at - 1].isspace()):
            at -= 1
            if len(text) - at > 4 * reach:
                break
        if at == 0 or (text[at].isspace() and not text[at - 1].isspace()):
            starts = [m.start() for m in split.finditer(text, at)]
            if at == 0 or len(starts) >= 3:
                return starts[-3] if len(starts) >= 3 else 0
        if reach >= len(text):
            return 0
        reach *= 2


def join(left: Piece, right: Piece, enc) -> Piece:
    """The piece of ``left.text + right.text``; only a window around the border is encoded again."""
    if not left.text:
        return right
    if not right.text:
        return left
    split = _splitter()
    cut = _tail(left.text)
    border = len(left.text) - cut
    reach = WINDOW
    while True:
        if reach >= len(right.text):
            middle, n_head = _encode(left.text[cut:] + right.text, enc), len(right.ids)
            break
        head = right.text[:reach]
        own = [m.start() for m in split.finditer(head)]
        window = left.text[cut:] + head
        both = {m.start() - border for m in split.finditer(window)}
        # The last two pre-tokens of a reading may yet grow with what follows; white space is cut differently where a text ends.
        sure = [a for a in own[1:-2] if a in both and not head[a - 1].isspace()]
        if sure:
            keep = sure[0]
            middle = enc.encode_ordinary(window[: border + keep])
            n_head = len(enc.encode_ordinary(head[:keep]))
            break
        reach *= 2
    n_tail = len(enc.encode_ordinary(left.text[cut:]))
    ids = np.concatenate([left.ids[: len(left.ids) - n_tail], np.asarray(middle, np.int32), right.ids[n_head:]])
    return Piece(left.text + right.text, ids)


def encode_tree(text: str, enc=None, leaf: int = LEAF) -> np.ndarray:
    """The ids of ``text``: halves encoded on their own and joined."""
    enc = enc or encoding()

    def reduce(a: int, b: int) -> Piece:
        if b - a <= leaf:
            return Piece(text[a:b], _encode(text[a:b], enc))
        m = (a + b) // 2
        return join(reduce(a, m), reduce(m, b), enc)

    return reduce(0, len(text)).ids


def decode_tree(ids, enc=None) -> str:
    """The text of ``ids``: the bytes of the halves are concatenated."""
    enc = enc or encoding()

    def reduce(a: int, b: int) -> bytes:
        if b - a <= 4096:
            return enc.decode_bytes(list(ids[a:b]))
        m = (a + b) // 2
        return reduce(a, m) + reduce(m, b)

    return reduce(0, len(ids)).decode("utf-8", errors="replace")


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", directory: str = TOKENIZER_DIR, count_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, ids) of every row, ids by the public byte-level BPE without special tokens.

    A null text and an empty one both give the empty list (never null).  Strings that look like control
    tokens are ordinary text.  With ``count_only`` the column is ``n_tokens`` instead.  No shuffle: rows stay
    where they are read, in Arrow batches.
    """
    columns = documents.select(key, *keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(directory)
        for batch in batches:
            parts, n = [], []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                ids = np.empty(0, np.int32) if not t else encode_tree(t, enc)
                n.append(len(ids))
                if not count_only:
                    parts.append(ids)
            if count_only:
                last = pa.array(n, pa.int64())
            else:
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                last = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32), pa.int32()))
            own = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, last], names=[*batch.schema.names[:-1], "n_tokens" if count_only else "ids"])

    kept = ", ".join(f"`{c}` {columns.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return columns.mapInArrow(run, f"{kept}, " + ("n_tokens bigint" if count_only else "ids array<int>"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))
