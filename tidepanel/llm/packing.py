"""Packing by power-of-two decomposition: pieces of binary length, buckets of equal length.

Each document's tokens (with the end id) are cut into full sequences and then
into the powers of two that make up the rest, largest first. A piece is a
sequence of its own, so no sequence crosses documents and none is padded; all
sequences of a bucket have one length.

Defined results
* A null or empty text is the end id alone: one piece of length 1.
* Rows with a null or repeated id are packed like any others, each on its own.
* An empty table gives no pieces. Other columns are not read.
* Long texts are cut into units at spaces; nothing is truncated.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import narrowed

SEQUENCE = 2048
END_ID = 1
CACHED_UNITS = 200_000
# A space beside white space belongs to a run of it, and a run must stay in one piece.
BESIDE_SPACE = re.compile(r"\s | \s|^ | \Z")


def binary_lengths(n: int, longest: int = SEQUENCE) -> list[int]:
    """``n`` as a sum of full sequences and falling powers of two."""
    cuts = [longest] * (n // longest)
    return cuts + [1 << b for b in range(longest.bit_length(), -1, -1) if (n % longest) >> b & 1]


def process_store(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, so that tasks share what is loaded once."""
    return sys.modules.setdefault(f"_tidepanel_{name}", types.ModuleType(name)).__dict__


class UnitEncoder(dict):
    """Token ids of a byte-level BPE vocabulary, looked up by unit: a space and what follows up to the next one.

    The vocabulary attaches a single space to what follows, so a text may be cut
    before any space between two other characters. Each distinct unit is encoded
    once while it stays cached; ids are kept as little-endian 32-bit integers.
    The ids are those of ``tokenizers`` for this file; its ranks are read from
    the file and units are merged by ``tiktoken``, which does the same merges
    faster. Texts with a special token go through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.exact = Tokenizer.from_file(path)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        ranks = {
            bytes(byte_of[c] for c in token): rank
            for token, rank in self.exact.get_vocab(with_added_tokens=True).items()
            if token not in self.special
        }
        # Fixed value: the word pattern of this kind of vocabulary.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        probe = "It's 12 naïve\tcafés,  über\n\n日本 🙂! "
        if self.whole(probe) != self.packed(self.fast.encode_ordinary(probe)):
            raise ValueError(f"{path} is not a byte-level BPE vocabulary with the usual word pattern")

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def whole(self, text: str) -> bytes:
        return self.packed(self.exact.encode(text, add_special_tokens=False).ids)

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= CACHED_UNITS:
            self.clear()
        ids = self.packed(self.fast.encode_ordinary(" " + unit))
        if len(unit) <= 64:
            self[unit] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        if BESIDE_SPACE.search(text):
            return b"".join(self.fast_or_unit(p, i) for i, p in enumerate(safe_pieces(text)))
        first, *units = text.split(" ")
        return self.packed(self.fast.encode_ordinary(first)) + b"".join(map(self.__getitem__, units))

    def fast_or_unit(self, piece: str, i: int) -> bytes:
        return self.packed(self.fast.encode_ordinary(piece)) if i == 0 else self[piece[1:]]


def safe_pieces(text: str) -> list[str]:
    """``text`` cut before each single space that has no white space beside it."""
    pieces, begin, at = [], 0, text.find(" ")
    while at >= 0:
        if 0 < at < len(text) - 1 and not text[at - 1].isspace() and not text[at + 1].isspace():
            pieces.append(text[begin:at])
            begin = at
        at = text.find(" ", at + 1)
    pieces.append(text[begin:])
    return pieces


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    No shuffle: a document is cut where it is read.
    """
    fields = [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
        *([("ids", pa.list_(pa.int32()))] if keep_ids else []),
    ]
    schema = pa.schema(fields)
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = process_store("packing")
        if tokenizer not in store:
            store[tokenizer] = UnitEncoder(tokenizer)
        encode = store[tokenizer].encode

        for batch in batches:
            out = [[] for _ in fields]
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                total, start = len(ids) // 4, 0
                for length in binary_lengths(total):
                    piece = ids[4 * start : 4 * (start + length)]
                    row = [doc_id, start, length, zlib.crc32(piece), total]
                    if keep_ids:
                        row.append(np.frombuffer(piece, dtype="<i4"))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    start += length
                size += total
                if size > 1_000_000:
                    yield pa.record_batch([pa.array(c, f[1]) for c, f in zip(out, fields, strict=True)], schema=schema)
                    out, size = [[] for _ in fields], 0
            yield pa.record_batch([pa.array(c, f[1]) for c, f in zip(out, fields, strict=True)], schema=schema)

    ddl = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * keep_ids
    pieces = narrowed(docs, id_col, text_col).mapInArrow(cut, ddl)
    # A piece is a sequence, so any unique number names it and it starts at 0.
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Parquet with a folder per length: every batch drawn from one folder is rectangular without padding."""
    pieces.hint("rebalance", "length").write.partitionBy("length").parquet(path)
