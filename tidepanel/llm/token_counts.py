"""Token counts: batches balanced by bytes, long texts split at safe boundaries, lengths only.

Defined results
* A null or empty text has 0 bytes and 0 tokens.
* Null and repeated ids are counted row by row. An empty table gives an empty result.
* A long text without a safe boundary is encoded whole; nothing is truncated.
* Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidepanel.llm.common import narrowed
from tidepanel.llm.packing import process_store

LIMIT = 4096
PIECE_CHARS = 4096
BATCH_BYTES = 1 << 20


def split_safely(text: str, size: int = PIECE_CHARS) -> list[str]:
    """``text`` in pieces of about ``size`` characters whose token counts add up to its own.

    The vocabulary marks a word's start by its space and has no piece in which
    the mark follows something else. So a cut at a single space is safe; the
    space itself goes, as the encoder puts a mark before each piece.
    """
    pieces, begin = [], 0
    while len(text) - begin > size:
        at = text.find(" ", begin + size)
        while at >= 0 and (at + 1 >= len(text) or text[at - 1] in " ▁" or text[at + 1] in " ▁"):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        pieces.append(text[begin:at])
        begin = at + 1
    pieces.append(text[begin:])
    return pieces


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row, with a sentencepiece model; no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        store = process_store("token_counts")
        if model not in store:
            store[model] = sentencepiece.SentencePieceProcessor(model_file=model)
            inner = [p for p in map(store[model].id_to_piece, range(store[model].get_piece_size())) if "▁" in p.lstrip("▁")]
            if inner:
                raise ValueError(f"{model} has pieces that reach over a space, such as {inner[0]!r}")
        encode = store[model].encode

        for batch in batches:
            n_bytes, n_tokens = [], [0] * batch.num_rows
            pieces, owners, size = [], [], 0
            for i, cell in enumerate(batch.column(1)):
                text = cell.as_py()
                n_bytes.append(len(text.encode()))
                for piece in split_safely(text):
                    pieces.append(piece)
                    owners.append(i)
                    size += len(piece)
                    if size >= BATCH_BYTES:
                        for k, ids in zip(owners, encode(pieces, num_threads=1), strict=True):
                            n_tokens[k] += len(ids)
                        pieces, owners, size = [], [], 0
            for k, ids in zip(owners, encode(pieces, num_threads=1) if pieces else [], strict=True):
                n_tokens[k] += len(ids)
            yield pa.record_batch([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], schema=schema)

    return narrowed(docs, id_col, text_col).mapInArrow(counted, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
