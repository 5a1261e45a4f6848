"""Alignment of two tokenizers over the same bytes, and how often two of their tokens are linked in the corpus.

Merge path. The ends of A's and B's tokens are two sorted sequences. Merging
them is divided by diagonals: a binary search on each finds how many ends of A
and of B come before it, so all pieces hold the same number of ends, whatever
the texts are, and are merged independently. A piece emits the overlaps
whose last byte it holds. Where A and B end at the same byte on both sides of a
boundary, the later piece drops its half and the earlier one's overlap closes
the group; groups that reach over boundaries are numbered through.

Corpus counts. A block of texts numbers its distinct id pairs, the most frequent
first, and keeps its links as such numbers. One row per distinct pair and block
is counted over the corpus and sent back to the block, so that a pair in every
document is one row per block and no table of all pairs has to fit anywhere.
The aligned blocks are written once to the shared folder.

Encoding. Both vocabularies attach a single space to what follows and have no
token that reaches over it, so texts are cut before such spaces and each
distinct unit is encoded once while it stays cached. A unit whose bytes do not
come back sends its whole text through the libraries as it is.

Defined results
* Strings of special tokens are plain text. A text whose bytes do not come back from either side has no tokens, like an empty or null one: zeros and ''.
* Null and repeated ids are answered row by row. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.llm.common import narrowed
from tidepanel.llm.packing import BESIDE_SPACE, UnitEncoder, process_store, safe_pieces
from tidepanel.session import scratch_path

PIECE_ENDS = 1 << 16
# Texts are aligned together up to this size; a longer text alone.
CHUNK_BYTES = 1 << 20
CACHED_UNITS = 300_000
SPACE_MARK = "▁"


def diagonals(a: np.ndarray, b: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """For every ``step`` elements of the merged order (of equal ones a's first), how many come from ``a`` and from ``b``."""
    d = np.append(np.arange(0, len(a) + len(b), step), len(a) + len(b))
    low, high = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        first = np.zeros(len(d), bool)
        first[open_] = a[middle[open_]] <= b[d[open_] - middle[open_] - 1]
        low = np.where(open_ & first, middle + 1, low)
        high = np.where(open_ & ~first, middle, high)
    return low, d - low


def merge_piece(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token of A, token of B, whether both end here) of each overlap that ends in a piece, for its ends and its first tokens."""
    ends = np.concatenate((a, b))
    order = np.argsort(ends, kind="stable")
    ends, from_a = ends[order], order < len(a)
    before_a = np.cumsum(from_a) - from_a
    same = np.append(ends[1:] == ends[:-1], False)
    once = ~np.concatenate(([False], same[:-1]))
    at = np.flatnonzero(once)
    return i + before_a[at], j + at - before_a[at], same[at]


def overlaps(a: np.ndarray, b: np.ndarray, step: int = PIECE_ENDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlaps of two tokenizations of the same bytes, given their sorted ends; see :func:`merge_piece`."""
    from_a, from_b = diagonals(a, b, step)
    parts = []
    for i, k, j, m in zip(from_a[:-1].tolist(), from_a[1:].tolist(), from_b[:-1].tolist(), from_b[1:].tolist(), strict=True):
        if i == k and j == m:
            continue
        # The end before this piece is A's and the piece begins with the same end of B: one overlap, told by the piece before.
        halved = 0 < i and j < m and a[i - 1] == b[j]
        if halved:
            parts[-1][2][-1] = True
            j += 1
        if i < k or j < m:
            parts.append(merge_piece(a[i:k], b[j:m], i, j))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


class PairEncoder(dict):
    """Ids of both tokenizers by unit, a unit being what stands between two cuts without its space; False if its bytes do not come back from B."""

    def __init__(self, bpe_path: str, pieces_path: str):
        import sentencepiece

        super().__init__()
        self.bpe = UnitEncoder(bpe_path)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.bpe.exact.encode_special_tokens = True
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        if any(SPACE_MARK in n.lstrip(SPACE_MARK) for n in names):
            raise ValueError(f"{pieces_path} has pieces that reach over a space")
        a_bytes = {self.bpe.fast.encode_single_token(t): t for t in self.bpe.fast.token_byte_values()}
        if {t for t in a_bytes.values() if len(t) == 1} != {bytes([k]) for k in range(256)}:
            raise ValueError(f"{bpe_path} lacks a token for some byte")
        self.b_bytes = [
            bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace(SPACE_MARK, " ").encode() for i, n in enumerate(names)
        ]
        self.a_length = np.zeros(max(a_bytes) + 1, np.int64)
        for rank, token in a_bytes.items():
            self.a_length[rank] = len(token)
        self.b_length = np.array([len(t) for t in self.b_bytes], np.int64)
        # What is written for a token: its id and whether it is the last one of its side in the group.
        self.b_first = 2 * len(self.a_length)
        written = [b"%d%b" % (i, end) for i in range(len(self.a_length)) for end in (b",", b"|")]
        written += [b"%d%b" % (i, end) for i in range(len(self.b_length)) for end in (b",", b";")]
        self.written = np.array(written, object)

    def gives_back(self, ids: list[list[int]], text: str) -> bool:
        """Whether the bytes of B's tokens are those of ``text``."""
        return b"".join(map(self.b_bytes.__getitem__, chain.from_iterable(ids))) == text.encode()

    def learn(self, units: list[str]) -> list[tuple[bytes, bytes] | bool]:
        """Encodes units, all of B's in one call and all of A's as one text, and caches them; False where B loses bytes.

        A has a token for every byte, so its bytes always come back.
        """
        joined = " " + " ".join(units)
        a = np.array(self.bpe.fast.encode_ordinary(joined), "<u4")
        unit_ends = np.cumsum([len(u.encode()) + 1 for u in units])
        cuts = (4 * (np.searchsorted(np.cumsum(self.a_length[a]), unit_ends) + 1)).tolist()
        a = a.tobytes()
        b = self.pieces.encode(units, num_threads=1)
        sure = self.gives_back(b, joined)
        found = [
            (a[s:e], array("I", ids).tobytes()) if sure or self.gives_back([ids], " " + unit) else False
            for unit, s, e, ids in zip(units, [0, *cuts], cuts, b, strict=False)
        ]
        if len(self) + len(found) > CACHED_UNITS:
            self.clear()
        if len(joined) <= 64 * CACHED_UNITS:
            self.update(zip(units, found, strict=True))
        return found

    def encode(self, text: str) -> tuple[bytes, bytes] | None:
        """Ids of both sides, little-endian and of 32 bits; None for a text without tokens."""
        # The mark would come back as a space.
        if not text or SPACE_MARK in text:
            return None
        units = [p[1:] for p in safe_pieces(" " + text)] if BESIDE_SPACE.search(text) else text.split(" ")
        found = list(map(self.get, units))
        if None in found:
            unseen = [k for k, ids in enumerate(found) if ids is None]
            for k, ids in zip(unseen, self.learn([units[k] for k in unseen]), strict=True):
                found[k] = ids
        if False in found:
            a, b = self.bpe.exact.encode(" " + text, add_special_tokens=False).ids, self.pieces.encode(text)
            return (array("I", a).tobytes(), array("I", b).tobytes()) if self.gives_back([b], " " + text) else None
        a, b = zip(*found, strict=True)
        return b"".join(a), b"".join(b)

    def align(self, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """((n_a, n_b, n_groups, n_links, groups_sha256) of each text, links by text, id of A and id of B of each link)."""
        ids = [self.encode(t) or (b"", b"") for t in texts]
        a, b = (np.frombuffer(b"".join(side), "<u4").astype(np.int64) for side in zip(*ids, strict=True))
        a_from, b_from = (np.concatenate(([0], np.cumsum([len(x) // 4 for x in side]))) for side in zip(*ids, strict=True))
        # Both sides of a text have the same bytes, so texts one after the other stay apart.
        i, j, closes = overlaps(np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b]))
        links = np.searchsorted(i, a_from)
        closed = np.concatenate(([0], np.cumsum(closes)))
        group = closed[:-1]
        a_group = group[np.diff(i, prepend=-1) > 0]
        b_group = group[np.diff(j, prepend=-1) > 0]

        n_groups = int(closed[-1])
        a_in, b_in = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
        listed = np.empty(len(a) + len(b), np.int64)
        listed[np.arange(len(a)) + (np.cumsum(b_in) - b_in)[a_group]] = 2 * a + np.diff(a_group, append=-1).astype(bool)
        listed[np.arange(len(b)) + np.cumsum(a_in)[b_group]] = self.b_first + 2 * b + np.diff(b_group, append=-1).astype(bool)
        written = self.written[listed].tolist()
        rows = []
        for k in range(len(texts)):
            n_a, n_b = int(a_from[k + 1] - a_from[k]), int(b_from[k + 1] - b_from[k])
            of_text = b"".join(written[a_from[k] + b_from[k] : a_from[k + 1] + b_from[k + 1]])[:-1]
            sha = hashlib.sha256(of_text).hexdigest() if n_a else ""
            rows.append((n_a, n_b, int(closed[links[k + 1]] - closed[links[k]]), int(links[k + 1] - links[k]), sha))
        return rows, links, a[i], b[j]


def packed_numbers(x: np.ndarray, width: int) -> bytes:
    """Numbers of ``width`` bytes, their bytes of one rank together, compressed."""
    import zstandard

    planes = x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpacked_numbers(data: bytes, width: int) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u4").ravel()


_ROW = [
    ("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("width", pa.int32()), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())),
]
_ROW_DDL = (
    "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, width int, links binary,"
    " pairs array<bigint>, times array<bigint>"
)
_COUNTED = [(n, t) for n, t in _ROW[1:6]] + [("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())]
_COUNTED_DDL = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    begin, size, held = 0, 0, []
    for k, cell in enumerate(texts):
        text = cell.as_py()
        held.append(text)
        size += len(text)
        if size >= CHUNK_BYTES:
            yield begin, held
            begin, size, held = k + 1, 0, []
    if held:
        yield begin, held


def _aligned(bpe_path: str, pieces_path: str):
    schema = pa.schema(_ROW)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = process_store("alignment")
        if (bpe_path, pieces_path) not in store:
            store[bpe_path, pieces_path] = PairEncoder(bpe_path, pieces_path)
        encoder = store[bpe_path, pieces_path]
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows, parts = [], []
            for _, texts in _chunks(batch.column(1)):
                found, links, a, b = encoder.align(texts)
                rows += found
                pairs, number, times = np.unique((a << 32) | b, return_inverse=True, return_counts=True)
                parts.append((pairs, number.astype(np.uint32), times, links))
            pairs, number = np.unique(np.concatenate([p[0] for p in parts] or [np.empty(0, np.int64)]), return_inverse=True)
            times = np.zeros(len(pairs), np.int64)
            np.add.at(times, number, np.concatenate([p[2] for p in parts] or [np.empty(0, np.int64)]))
            often = np.argsort(-times, kind="stable")
            place = np.empty(len(pairs), np.uint32)
            place[often] = np.arange(len(pairs), dtype=np.uint32)
            number, width = place[number], max(1, (len(pairs).bit_length() + 7) // 8)
            packed, begin = [], 0
            for own, of_links, _, links in parts:
                numbers = number[begin : begin + len(own)][of_links]
                begin += len(own)
                packed += [packed_numbers(numbers[s:e], width) if e > s else None for s, e in zip(links[:-1].tolist(), links[1:].tolist())]
            n = len(ids)
            yield pa.record_batch(
                [pa.array(c, t) for c, (_, t) in zip([[block] * n, ids, *(zip(*rows) if rows else [[]] * 5), [width] * n, packed, [None] * n, [None] * n], _ROW, strict=True)],
                schema=schema,
            )
            if len(pairs):
                one = [[block], *[[None]] * 8, [pairs[often]], [times[often]]]
                yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(one, _ROW, strict=True)], schema=schema)
            block += 1

    return made


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the links of each document, from rows sorted by block: first the block's counts by number, then its documents."""
    schema = pa.schema(_COUNTED)
    block, held, count, best = None, [], np.empty(0, np.int64), np.empty(0, bool)
    for batch in batches:
        blocks, is_doc = batch.column("block").to_numpy(), batch.column("is_doc").to_numpy(zero_copy_only=False)
        rows = []
        turns = np.flatnonzero(np.diff(blocks) | np.diff(is_doc.view(np.int8))) + 1
        for s, e in zip([0, *turns.tolist()], [*turns.tolist(), len(blocks)]):
            if s == e:
                continue
            if blocks[s] != block:
                block, held, count, best = blocks[s], [], np.empty(0, np.int64), np.empty(0, bool)
            if not is_doc[s]:
                held.append((batch.column("n")[s:e].to_numpy(), batch.column("best")[s:e].to_numpy(zero_copy_only=False)))
                continue
            if held:
                count, best = (np.concatenate(x) for x in zip((count, best), *held, strict=True))
                held = []
            plain = [batch.column(c)[s:e].to_pylist() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "width", "links")]
            for *row, sha, width, links in zip(*plain, strict=True):
                sums = (0, 0)
                if links is not None:
                    numbers = unpacked_numbers(links, width)
                    sums = int(best[numbers].sum()), int(count[numbers].sum())
                rows.append((*row, *sums, sha))
        columns = zip(*rows) if rows else [[]] * len(_COUNTED)
        yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, _COUNTED, strict=True)], schema=schema)


def align_documents(docs: DataFrame, bpe_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, pairs).

    documents: one row per document with doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. pairs: a_id, b_id,
    n (links of the pair in the corpus) and best (n is the highest of its b_id).
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "aligned")
    narrowed(docs, id_col, text_col).mapInArrow(_aligned(bpe_path, pieces_path), _ROW_DDL).write.parquet(path)
    written = spark.read.schema(_ROW_DDL).parquet(path)

    entries = written.where(F.col("pairs").isNotNull()).select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("pos", "e"))
    entries = entries.select("block", "pos", F.col("e.pairs").alias("pair"), F.col("e.times").alias("times"))
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    counts = entries.groupBy("pair").agg(F.sum("times").alias("n"))
    # One row per distinct pair: the window of an id of B is at most as long as A's vocabulary.
    counts = counts.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy(b_id)))
    sent = entries.select("block", "pos", "pair").join(counts, "pair")
    nothing = {c: F.lit(None).cast(t) for c, t in written.dtypes if c not in ("block", "pairs", "times")}
    sent = sent.select("block", F.lit(False).alias("is_doc"), "pos", "n", "best", *[v.alias(c) for c, v in nothing.items()])
    texts = written.where(F.col("pairs").isNull()).select(
        "block", F.lit(True).alias("is_doc"), F.lit(0).alias("pos"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("boolean").alias("best"), *nothing
    )
    met = sent.unionByName(texts).repartition("block").sortWithinPartitions("block", "is_doc", "pos")
    pairs = counts.select(F.shiftright("pair", 32).alias("a_id"), b_id.alias("b_id"), "n", "best")
    return met.mapInArrow(_summed, _COUNTED_DDL), pairs
