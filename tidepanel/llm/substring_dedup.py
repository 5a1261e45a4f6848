"""Repeated passages by seed and extend: winnowed anchors, extended both ways, maximal repeats kept.

Seeds. Of each window of ``THRESHOLD`` words the run of ``ANCHOR`` words with
the smallest hash is selected (winnowing). The choice depends on the window
alone, so equal windows select equal anchors, and documents that share a window
meet at its anchor.
Extension. Where an anchor also occurs in another document, every window that
selected it is extended over its words to the left and to the right and
compared with the extensions of the same anchor elsewhere, by the hash of all
its words. The smallest doc_id with that extension is its first place.
Repeats. Overlapping repeated windows merge into maximal repeats, and their
words go from each document that isn't the first place.

Copies. Documents with the same bytes as one of a smaller doc_id repeat it
whole, so they are found by their hashes first and not extended again.

Both comparisons sort narrow rows by (hash, doc_id) and stream: the first row of
a run tells the smallest doc_id, so a run of any length takes no memory. Each
task settles what it can before the shuffle: of the rows of a block that have
one hash, only the smallest doc_id has to be compared with other tasks. The rest
repeats it for certain and is dealt evenly, so that a passage or phrase in a
third of all documents doesn't gather in one partition. Hashes
of anchors have 64 bits (a chance hit costs only a needless extension), those of
windows 128 bits.

Defined results
* A null text has no words. A document shorter than a window keeps all its words.
* Anchors and places are gathered by id and, where rows share an id, by a 128-bit hash of the text: no list outgrows one text, and no two texts share one.
* Rows that share an id never remove words from each other; a null id counts as larger than any other.
* Repeats inside one document stay. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import BROADCAST_ROWS, narrowed
from tidepanel.llm.exact_dedup import content_hash
from tidepanel.session import pinned

THRESHOLD = 13
ANCHOR = 6
NO_ID = (1 << 63) - 1
# In the place of a window's start: the whole text is a copy.
COPY = 0xFFFFFFFF
CACHED_WORDS = 300_000
# Rows that are compared with each other before they are shuffled.
BLOCK_ROWS = 400_000
# States of an anchor's row: not seen elsewhere in its block, the smallest id of several, a larger id.
ALONE, LEAST, LATER = 0, 1, 2
_SIGN = np.int64(-(1 << 63))

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """64-bit hashes of words; the usual words stay cached."""

    def __init__(self):
        import xxhash

        super().__init__()
        self.hashed = xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = h = self.hashed(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def run_hashes(x: np.ndarray, k: int, salt: int) -> np.ndarray:
    """A hash for each run of ``k`` values, as a polynomial of them."""
    n = len(x) - k + 1
    x, odd = mixed(x ^ np.uint64(_ODD[salt] >> 1)), np.uint64(_ODD[salt] | 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * odd + x[j : j + n]
    return mixed(h)


def selected(x: np.ndarray, threshold: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor hash of each run of ``anchor`` words, position of the anchor that each window selects: the last smallest)."""
    runs = run_hashes(x, anchor, 0)
    n, w = len(x) - threshold + 1, threshold - anchor + 1
    best, at = runs[:n].copy(), np.arange(n)
    for j in range(1, w):
        smaller = runs[j : j + n] <= best
        best = np.where(smaller, runs[j : j + n], best)
        at = np.where(smaller, np.arange(j, j + n), at)
    return runs, at


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def runs_of(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    turns = np.zeros(max(len(sorted_keys[0]) - 1, 0), bool)
    for k in sorted_keys:
        turns |= k[1:] != k[:-1]
    return np.concatenate(([0], np.flatnonzero(turns) + 1))


def _seeds(threshold: int, anchor: int):
    """(anchor, id, tag, state): the selected anchors of each document, each once."""
    schema = pa.schema([("anchor", pa.int64()), ("id", pa.int64()), ("tag", pa.binary()), ("state", pa.int64())])

    def settled(anchors: list[np.ndarray], ids: list[int], tags: list[bytes]) -> pa.RecordBatch:
        a = np.concatenate(anchors).view(np.int64)
        of = np.repeat(np.arange(len(ids)), [len(x) for x in anchors])
        i = np.array(ids, np.int64)[of]
        order = np.lexsort((i, a))
        a, i, of = a[order], i[order], of[order]
        begins = runs_of(a)
        lengths = np.diff(np.append(begins, len(a)))
        later = i > np.repeat(i[begins], lengths)
        state = np.where(later, LATER, np.repeat(np.where(np.logical_or.reduceat(later, begins), LEAST, ALONE), lengths))
        return _batch(schema, a, i, pa.array(tags, pa.binary()).take(pa.array(of)), state)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        out, ids, tags, size = [], [], [], 0
        for batch in batches:
            for id_, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = text.as_py().split()
                if len(words) < threshold:
                    continue
                runs, at = selected(hashes.of(words), threshold, anchor)
                own = np.unique(runs[np.unique(at)])
                out.append(own)
                ids.append(id_)
                tags.append(tag)
                size += len(own)
                if size > BLOCK_ROWS:
                    yield settled(out, ids, tags)
                    out, ids, tags, size = [], [], [], 0
        if out:
            yield settled(out, ids, tags)

    return made


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (anchor, id, tag, state) sorted by anchor and id, those whose anchor has more than one id.

    Where rows share the smallest id, all but the first are told without waiting for a larger id: that costs a needless extension.
    """
    names = ["id", "tag", "anchor"]

    def told_of(i, tag, a) -> pa.RecordBatch:
        return pa.record_batch([pa.array(i, pa.int64()), tag, pa.array(a, pa.int64())], names=names)

    anchor, first, first_tag, told = None, None, None, True
    for batch in batches:
        a, i, state = (batch.column(k).to_numpy() for k in (0, 1, 3))
        tag = batch.column(2)
        known = state == LATER
        if known.any():
            yield told_of(i[known], tag.filter(pa.array(known)), a[known])
            a, i, tag, state = a[~known], i[~known], tag.filter(pa.array(~known)), state[~known]
        if not len(a):
            continue
        begins = runs_of(a)
        least, least_at = i[begins].copy(), begins
        continued = anchor is not None and a[0] == anchor
        if continued:
            least[0] = first
        later = i > np.repeat(least, np.diff(np.append(begins, len(a))))
        more = np.logical_or.reduceat(later | (state == LEAST), begins)
        if continued and more[0] and not told:
            yield told_of([first], pa.array([first_tag], pa.binary()), [anchor])
        keep = np.ones(len(a), bool)
        keep[begins[1:] if continued else begins] = more[1:] if continued else more
        yield told_of(i[keep], tag.filter(pa.array(keep)), a[keep])
        told = bool(more[-1]) or (continued and len(begins) == 1 and told)
        if not (continued and len(begins) == 1):
            first_tag = tag[int(least_at[-1])].as_py()
        anchor, first = int(a[-1]), int(least[-1])


def _windows(threshold: int, anchor: int):
    """(w1, w2, id, tag, place) for each distinct window whose anchor is shared.

    place is the first start; it is negative if a smaller id in the block has the window too.
    """
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("id", pa.int64()), ("tag", pa.binary()), ("place", pa.int64())])

    def settled(rows: list[tuple], ids: list[int], tags: list[bytes]) -> pa.RecordBatch:
        of = np.repeat(np.arange(len(ids)), [len(r[0]) for r in rows])
        w1, w2, place = map(np.concatenate, zip(*rows, strict=True))
        i = np.array(ids, np.int64)[of]
        order = np.lexsort((i, w2, w1))
        w1, w2, i, place, of = w1[order], w2[order], i[order], place[order], of[order]
        begins = runs_of(w1, w2)
        later = i > np.repeat(i[begins], np.diff(np.append(begins, len(i))))
        return _batch(schema, w1, w2, i, pa.array(tags, pa.binary()).take(pa.array(of)), np.where(later, place | _SIGN, place))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        out, ids, tags, size = [], [], [], 0
        for batch in batches:
            plain = [batch.column(k).to_pylist() for k in (1, 2, 5)]
            for id_, tag, copy, text, seeds in zip(*plain, batch.column(3), batch.column(4), strict=True):
                words = text.as_py().split()
                if len(words) < threshold or copy:
                    continue
                x = hashes.of(words)
                runs, at = selected(x, threshold, anchor)
                shared = np.isin(runs, seeds.values.to_numpy().view(np.uint64))
                start = np.flatnonzero(shared[at])
                if not len(start):
                    continue
                w1 = run_hashes(x, threshold, 1)[start]
                w1, once = np.unique(w1, return_index=True)
                start = start[once]
                w2 = run_hashes(x, threshold, 2)[start]
                out.append((w1.view(np.int64), w2.view(np.int64), start.astype(np.int64)))
                ids.append(id_)
                tags.append(tag)
                size += len(start)
                if size > BLOCK_ROWS:
                    yield settled(out, ids, tags)
                    out, ids, tags, size = [], [], [], 0
        if out:
            yield settled(out, ids, tags)

    return made


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (w1, w2, id), those that are not at the smallest id of their window; a negative place is known not to be."""
    names = ["id", "tag", "place"]
    last, first = None, None
    for batch in batches:
        w1, w2, i, place = (batch.column(k).to_numpy() for k in (0, 1, 2, 4))
        tag = batch.column(3)
        known = place < 0
        if known.any():
            yield pa.record_batch([pa.array(i[known]), tag.filter(pa.array(known)), pa.array(place[known] & ~_SIGN)], names=names)
            w1, w2, i, place = (c[~known] for c in (w1, w2, i, place))
            tag = tag.filter(pa.array(~known))
        if not len(i):
            continue
        begins = runs_of(w1, w2)
        least = i[begins].copy()
        if last == (int(w1[0]), int(w2[0])):
            least[0] = first
        later = i > np.repeat(least, np.diff(np.append(begins, len(i))))
        yield pa.record_batch([pa.array(i[later]), tag.filter(pa.array(later)), pa.array(place[later])], names=names)
        last, first = (int(w1[-1]), int(w2[-1])), int(least[-1])


def _cut(threshold: int, keep_text: bool):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(span)),
        *([("kept_text", pa.string())] if keep_text else []),
    ])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            rows = [[] for _ in schema]
            for doc_id, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = text.as_py().split()
                n, spans = len(words), []
                kept = words
                start = places.values.to_numpy() if places.is_valid else np.empty(0, np.int64)
                if (start == COPY).any():
                    if n >= threshold:
                        kept, spans = [], [{"start": 0, "end": n}]
                elif len(start):
                    # The same window may start again further on.
                    w = run_hashes(hashes.of(words), threshold, 1)
                    start = np.flatnonzero(np.isin(w, w[start]))
                    edges = np.zeros(n + 1, np.int64)
                    np.add.at(edges, start, 1)
                    np.add.at(edges, start + threshold, -1)
                    gone = np.cumsum(edges[:n]) > 0
                    kept = [words[k] for k in np.flatnonzero(~gone).tolist()]
                    turns = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                    spans = [{"start": a, "end": b} for a, b in turns.reshape(-1, 2).tolist()]
                joined = b" ".join(kept)
                row = [doc_id, n, n - len(kept), hashlib.sha256(joined).hexdigest(), spans, *([joined.decode("utf-8", "replace")] if keep_text else [])]
                for column, value in zip(rows, row, strict=True):
                    column.append(value)
            yield _batch(schema, *rows)

    return made


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, anchor: int = ANCHOR, keep_text: bool = True
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans[, kept_text]) for each row; spans are the removed word ranges.

    Two documents are compared only through their anchors: no pairs are made,
    and what is shuffled beside the texts is narrow.
    """
    texts = narrowed(docs, id_col, text_col).select(
        "doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("text").cast("binary").alias("text")
    )
    # Ids of one row need no tag; where repeated ids are too many to list, all have one.
    shared_ids = pinned(texts.groupBy(F.col("id").alias("__shared")).count().filter("count > 1").select("__shared"))
    # Never null, and known not to be: else the two joins would filter the texts differently and shuffle them twice.
    tag = F.coalesce(content_hash(F.col("text")), F.lit(b""))
    if shared_ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(shared_ids), F.col("id") == F.col("__shared"), "left")
        tag = F.when(F.col("__shared").isNotNull(), tag).otherwise(F.lit(b""))
    texts = texts.select("doc_id", "id", tag.alias("tag"), "text")
    # Narrow rows: which (id, tag) have their text in a document of a smaller id.
    rows = texts.select("id", "tag", content_hash(F.col("text")).alias("h")).distinct()
    firsts = rows.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    copies = rows.join(firsts.select(F.col("h").alias("__h"), "first"), (F.col("h") == F.col("__h")) & (F.col("id") > F.col("first"))).select("id", "tag")

    anchors = texts.select("id", "tag", "text").mapInArrow(_seeds(threshold, anchor), "anchor bigint, id bigint, tag binary, state bigint")
    dealt = F.when(F.col("state") == LATER, F.xxhash64("anchor", "id")).otherwise(F.col("anchor"))
    shared = anchors.repartition(dealt).sortWithinPartitions("anchor", "id").mapInArrow(_shared, "id bigint, tag binary, anchor bigint")
    nothing = F.lit(None).cast("bigint").alias("anchor")
    known = shared.withColumn("copy", F.lit(False)).unionByName(copies.select("id", "tag", nothing, F.lit(True).alias("copy")))
    # Sets: rows with one id and text tell the same.
    seeds = known.groupBy(F.col("id").alias("__id"), F.col("tag").alias("__tag")).agg(F.collect_set("anchor").alias("seeds"), F.max("copy").alias("copy"))
    same_text = (F.col("id") == F.col("__id")) & (F.col("tag") == F.col("__tag"))
    # Both joins read the texts with the same columns, so they are shuffled once.
    seeded = texts.join(seeds, same_text).select("doc_id", "id", "tag", "text", "seeds", "copy")
    windows = seeded.mapInArrow(_windows(threshold, anchor), "w1 bigint, w2 bigint, id bigint, tag binary, place bigint")
    dealt = F.when(F.col("place") < 0, F.xxhash64("w1", "id", "place")).otherwise(F.col("w1"))
    repeated = windows.repartition(dealt).sortWithinPartitions("w1", "w2", "id").mapInArrow(_repeated, "id bigint, tag binary, place bigint")
    repeated = repeated.unionByName(copies.select("id", "tag", F.lit(COPY).cast("bigint").alias("place")))
    places = repeated.groupBy(F.col("id").alias("__id"), F.col("tag").alias("__tag")).agg(F.collect_set("place").alias("places"))
    ddl = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
    return (
        texts.join(places, same_text, "left").select("doc_id", "text", "places")
        .mapInArrow(_cut(threshold, keep_text), ddl + ", kept_text string" * keep_text)
    )
