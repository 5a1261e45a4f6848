"""Periodic runs of words: common extensions from suffix trees, candidates from Lyndon roots.

A run is a stretch of words with smallest period q, at least ``min_length``
words and ``min_exponent`` periods long, that neither neighbour extends.

Roots. Every run contains the longest Lyndon word that starts at one of its
words, in the order of the symbols or in the opposite one; it is as long as the
period. A suffix tree built by Ukkonen's algorithm, walked in symbol order, puts
the suffixes in order, and the longest Lyndon word at a place ends where the
next smaller (in the opposite order: the next larger) suffix begins.
Extension. The walk is the Euler tour of the tree, kept at its leaves: the depth
of the deepest node between neighbouring leaves. A table of minima over it
answers in constant time how far two places agree, to the right with the tree
of the words and to the left with that of their reversal.

Only stretches that can hold a run get a tree. In a run, each window of
``min_length * (1 - 1 / min_exponent)`` words occurs again after at most one
period, which is no more than the part ``1 / min_exponent`` of the stretch that
such windows cover, and these windows cover the whole run. So windows are hashed
for whole texts, and what they cover goes to the trees; a chance hit costs a
needless tree. Inside a stretch symbols stand for words exactly.

No shuffle; memory is that of one document's longest stretch, some 500 bytes a word.

Defined results
* A null text has no words; it and texts without a run have n_runs 0, nulls for the strongest run, and keep all words.
* Runs may overlap; a word goes if any run contains it after that run's first period.
* Null and repeated ids are answered row by row. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidepanel.llm.common import narrowed
from tidepanel.llm.substring_dedup import WordHash, mixed

MIN_LENGTH = 24
MIN_EXPONENT = 3


def suffix_tree(symbols: list[int], sigma: int) -> tuple[list[int], list[int], dict[int, int]]:
    """Ukkonen's tree of ``symbols`` (each below ``sigma``; the last occurs once): edge starts and ends by node, children by node * sigma + symbol."""
    n = len(symbols)
    start, end, link, child = [0], [0], [0], {}
    node = edge = length = rest = 0
    for i, symbol in enumerate(symbols):
        rest += 1
        unlinked = 0
        while rest:
            if not length:
                edge = i
            key = node * sigma + symbols[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if unlinked:
                    link[unlinked] = node
                unlinked = node
            else:
                first = start[below]
                span = end[below] - first
                if length >= span:
                    edge += span
                    length -= span
                    node = below
                    continue
                if symbols[first + length] == symbol:
                    length += 1
                    if unlinked:
                        link[unlinked] = node
                    break
                split = len(start)
                start += [first, i]
                end += [first + length, n]
                link += [0, 0]
                child[key] = split
                child[split * sigma + symbol] = split + 1
                start[below] = first + length
                child[split * sigma + symbols[first + length]] = below
                if unlinked:
                    link[unlinked] = split
                unlinked = split
            rest -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - rest + 1
    return start, end, child


def leaf_tour(symbols: list[int], sigma: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in symbol order, depth of the node where each parts from the one before)."""
    start, end, child = suffix_tree(symbols, sigma)
    n, nodes = len(symbols), len(start)
    keys = np.fromiter(child.keys(), np.int64, len(child))
    by_key = np.argsort(keys)
    below = np.fromiter(child.values(), np.int64, len(child))[by_key].tolist()
    first = np.searchsorted(keys[by_key] // sigma, np.arange(nodes + 1)).tolist()
    del child
    order, parted = [], []
    tour = [(0, 0, 0)]
    while tour:
        node, depth, parts = tour.pop()
        depth += end[node] - start[node]
        a, b = first[node], first[node + 1]
        if a == b:
            order.append(n - depth)
            parted.append(parts)
            continue
        for k in range(b - 1, a, -1):
            tour.append((below[k], depth, depth))
        tour.append((below[a], depth, parts))
    return np.array(order, np.int64), np.array(parted, np.int32)


class Extensions:
    """How far the words at two places agree to the right, in constant time."""

    def __init__(self, symbols: list[int], sigma: int):
        order, parted = leaf_tour([*symbols, 0], sigma)
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.minima = [parted]
        width = 1
        while 2 * width <= len(parted):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For arrays of different places; the end of the words counts as a place."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << k)])
        return out


def lyndon_ends(rank: list[int]) -> tuple[list[int], list[int]]:
    """Where the longest Lyndon word from each place ends, in symbol order and (-1 if at no place) in the opposite one."""
    n = len(rank)
    smaller, larger = [n] * n, [-1] * n
    up, down = [], []
    for i, r in enumerate(rank):
        while up and rank[up[-1]] > r:
            smaller[up.pop()] = i
        up.append(i)
        while down and rank[down[-1]] < r:
            larger[down.pop()] = i
        down.append(i)
    return smaller, larger


def runs_in(symbols: list[int], sigma: int, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``symbols``, each from 1 to ``sigma`` - 1, by start and period."""
    n = len(symbols)
    right = Extensions(symbols, sigma)
    smaller, larger = lyndon_ends(right.rank.tolist())
    i = np.tile(np.arange(n), 2)
    period = np.concatenate((smaller[:n], larger[:n])) - i
    near = (period > 0) & (period * min_exponent <= n)
    i, period = i[near], period[near]
    ahead = right(i, i + period)
    # Some root starts in the first period of its run, so less than a period is to its left.
    least = np.maximum(min_length, min_exponent * period)
    able = ahead + 2 * period > least
    i, period, ahead, least = i[able], period[able], ahead[able], least[able]
    if not len(i):
        return []
    del right
    left = Extensions(symbols[::-1], sigma)
    behind = np.zeros(len(i), np.int64)
    inner = i > 0
    behind[inner] = left(n - i[inner], n - i[inner] - period[inner])
    length = behind + period + ahead
    found = length >= least
    return sorted(set(zip((i - behind)[found].tolist(), length[found].tolist(), period[found].tolist())), key=lambda r: (r[0], r[2]))


def window_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` values, by doubling."""
    h, width = mixed(x), 1
    while 2 * width <= size:
        h = mixed(h[:-width] * np.uint64(0x9E3779B97F4A7C15) + h[width:])
        width *= 2
    if width < size:
        shift = size - width
        h = mixed(h[:-shift] * np.uint64(0x9E3779B97F4A7C15) + h[shift:])
    return h


def stretches(x: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int]]:
    """Word ranges that hold all runs of a document with word hashes ``x``."""
    size = -(-min_length * (min_exponent - 1) // min_exponent)
    if len(x) < min_length:
        return []
    h = window_hashes(x, size)
    order = np.argsort(h, kind="stable")
    again = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    at, distance = order[again], order[again + 1] - order[again]
    limit = np.full(len(at), len(x))
    while True:
        near = distance * min_exponent <= limit
        fewer = not near.all()
        at, distance = at[near], distance[near]
        if not len(at):
            return []
        edges = np.zeros(len(x) + 1, np.int64)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + distance + size, -1)
        covered = np.concatenate(([0], (np.cumsum(edges[:-1]) > 0).view(np.int8), [0]))
        turns = np.flatnonzero(np.diff(covered)).reshape(-1, 2)
        lengths = turns[:, 1] - turns[:, 0]
        limit = lengths[np.searchsorted(turns[:, 0], at, "right") - 1]
        if not fewer and (distance * min_exponent <= limit).all():
            return [(a, b) for a, b in turns.tolist() if b - a >= min_length]


def runs_of_words(words: list[bytes], hashes: WordHash, min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    found = []
    for a, b in stretches(hashes.of(words), min_length, min_exponent) if len(words) >= min_length else ():
        codes: dict[bytes, int] = {}
        symbols = [codes.setdefault(w, len(codes) + 1) for w in words[a:b]]
        found += [(a + s, length, q) for s, length, q in runs_in(symbols, len(codes) + 1, min_length, min_exponent)]
    return found


def collapse_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, keep_text: bool = True
) -> DataFrame:
    """One row per document: doc_id, n_runs, the run of the largest exponent (start, length, period, exponent_milli),
    all runs, runs_sha256, collapsed_sha256 and, if asked for, the words that stay as collapsed_text.
    """
    if min_exponent < 2:
        raise ValueError("a run has at least two periods")
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
        ("exponent_milli", pa.int64()), ("runs", pa.list_(run)), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
        *([("collapsed_text", pa.string())] if keep_text else []),
    ])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            rows = [[] for _ in schema]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # The white space of bytes is that of the words' definition.
                words = text.as_py().encode().split()
                runs = runs_of_words(words, hashes, min_length, min_exponent)
                best, kept = (None, None, None, None), words
                if runs:
                    s, length, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
                    best = (s, length, q, 1000 * length // q)
                    gone = np.zeros(len(words), bool)
                    for s, length, q in runs:
                        gone[s + q : s + length] = True
                    kept = [words[k] for k in np.flatnonzero(~gone).tolist()]
                listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
                joined = b" ".join(kept)
                row = [
                    doc_id, len(runs), *best, [dict(zip(("start", "length", "period"), r)) for r in runs],
                    hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(joined).hexdigest(), *([joined.decode()] if keep_text else []),
                ]
                for column, value in zip(rows, row, strict=True):
                    column.append(value)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    ddl = (
        "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint,"
        " runs array<struct<start:bigint,length:bigint,period:bigint>>, runs_sha256 string, collapsed_sha256 string"
    )
    return narrowed(docs, id_col, text_col).mapInArrow(found, ddl + ", collapsed_text string" * keep_text)
