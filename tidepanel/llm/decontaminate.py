"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts are sequences of lower-case words; each character of a script without spaces is a word. The CGK walk maps a sequence to a
longer one: step j writes the current word and moves on if a random bit of
(j, word) is set. Sequences at a small edit distance walk alike for most steps,
so edit distance becomes Hamming distance, and sampled steps serve as LSH keys.
Keys are taken from windows of the items' sizes (items are grouped into sizes
that differ by a tenth) at each start that the bound below allows. Items of more
than ``SEGMENT_WORDS`` words are cut into segments of equal length, each with keys
of its own: of m segments at least one has at most an m-th of the allowed edits,
wherever in the item they lie. Repetitions are added until pairs at the largest
allowed distance meet with the target recall and a margin: with words replaced, added or
dropped here and there, each alone and mixed, and with one passage edited; if they
never do, it is an error.
Each document and item that meet are verified by the exact edit distance between
the item and the best matching part of the text.

Items of fewer than ``MIN_WORDS`` words may differ by one word at most. They are found
without a miss by hashes: of the whole window, and of windows and items without one
of their words.

Bounds. A part within k edits of an item of n words shares at least n - 1 - 2k
word pairs with it, n - 2 - 3k runs of three and n - 3 - 4k of four words. Starts
whose surroundings hold fewer runs known from any item cannot match and are not
embedded. This loses nothing. Pairs settle most with a small benchmark, runs of
four words with a large one, whose items together know most of a language's pairs.

The benchmark is worked through in blocks of at most ``BLOCK_WORDS`` words, so
what is sent to the executors has a bounded size whatever the benchmark's. Each
block reads the documents once. The walk's random bits are those of a word's
class, of which there are ``CLASSES``: two words of one class walk alike, but
their keys and the verification still tell them apart.

Defined results
* A match is an edit distance of at most ``1 - similarity`` of the item's words (0.2, rounded down).
* Null or empty texts and items, and those without a word, match nothing. An item of one word matches each text with that word.
* Rows that repeat an id are searched row by row, and the best match of (doc_id, item_id) is reported once.
* Items with equal texts are each reported. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import narrowed, without
from tidepanel.llm.exact_dedup import content_hash
from tidepanel.llm.substring_dedup import mixed

SIMILARITY = 0.8
RECALL = 0.95
MIN_WORDS = 8
BLOCK_WORDS = 200_000
# Size of the table of random bits: 16 MB at most. Later steps use the bits of earlier ones again.
CLASSES, STEPS = 1024, 2048
PAIR_SLOTS = 1 << 22
# Lengths of the runs that are counted.
RUNS = (2, 3, 4)
SAMPLED = 3
MAX_REPEATS = 64
# Longer items are cut: the further a walk goes, the more edits it has to get over.
SEGMENT_WORDS = 25
# Words that are embedded at once; bounds the memory of a task.
CHUNK_WORDS = 500_000
STARTS_AT_ONCE = 8_000
# Han, kana, Thai, Lao, Burmese and Khmer are written without spaces.
_UNSPACED = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_WORD = re.compile(r"\w+")
_WORD_OR_CHARACTER = re.compile(rf"[^\W{_UNSPACED}]+|(?=\w)[{_UNSPACED}]")
UNKNOWN, PAD = 0, 1


def words_of(text: str) -> list[str]:
    return (_WORD if text.isascii() else _WORD_OR_CHARACTER).findall(text.lower())


def allowed(n: int, similarity: float = SIMILARITY) -> int:
    """Edits allowed for an item of ``n`` words."""
    return int(n * (1 - similarity) + 1e-9)


def sizes(lengths: list[int]) -> list[int]:
    """Window sizes such that each length has one within a tenth below it."""
    out: list[int] = []
    for n in sorted(set(lengths)):
        if not out or n > out[-1] * 1.1:
            out.append(n)
    return out


def segments(n: int) -> list[tuple[int, int]]:
    """(offset, length) of the segments of an item of ``n`` words; fewer words than there are segments stay over at its end."""
    m = max(1, -(-n // SEGMENT_WORDS))
    return [(j * (n // m), n // m) for j in range(m)]


class Walk:
    """The random bits of the CGK walk and the sampled steps, for each repetition."""

    def __init__(self, longest: int, repeats: int, seed: int = 7):
        if repeats > 64:
            raise ValueError("the bits of a step and symbol are kept in one 64-bit number")
        rng = np.random.default_rng(seed)
        self.repeats = repeats
        # Bit r of a number is the bit of repetition r.
        self.moves = rng.integers(0, 1 << 64, (min(2 * longest, STEPS), CLASSES), dtype=np.uint64)
        self.sampled = np.sort(rng.random((repeats, SAMPLED)), axis=1)

    def keys(self, x: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """A key for each start and repetition; ``x`` must be padded by ``size`` at its end."""
        reach = 2 * size
        # Twice the size: a walk of two steps a word reaches the window's end on average.
        wanted = np.minimum((self.sampled * reach).astype(np.int64), reach - 1)
        # A row for each repetition, the longest walks first: those that are done fall off at the end.
        order = np.argsort(-wanted[:, -1], kind="stable")
        wanted, rep = wanted[order], order.astype(np.uint64)[:, None]
        at, end = np.tile(starts.astype(np.int64), (self.repeats, 1)), starts + size
        key = np.zeros(at.shape, np.uint64)
        for j in range(int(wanted[0, -1]) + 1):
            active = int((wanted[:, -1] >= j).sum())
            here = at[:active]
            now = x.take(here, mode="clip")
            np.copyto(now, PAD, where=here >= end)
            for row in np.repeat(np.arange(active), (wanted[:active] == j).sum(axis=1)):
                key[row] = key[row] * np.uint64(0x9E3779B97F4A7C15) + now[row].astype(np.uint64) + np.uint64(1)
            bits = self.moves[j % len(self.moves)].take(now & (CLASSES - 1))
            here += (bits >> rep[:active] & np.uint64(1)).view(np.int64)
        key ^= key >> np.uint64(29)
        out = np.empty((len(starts), self.repeats), np.uint64)
        out[:, order] = (key * np.uint64(0xBF58476D1CE4E5B9) + rep).T
        return out


KINDS = ("replaced", "added", "dropped")
PLACES = ("spread", *KINDS, "head", "middle", "tail")


def edited(rng: np.random.Generator, a: np.ndarray, edits: int, place: str, vocabulary: int) -> list[int]:
    """``a`` after so many edits: of random kinds or of one kind at random places, or one passage replaced, dropped or grown."""
    b, word = a.tolist(), lambda: int(rng.integers(2, vocabulary))
    if place == "spread" or place in KINDS:
        for _ in range(edits):
            kind, p = rng.integers(3) if place == "spread" else KINDS.index(place), int(rng.integers(len(b)))
            if kind == 0:
                b[p] = word()
            elif kind == 1:
                b.insert(p, word())
            elif len(b) > 1:
                del b[p]
        return b
    kind, at = rng.integers(3), {"head": 0, "middle": (len(b) - edits) // 2, "tail": len(b) - edits}[place]
    b[at : at + edits * (kind < 2)] = [word() for _ in range(edits * (kind != 1))]
    return b


def repeats_for(recall: float, similarity: float, length: int, trials: int = 400, vocabulary: int = 500) -> int:
    """Repetitions after which random pairs at the largest allowed distance meet with the given recall.

    The share that met must exceed it by two standard errors, as it is an estimate; it must for each of ``PLACES``.
    """
    rng = np.random.default_rng(11)
    walk = Walk(length, MAX_REPEATS)
    edits, most = allowed(length, similarity), 0
    # Enough trials that a share beyond the margin exists.
    trials = max(trials, int(20 / (1 - recall)))
    before, width = edits, 4 * length
    # The starts around the true one are embedded as well, as they are in documents.
    near = np.arange(2 * edits + 1)
    for place in PLACES:
        met = []
        for at in range(0, trials, 100):
            left, right = [], []
            for _ in range(min(100, trials - at)):
                a = rng.integers(2, vocabulary, length)
                b = edited(rng, a, edits, place, vocabulary)
                left += [*a, *[PAD] * length]
                right += [*[UNKNOWN] * before, *b, *[PAD] * (width - before - len(b))]
            n = len(left) // (2 * length)
            ka = walk.keys(np.array(left), np.arange(n) * 2 * length, length)[:, None, :]
            begins = (np.arange(n)[:, None] * width + near).reshape(-1)
            kb = walk.keys(np.array(right), begins, length).reshape(n, len(near), -1)
            met.append((ka == kb).any(axis=1))
        found = np.logical_or.accumulate(np.concatenate(met), axis=1).mean(axis=0)
        enough = np.flatnonzero(found >= recall + 2 * (recall * (1 - recall) / trials) ** 0.5)
        if not len(enough):
            raise ValueError(f"{MAX_REPEATS} repetitions find {found[-1]:.3f} of pairs of {length} words, less than a recall of {recall} and its margin")
        most = max(most, int(enough[0]) + 1)
    return most


def window_hashes(x: np.ndarray, n: int, without: int = -1) -> np.ndarray:
    """A hash of each window of ``n`` words, or of what is left without its word number ``without``."""
    w = max(len(x) - n + 1, 0)
    y, h = mixed(x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), np.zeros(w, np.uint64)
    for j in range(n):
        if j != without:
            h = h * np.uint64(0x165667B19E3779F9) + y[j : j + w]
    return mixed(h)


def is_short(n: int, similarity: float) -> bool:
    return n < MIN_WORDS and allowed(n, similarity) <= 1


def hits(keys: np.ndarray, owners: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``wanted``, owner) for each equal key in the sorted ``keys``; a row may have several values."""
    low = np.searchsorted(keys, wanted, "left")
    count = np.searchsorted(keys, wanted, "right") - low
    at = np.nonzero(count)
    n, low = count[at], low[at]
    slots = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(at[0], n), owners[slots]


class Index:
    """A block of benchmark items: vocabulary, known pairs, LSH keys and bit masks for verification."""

    def __init__(self, items: list[tuple[object, list[str]]], similarity: float, repeats: int):
        self.ids = [i for i, _ in items]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in items for w in ws}), 2)}
        self.items = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in items]
        self.similarity = similarity
        # (item, offset, length, edits that one of its item's segments has at most)
        cut = [
            (i, offset, length, allowed(len(x), similarity) // len(parts))
            for i, x in enumerate(self.items) if not is_short(len(x), similarity) for parts in [segments(len(x))] for offset, length in parts
        ]
        short = [i for i, x in enumerate(self.items) if is_short(len(x), similarity)]
        self.item_of, self.offset_of = np.array([c[0] for c in cut] + short), np.array([c[1] for c in cut] + [0] * len(short))
        # The fewest words of a text that holds an item.
        self.fewest = max(1, min(len(x) - allowed(len(x), similarity) for x in self.items))
        self.sizes = sizes([c[2] for c in cut])
        self.scale = len(self.vocabulary) + 2
        # A table of hashes instead of the pairs: what hits it by chance is embedded for nothing, but nothing is missed.
        self.known = {q: np.zeros(PAIR_SLOTS, bool) for q in RUNS}
        for q, table in self.known.items():
            for x in self.items:
                table[self.slots(x, q)] = True
        # Of short items, for each length: sorted hashes of the whole and, if an edit is allowed, of what is left without a word.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(self.items[i]) for i in short}):
            own = [c for c, i in enumerate(short, len(cut)) if len(self.items[i]) == n]
            left_out = [-1, *range(n)] if allowed(n, similarity) else [-1]
            keys = np.concatenate([window_hashes(self.items[self.item_of[c]], n, p) for c in own for p in left_out])
            order = np.argsort(keys, kind="stable")
            self.short[n] = keys[order], np.repeat(own, len(left_out))[order]
        self.walk = Walk(max((c[2] for c in cut), default=1), repeats)
        self.keys, self.owners, self.least, self.reach = {}, {}, {}, {}
        for k, size in enumerate(self.sizes):
            above = self.sizes[k + 1] if k + 1 < len(self.sizes) else 1 << 30
            own = [c for c, (_, _, length, _) in enumerate(cut) if size <= length < above]
            x = np.concatenate([y for c in own for y in (self.items[cut[c][0]][cut[c][1] : cut[c][1] + size], np.full(size, PAD))])
            keys = self.walk.keys(x, np.arange(len(own)) * 2 * size, size).reshape(-1)
            owners = np.repeat(own, repeats)
            order = np.argsort(keys, kind="stable")
            self.keys[size], self.owners[size] = keys[order], owners[order]
            shared = {q: min(cut[c][2] - (q - 1) - q * cut[c][3] for c in own) for q in RUNS}
            self.least[size] = {q: max(int(q == 2), n) for q, n in shared.items() if q == 2 or n > 0}
            self.reach[size] = max(cut[c][2] + cut[c][3] for c in own)
        self.masks: dict[int, dict[int, int]] = {}

    def slots(self, x: np.ndarray, q: int) -> np.ndarray:
        """The place of each run of ``q`` words in the table of known ones."""
        n = max(len(x) - q + 1, 0)
        codes = x[:n].astype(np.uint64)
        for j in range(1, q):
            codes = mixed(codes) * np.uint64(self.scale) + x[j : j + n].astype(np.uint64)
        return (mixed(codes) & np.uint64(PAIR_SLOTS - 1)).astype(np.int64)

    def symbols(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(UNKNOWN)), np.int64, len(words))

    def candidates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, segment) pairs whose keys meet; ``x`` holds documents with padding between them."""
        # Known runs before each place.
        before = {q: np.concatenate(([0], np.cumsum(table[self.slots(x, q)]))) for q, table in self.known.items()}

        def within(q: int, starts: np.ndarray, words: int) -> np.ndarray:
            """Known runs of ``q`` words among the ``words`` words from each start."""
            last = len(before[q]) - 1
            return before[q][np.minimum(starts + max(words - q + 1, 0), last)] - before[q][np.minimum(starts, last)]

        begins, found = [], []
        # A match may begin with words that no item has.
        everywhere = np.flatnonzero(x != PAD)
        for size in self.sizes:
            starts = everywhere
            for q in sorted(self.least[size], reverse=True):
                starts = starts[within(q, starts, self.reach[size]) >= self.least[size][q]]
            for at in range(0, len(starts), STARTS_AT_ONCE):
                part = starts[at : at + STARTS_AT_ONCE]
                keys = self.walk.keys(x, part, size)
                row, owners = hits(self.keys[size], self.owners[size], keys)
                begins.append(part[row])
                found.append(owners)
        for n, (keys, owners) in self.short.items():
            k = allowed(n, self.similarity)
            # (words of a window, the one that is left out): as the item, with a word replaced, dropped or added.
            probes = [(n, -1), *([(n, p) for p in range(n)] + [(n - 1, -1)] + [(n + 1, p) for p in range(1, n)] if k else [])]
            starts = everywhere[within(2, everywhere, n + k) >= n - 1 - 2 * k]
            for length, p in probes:
                part = starts[starts <= len(x) - length]
                row, own = hits(keys, owners, window_hashes(x, length, p)[part])
                begins.append(part[row])
                found.append(own)
        if not begins:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = np.unique(np.concatenate(begins) * len(self.item_of) + np.concatenate(found))
        return both // len(self.item_of), both % len(self.item_of)

    def mask(self, item: int) -> dict[int, int]:
        """Where each word of the item stands, as bits; made when an item is first verified."""
        if item not in self.masks:
            mask: dict[int, int] = {}
            for p, s in enumerate(self.items[item].tolist()):
                mask[s] = mask.get(s, 0) | 1 << p
            self.masks[item] = mask
        return self.masks[item]

    def distance(self, item: int, text: list[int]) -> tuple[int, int]:
        """(least edit distance between the item and any part of ``text``, end of the first such part)."""
        m = len(self.items[item])
        mask, high, full = self.mask(item), 1 << (m - 1), (1 << m) - 1
        up, down, score, best, end = full, 0, m, m, 0
        for j, symbol in enumerate(text, 1):
            eq = mask.get(symbol, 0)
            zero = (((eq & up) + up) ^ up) | eq | down
            plus = down | ~(zero | up) & full
            minus = up & zero
            if plus & high:
                score += 1
            elif minus & high:
                score -= 1
            plus, minus = plus << 1 & full, minus << 1 & full
            up = (minus | ~(zero | plus)) & full
            down = plus & zero
            if score < best:
                best, end = score, j
        return best, end


def _searched(index: Index):
    gap = max(MIN_WORDS, *index.reach.values()) + 1 if index.reach else MIN_WORDS + 1
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.binary()), ("item", pa.int64()), ("distance", pa.int64()), ("end_word", pa.int64())])

    def matches(ids: list, parts: list[np.ndarray]) -> Iterator[tuple]:
        if not parts:
            return
        pad = np.full(gap, PAD, np.int64)
        x = np.concatenate([y for p in parts for y in (p, pad)])
        offsets = np.cumsum([0, *(len(p) + gap for p in parts)])
        start, segment = index.candidates(x)
        doc = np.searchsorted(offsets, start, "right") - 1
        # Where the whole item begins if the segment's start is right and nothing before it was added or dropped.
        start, item = start - index.offset_of[segment], index.item_of[segment]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        covered: dict[tuple[int, int], int] = {}
        for s, i, d in sorted(zip(start.tolist(), item.tolist(), doc.tolist(), strict=True), key=lambda c: (c[2], c[1], c[0])):
            k = allowed(len(index.items[i]), index.similarity)
            n, low, high = len(index.items[i]), int(offsets[d]), int(offsets[d + 1]) - gap
            # A match begins within 2 k of s (k for the edits before the segment, k for the key's start) and has up to n + k words.
            # Stretches that were searched for the item already are not searched again.
            if min(high, s + n + 3 * k) <= covered.get((d, i), -1) or best.get((d, i), (k + 1,))[0] == 0:
                continue
            a, b = max(low, s - 2 * k), min(high, s + 2 * n + 3 * k)
            covered[d, i] = b
            distance, end = index.distance(i, x[a:b].tolist())
            if distance <= k and (distance, a + end - low) < best.get((d, i), (k + 1, 0)):
                best[d, i] = (distance, a + end - low)
        for (d, i), (distance, end) in best.items():
            doc_id, text = ids[d]
            # What ``content_hash`` makes of the text.
            yield doc_id, hashlib.md5(text.as_py().encode()).digest(), i, distance, end

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, size, rows = [], [], 0, []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                if len(words) < index.fewest:
                    continue
                ids.append((doc_id, text))
                parts.append(index.symbols(words))
                size += len(words)
                if size >= CHUNK_WORDS:
                    rows.extend(matches(ids, parts))
                    ids, parts, size = [], [], 0
            rows.extend(matches(ids, parts))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * 5, schema, strict=True)], schema=schema)

    return searched


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, list[str]]]]:
    """The benchmark's items, read a block at a time."""
    rows = benchmark.select(F.col(item_col).cast("bigint"), F.col(text_col).cast("string")).toLocalIterator()
    block, size = [], 0
    for item_id, text in rows:
        words = words_of(text or "")
        if not words:
            continue
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((item_id, words))
        size += len(words)
    if block:
        yield block


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, similarity: float, recall: float) -> DataFrame:
    """(doc_id, h, item_id, distance, similarity, end_word) for each row of ``docs`` and item it holds; h is the text's hash."""
    spark = docs.sparkSession
    texts = narrowed(docs, id_col, text_col)
    out = spark.createDataFrame([], "doc_id bigint, h binary, item_id bigint, distance bigint, similarity double, end_word bigint")
    for block in blocks(benchmark, item_col, item_text_col):
        lengths = sorted({segments(len(w))[0][1] for _, w in block if not is_short(len(w), similarity)})
        tried = {lengths[0], lengths[len(lengths) // 2], lengths[-1]} if lengths else set()
        # The shortest, the middle and the longest: spread edits are hardest in long windows, passages in shorter ones.
        index = Index(block, similarity, max((repeats_for(recall, similarity, n) for n in tried), default=1))
        found = texts.mapInArrow(_searched(index), "doc_id bigint, h binary, item bigint, distance bigint, end_word bigint")
        names = spark.createDataFrame([(k, i, len(w)) for k, (i, w) in enumerate(block)], "k bigint, item_id bigint, n int")
        # At most BLOCK_WORDS rows.
        named = found.join(F.broadcast(names), F.col("item") == F.col("k"))
        out = out.unionByName(named.select("doc_id", "h", "item_id", "distance", (1 - F.col("distance") / F.col("n")).alias("similarity"), "end_word"))
    return out


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    similarity: float = SIMILARITY, recall: float = RECALL,
) -> DataFrame:
    """(doc_id, item_id, distance, similarity, end_word) for each document that holds an item, and each such item."""
    out = _leaks(docs, benchmark, id_col, text_col, item_col, item_text_col, similarity, recall)
    best = out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "end_word", "similarity")).alias("m"))
    return best.select("doc_id", "item_id", "m.distance", "m.similarity", "m.end_word")


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    similarity: float = SIMILARITY, recall: float = RECALL,
) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item. Other rows of the same id, or without one, stay."""
    leaks = _leaks(docs, benchmark, id_col, text_col, item_col, item_text_col, similarity, recall).select("doc_id", "h").distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return without(docs, [F.col(id_col).cast("bigint"), content_hash(text)], leaks)
