"""SimHash near-duplicates, found by anchor-point covering.

Fingerprints are 64 bits over word shingles. Two that differ in at most 3 bits
differ in at most 1 bit in one of their halves. Each half of 32 bits is covered
by a perfect code: the Hamming code of length 31 (every point lies within 1 bit
of exactly one code word) with the last bit kept as it is. The code words are
the anchors. A fingerprint is at home at the anchor within the covering radius
(1) and is sent to every anchor within radius plus the half's threshold (2). So
both partners of a link meet at the home of either, where they are compared.

Defined results
* A null text counts as empty. A text with fewer words than a shingle is one shingle; without words the
  fingerprint is zero and links like any other.
* Links join equal fingerprints, and those within the threshold; ``component_id`` is the smallest doc_id that can
  be reached (null ids are passed over; null if a component has no other).
* Rows that repeat an id are fingerprinted row by row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import narrowed, small_side, without
from tidepanel.llm.components import components
from tidepanel.llm.exact_dedup import content_hash
from tidepanel.session import pinned

SHINGLE = 3
MAX_BITS = 3
# Members of one anchor that are compared as one unit; larger anchors are dealt over several.
UNIT = 2048


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash with XXH64 (seed 42): a bit is set if it is set in over half of the shingles' hashes."""
    import xxhash

    words = text.lower().split()  # on bytes: A-Z only, and exactly the six ASCII white-space characters
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, n)
    hashed, view = xxhash.xxh64_intdigest, memoryview(joined)
    counts = np.zeros(64, np.int64)
    # In blocks, so that a very long text takes a bounded amount of memory.
    for at in range(0, n - k + 1, 1 << 16):
        block = slice(at, min(at + (1 << 16), n - k + 1))
        h = [hashed(view[a:b], 42) for a, b in zip(starts[block].tolist(), ends[k - 1 :][block].tolist(), strict=True)]
        bits = np.unpackbits(np.array(h, dtype="<u8").view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > n - k + 1).tolist())


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, h, fp): the text's hash and the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.binary()), ("fp", pa.int64())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], schema=schema)

    texts = narrowed(docs, id_col, text_col).select("doc_id", content_hash(F.col("text")).alias("h"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(made, "doc_id bigint, h binary, fp bigint")


# Position p of the code (1 to 31) is bit p - 1; a parity check collects the positions with one bit set.
_CHECKS = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]


def syndromes(x: np.ndarray) -> np.ndarray:
    """For the low 31 bits of each number: 0 for a code word, else the position (1 to 31) that spoils it."""
    s = np.zeros(len(x), np.uint64)
    for j, mask in enumerate(_CHECKS):
        s |= (np.bitwise_count(x & np.uint64(mask)).astype(np.uint64) & np.uint64(1)) << np.uint64(j)
    return s


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor, is it the home) for all anchors within 2 bits of each 32-bit ``half``."""
    n = len(half)
    s, index, one = syndromes(half), np.arange(n), np.uint64(1)
    flip = lambda p: np.where(p > 0, one << (np.maximum(p, one) - one), np.uint64(0))
    home = half ^ flip(s)
    top = one << np.uint64(31)
    parts = [(index, home, np.ones(n, bool)), (index, home ^ top, np.zeros(n, bool))]
    off = np.flatnonzero(s)
    for i in range(1, 32):
        p = np.uint64(i)
        q = s[off] ^ p
        pick = q > p  # each pair of positions once; q = 0 is the home itself
        at = off[pick]
        parts.append((at, half[at] ^ flip(np.full(len(at), p)) ^ flip(q[pick]), np.zeros(len(at), bool)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
        for at in range(0, len(fp), 50_000):
            x = fp[at : at + 50_000]
            for side in (0, 1):
                half = x >> np.uint64(32) if side else x & np.uint64(0xFFFFFFFF)
                index, anchor, home = anchors(half)
                cell = anchor | np.uint64(side << 32)
                yield pa.record_batch([pa.array(cell.view(np.int64)), pa.array(x[index].view(np.int64)), pa.array(home)], names=["cell", "fp", "home"])


def forest(homes: np.ndarray, members: Iterator[np.ndarray], max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that tie together all that is within ``max_bits``: at most one for each home and each member.

    A member is tied to the first home it is close to; homes that share a member are tied to each other once.
    """
    root = np.arange(len(homes))
    for y in members:
        for at in range(0, len(y), 1024):
            part = y[at : at + 1024]
            close = np.bitwise_count(part[:, None] ^ homes[None, :]) <= max_bits
            rows = np.flatnonzero(close.any(axis=1))
            first = close[rows].argmax(axis=1)
            differ = part[rows] != homes[first]
            yield part[rows][differ], homes[first][differ]
            new = []
            for r, f in zip(rows.tolist(), first.tolist(), strict=True):
                near = np.flatnonzero(close[r])
                if len(near) > 1:
                    here = root[near]
                    apart = np.unique(here[here != root[f]])
                    if len(apart):
                        new.extend((int(a), int(root[f])) for a in apart)
                        root[np.isin(root, apart)] = root[f]
            if new:
                a, b = np.array(new).T
                yield homes[a], homes[b]


def _compare(max_bits: int):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (cell, salt, homes first); a unit's homes are kept, its members stream by."""
        homes, unit, tied = np.empty(0, np.uint64), None, []

        def found(pairs):
            for a, b in pairs:
                if len(a):
                    yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            cell, salt, home, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            fp = fp.astype(np.int64).view(np.uint64)
            if not len(fp):
                continue
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(salt) != 0)) + 1
            begins, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fp)]))
            # Units that lie within the batch and have no home or a single member cannot hold a link.
            has_home = np.add.reduceat(home.astype(np.int64), begins) > 0
            worth = has_home & (ends - begins > 1)
            worth[[0, -1]] = True
            for b, e in zip(begins[worth].tolist(), ends[worth].tolist(), strict=True):
                key = (int(cell[b]), int(salt[b]))
                if key != unit:
                    unit, homes = key, np.empty(0, np.uint64)
                own = fp[b:e][home[b:e]]
                if len(own):
                    # Homes that arrive late (a unit over several batches) have not met the earlier ones.
                    tied = found(forest(own, iter([homes, own]), max_bits))
                    yield from tied
                    homes = np.concatenate((homes, own))
                rest = fp[b:e][~home[b:e]]
                if len(rest) and len(homes):
                    yield from found(forest(homes, iter([rest]), max_bits))

    return compared


def near_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) links that connect whatever distinct fingerprints (fp) are connected; not all pairs."""
    if max_bits > 3:
        raise ValueError("the covering of halves holds for at most 3 differing bits")
    cells = prints.mapInArrow(_spread, "cell bigint, fp bigint, home boolean")
    # Large anchors are rare: their homes are dealt over units and the others go to each unit.
    large = pinned(cells.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > UNIT).select(
        F.col("cell").alias("__cell"), F.ceil(F.col("n") / UNIT).cast("int").alias("units")))
    if large.isEmpty():
        dealt = cells.withColumn("salt", F.lit(0))
    else:
        sized = cells.join(small_side(large), F.col("cell") == F.col("__cell"), "left").withColumn("units", F.coalesce("units", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("units").cast("bigint")).cast("int")
        everywhere = F.sequence(F.lit(0), F.col("units") - 1)
        dealt = sized.select("cell", "fp", "home", own.alias("own"), F.explode(everywhere).alias("salt")).withColumn(
            "home", F.col("home") & (F.col("own") == F.col("salt"))
        )
    ordered = dealt.select("cell", "salt", "home", "fp").repartition("cell", "salt").sortWithinPartitions("cell", "salt", F.desc("home"))
    return ordered.mapInArrow(_compare(max_bits), "a bigint, b bigint")


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> DataFrame:
    rows = pinned(fingerprints(docs, id_col, text_col, shingle))
    prints = pinned(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = pinned(components(near_links(prints.select("fp"), max_bits)))
    rooted = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "__root")
    named = rooted.join(names, F.col("root") == F.col("__root")).select(F.col("fp").alias("__fp"), "component_id")
    return rows.join(named, F.col("fp") == F.col("__fp")).select("doc_id", "h", "fp", "component_id")


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return _classes(docs, id_col, text_col, shingle, max_bits).select("doc_id", hexed, "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without the documents that a smaller id of their component stands for.

    Rows of one id in one component are one document and stay together; rows
    without an id stay only where their component has no id at all.
    """
    classes = _classes(docs, id_col, text_col, shingle, max_bits)
    gone = classes.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "h").distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return without(docs, [F.col(id_col).cast("bigint"), content_hash(text)], gone)
