"""Classification trees that split where an association test says so.

In each node every feature is tested for independence of the class (chi-square
on bins by classes). The smallest p value, corrected for the number of features
tested, decides the feature; if it is above ``alpha`` the node is a leaf. So a
tree stops by itself, and features with many values get no head start. The split
of the chosen feature is the one with the largest two-sided statistic.

One level is one job: counts by (node, feature, bin, class) are added up per task
and then over the tasks, and only these sums reach the driver. Rows without a
class are left out. A row without a value takes no part in that feature's test
and goes to the larger side of a split on it.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tidepanel.operators.boost import Binning, bins_matrix, learn_bins, mapped
from tidepanel.session import pinned

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def log_upper_chi_square(x: float, df: int) -> float:
    """Logarithm of the probability that a chi-square variable with ``df`` degrees of freedom exceeds ``x``; never underflows."""
    a, x = df / 2.0, x / 2.0
    if x <= 0:
        return 0.0
    front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= x / k
            total += term
        return math.log1p(-min(math.exp(front) * total, 1 - 1e-16))
    # The continued fraction, from its tail inwards until it no longer moves.
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front + math.log(h)


def chi_square(table: np.ndarray) -> tuple[float, int]:
    """(statistic, degrees of freedom) of a table of counts; empty rows and columns do not count."""
    table = table[table.sum(1) > 0][:, table.sum(0) > 0].astype(float)
    df = (table.shape[0] - 1) * (table.shape[1] - 1)
    if df <= 0:
        return 0.0, 0
    expected = table.sum(1, keepdims=True) * table.sum(0, keepdims=True)
    n = table.sum()
    return float(n * ((table * table / expected).sum() - 1)), df


@dataclass(frozen=True)
class Node:
    """What a node holds and, unless it is a leaf, how it is split: bins from ``threshold`` on go right."""

    counts: tuple[int, ...]
    feature: int | None = None
    threshold: int | None = None
    missing_right: bool = False
    statistic: float | None = None
    log_p: float | None = None


def node_of(bins: np.ndarray, nodes: dict[int, Node]) -> np.ndarray:
    """The node of each row; the children of node i are 2i + 1 and 2i + 2."""
    at = np.zeros(len(bins), np.int64)
    for i in sorted(i for i, node in nodes.items() if node.feature is not None):
        node, here = nodes[i], at == i
        own = bins[here, node.feature]
        right = np.where(own == 0, node.missing_right, own >= node.threshold)
        at[here] = 2 * i + 1 + right
    return at


def _counts(nodes: dict[int, Node], open_nodes: Sequence[int], width: int, n_bins: int, n_classes: int):
    place = {i: k for k, i in enumerate(open_nodes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(place), width, n_bins, n_classes), np.int64)
        for batch in batches:
            bins, label = bins_matrix(batch.column("bins"), width), batch.column("label").to_numpy()
            at = np.array([place.get(i, -1) for i in node_of(bins, nodes).tolist()], np.int64)
            inside = at >= 0
            at, bins, label = at[inside], bins[inside], label[inside]
            for f in range(width):
                cell = (at * n_bins + bins[:, f]) * n_classes + label
                total[:, f] += np.bincount(cell, minlength=len(place) * n_bins * n_classes).reshape(len(place), n_bins, n_classes)
        where = np.nonzero(total)
        columns = [np.array(open_nodes, np.int64)[where[0]], *where[1:], total[where]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "feature", "bin", "label", "n"])

    return run


@dataclass(frozen=True)
class AssociationTree:
    binning: Binning
    classes: tuple[str, ...]
    nodes: dict[int, Node]

    def table(self, spark: SparkSession) -> DataFrame:
        """(node, n, feature, threshold, statistic, log_p, and the most frequent class); nulls where a node is a leaf."""
        rows = [
            (i, sum(x.counts), None if x.feature is None else self.binning.features[x.feature], x.threshold, x.statistic, x.log_p, self.majority(i))
            for i, x in sorted(self.nodes.items())
        ]
        return spark.createDataFrame(rows, "node int, n bigint, feature string, threshold int, statistic double, log_p double, predicted string")

    def majority(self, node: int) -> str:
        counts = self.nodes[node].counts
        return self.classes[max(range(len(counts)), key=lambda k: (counts[k], -k))]

    def classify(self, df: DataFrame, *keep: str) -> DataFrame:
        """``keep``, the leaf of each row and its most frequent class (of equally frequent ones the first by name)."""
        nodes, width = self.nodes, len(self.binning.features)
        at = mapped(self.binning.apply(df, *keep), "bins", "node", IntegerType(), pa.int32(), lambda b: node_of(bins_matrix(b.column("bins"), width), nodes))
        named = F.create_map(*[F.lit(x) for i in self.nodes for x in (i, self.majority(i))])
        return at.withColumn("predicted", F.element_at(named, F.col("node")))


def _split(table: np.ndarray, min_leaf: int) -> int | None:
    """The bin before which (bin, class) counts differ most; bin 0 is that of missing values."""
    best = None
    for t in (k for k in range(2, len(table)) if table[k].any() and table[1:k].any()):
        sides = np.stack([table[1:t].sum(0), table[t:].sum(0)])
        if sides.sum(1).min() < min_leaf:
            continue
        statistic, _ = chi_square(sides)
        if best is None or statistic > best[0]:
            best = (statistic, t)
    return None if best is None else best[1]


def association_tree(
    train: DataFrame, features: Sequence[str], label: str, depth: int = 5, bins: int = 16, alpha: float = 0.05, min_split: int = 20, min_leaf: int = 7,
    accuracy: int = 10_000,
) -> AssociationTree:
    """Grow a tree of at most ``depth`` levels of splits; numeric features, classes as text."""
    known = train.where(F.col(label).isNotNull())
    # One row per class.
    classes = tuple(sorted(r[0] for r in known.select(F.col(label).cast("string")).distinct().collect()))
    binning = learn_bins(known, features, bins - 1, accuracy)
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label).cast("string")) - 1
    rows = pinned(binning.apply(known.select(code.alias("label"), *features), "label"))
    width, n_bins = len(features), binning.n_bins
    nodes: dict[int, Node] = {}
    open_nodes = [0]
    for level in range(depth + 1):
        if not open_nodes or not classes:
            break
        sums = rows.mapInArrow(_counts(nodes, open_nodes, width, n_bins, len(classes)), "node bigint, feature bigint, bin bigint, label bigint, n bigint")
        tables = {i: np.zeros((width, n_bins, len(classes)), np.int64) for i in open_nodes}
        for r in sums.groupBy("node", "feature", "bin", "label").agg(F.sum("n").alias("n")).collect():
            tables[r["node"]][r["feature"], r["bin"], r["label"]] = r["n"]
        following = []
        for i in open_nodes:
            nodes[i] = _decided(tables[i], level < depth, alpha, min_split, min_leaf)
            if nodes[i].feature is not None:
                following += [2 * i + 1, 2 * i + 2]
        open_nodes = following
    return AssociationTree(binning, classes, nodes)


def _decided(tables: np.ndarray, may_split: bool, alpha: float, min_split: int, min_leaf: int) -> Node:
    counts = tuple(int(n) for n in tables[0].sum(0))
    leaf = Node(counts)
    if not may_split or sum(counts) < min_split:
        return leaf
    tests = [(f, *chi_square(t[1:])) for f, t in enumerate(tables)]
    tests = [(log_upper_chi_square(x, df), f, x) for f, x, df in tests if df > 0]
    if not tests:
        return leaf
    log_p, f, statistic = min(tests)
    log_p = min(0.0, log_p + math.log(len(tests)))
    threshold = _split(tables[f], min_leaf) if log_p <= math.log(alpha) else None
    if threshold is None:
        return leaf
    left, right = (int(tables[f][a:b].sum()) for a, b in ((1, threshold), (threshold, None)))
    return Node(counts, f, threshold, right > left, statistic, log_p)
