"""Boosted regression trees of many folds side by side, by histograms of binned rows.

The trees are those of ``pyspark.ml`` (squared loss, every row and feature in every tree, ordered categories by mean), but a level
of the trees of all folds takes one scan of the rows in place of several jobs a fold.  Rows are binned once and written; a task
reads its file, follows the trees since the predictions were last written, and gives out counts and sums of what is left of
the label by fold, node, feature and bin.  What moves does not grow with the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .resampling import _table
from .selection import quantiles

#: Bins of a number, trees between two writings of the predictions, and rows handled at a time.
BINS, EVERY, ROWS = 32, 10, 1 << 15
#: A number of at most about so many values is cut between values that are counted, others at quantiles.
FEW = 1000


def midpoints(counts: dict[float, int], bins: int = BINS) -> list[float]:
    """Cuts between neighbouring values: all of them, or those nearest to even shares of the rows."""
    values = sorted(counts)
    if len(values) <= bins:
        return [(a + b) / 2 for a, b in zip(values, values[1:])]
    stride = sum(counts.values()) / bins
    out, seen, goal = [], counts[values[0]], stride
    for a, b in zip(values, values[1:]):
        before, seen = seen, seen + counts[b]
        if abs(before - goal) < abs(seen - goal):
            out.append((a + b) / 2)
            goal += stride
    return out


def cuts(x: DataFrame, fold: str, folds: list[int], numbers: list[str]) -> dict[tuple[int, str], list[float]]:
    """The cuts of each number over the rows before each fold."""
    sizes = x.agg(*(F.approx_count_distinct(c).alias(c) for c in numbers)).first()
    out: dict[tuple[int, str], list[float]] = {}
    many = [c for c in numbers if sizes[c] > FEW]
    for c in numbers:
        if c not in many:
            rows = x.groupBy(fold, c).count().collect()  # few values
            for f in folds:
                counts: dict[float, int] = {}
                for r in rows:
                    if r[0] < f:
                        counts[r[1]] = counts.get(r[1], 0) + r[2]
                out[f, c] = midpoints(counts)
    if many:
        own = x.select(F.explode(F.filter(F.array(*(F.lit(f) for f in folds)), lambda f: f > F.col(fold))).alias("f"), *many)
        for r in quantiles(own, {f"{c}:{k}": (c, k / BINS) for c in many for k in range(1, BINS)}, "f"):
            for c in many:
                out[int(r["f"]), c] = sorted({r[f"{c}:{k}"] for k in range(1, BINS)})
    return out


class Tree:
    """Nodes in heap order from 1: (feature, whether a bin goes right) of a split, rows and mean of every node."""

    def __init__(self):
        self.split: dict[int, tuple[int, np.ndarray]] = {}
        self.size: dict[int, float] = {}
        self.mean: dict[int, float] = {}

    def reach(self, code: int, depth: int) -> int:
        """The node that answers lead to, at most ``depth`` questions down; bit h of the code is the answer of node h."""
        h = 1
        while h in self.split and h < 1 << depth:
            h = 2 * h + (code >> (h - 1) & 1)
        return h

    def tables(self, depth: int) -> dict[int, np.ndarray]:
        """For each feature asked above ``depth``: the answers to all questions about it, by bin, as bits of a code."""
        out: dict[int, np.ndarray] = {}
        for h, (j, right) in self.split.items():
            if h < 1 << depth:
                out[j] = out.get(j, 0) | (right.astype(np.uint8) << np.uint8(h - 1))
        return out


def _codes(tables: dict[int, np.ndarray], bins: list[np.ndarray], n: int) -> np.ndarray:
    code = np.zeros(n, np.uint8)
    for j, t in tables.items():
        code |= t[bins[j]]
    return code


def _packed(x: np.ndarray) -> pa.Array:
    """The rows of x as one column of bytes."""
    size = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(x.tobytes())])


def _unpacked(a: pa.BinaryArray, kind) -> np.ndarray:
    """The columns of the numbers that ``_packed`` put together."""
    ends = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
    return np.ascontiguousarray(np.frombuffer(a.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(a), -1).T) if len(a) else np.zeros((0, 0), kind)


def best_split(n: np.ndarray, s: np.ndarray, categories: list[int], sizes: list[int], least: int) -> tuple[int, np.ndarray] | None:
    """The feature and bins to the right that reduce the variance most, the first of equals; None where nothing does.

    n, s: rows and sums by feature and bin.  Categories are ordered by their mean, those without rows last.
    """
    total, whole = n[0].sum(), s[0].sum()
    best, found = 0.0, None
    for j, size in enumerate(sizes):
        a, b = n[j, :size], s[j, :size]
        order = np.argsort(np.where(a > 0, b / np.maximum(a, 1), np.inf), kind="stable") if categories[j] else np.arange(size)
        left, sums = np.cumsum(a[order])[:-1], np.cumsum(b[order])[:-1]
        ok = (left >= least) & (total - left >= least)
        if not ok.any():
            continue
        gain = np.where(ok, (sums**2 / np.maximum(left, 1) + (whole - sums) ** 2 / np.maximum(total - left, 1) - whole**2 / total) / total, -np.inf)
        k = int(gain.argmax())
        if gain[k] > best:
            right = np.zeros(n.shape[1], bool)
            right[order[k + 1 :]] = True
            best, found = gain[k], (j, right)
    return found


def fit(x: DataFrame, fold: str, folds: list[int], label: str, features: list[str], categories: dict[str, int], trees: int, depth: int, rate: float, least: int) -> dict[int, tuple[list[list[dict]], list[float]]]:
    """For each fold the node tables of its trees (as ``attribution.leaves`` takes them) and their weights, from the rows before it.

    ``categories``: how many values 0, 1, ... a categorical feature has; other features are numbers.  The first tree has weight 1 and
    takes the label; each further one has weight ``rate`` and takes twice what is left, the descent of the squared loss.
    """
    if depth > 3:
        raise ValueError("answers of a tree are kept in eight bits")
    if not folds:
        return {}
    spark, folds = x.sparkSession, sorted(folds)
    x = x.where(F.col(fold) < folds[-1])
    numbers = [c for c in features if c not in categories]
    edges = cuts(x, fold, folds, numbers)
    # one column of bins for every feature and set of cuts
    layout: list[tuple[str, tuple | None]] = []
    column: dict[tuple[int, int], int] = {}
    for f in folds:
        for j, c in enumerate(features):
            item = (c, None if c in categories else tuple(edges[f, c]))
            if item not in layout:
                layout.append(item)
            column[f, j] = layout.index(item)
    sizes = {f: [categories[c] if c in categories else len(edges[f, c]) + 1 for c in features] for f in folds}
    width = max(s for v in sizes.values() for s in v)
    if width > 256:
        raise ValueError("too many categories")

    def binned(batches):
        for b in batches:
            value = {c: b.column(2 + j).to_numpy(zero_copy_only=False) for j, c in enumerate(features)}
            cols = [value[c].astype(np.int64) if e is None else np.searchsorted(np.array(e), value[c], "left") for c, e in layout]
            packed = np.stack([v.astype(np.uint8) for v in cols], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _packed(packed), _packed(np.zeros((b.num_rows, len(folds))))], ["fold", "y", "bins", "preds"])

    schema = "fold int, y double, bins binary, preds binary"
    parts = spark.sparkContext.defaultParallelism
    rows = x.select(F.col(fold).cast("int").alias("fold"), F.col(label).cast("double").alias("y"), *(F.col(c).cast("double").alias(c) for c in features))
    # rows of a file in order of their fold, so that those before a fold come first in every batch
    table = stored(rows.repartition(parts).sortWithinPartitions("fold").mapInArrow(binned, schema), "binned")
    done: dict[int, list[Tree]] = {f: [] for f in folds}
    rates = [1.0] + [rate] * (trees - 1)

    def added(b, made: dict[int, list], i: int):
        """Rows before the i-th fold, their bins by feature, and their predictions with the trees that were made since."""
        f = folds[i]
        n = int(np.searchsorted(b["fold"], f, "left"))
        own = [b["bins"][column[f, j], :n] for j in range(len(features))]
        p = b["preds"][i, :n]
        for tables, values in made[f]:
            p = p + values[_codes(tables, own, n)]
        return n, own, p

    def arrays(b):
        return {"fold": b.column("fold").to_numpy(), "y": b.column("y").to_numpy(), "bins": _unpacked(b.column("bins"), np.uint8), "preds": _unpacked(b.column("preds"), np.float64)}

    def leaf_values(since: int) -> dict[int, list]:
        return {f: [(t.tables(depth), np.array([rates[since + k] * t.mean[t.reach(code, depth)] for code in range(128)])) for k, t in enumerate(done[f][since:])] for f in folds}

    def scan(files: list[str], made: dict[int, list], open_: dict[int, tuple], d: int, first: bool):
        """Rows and sums [node of depth d, feature, bin] of each fold."""

        def run(batches):
            counts = {f: np.zeros((2, 1 << d, len(features), width)) for f in open_}
            for specs in batches:
                for part in specs.column(0).to_pylist():
                    for batch in _table([files[part]], ROWS):
                        b = arrays(batch)
                        for i, f in enumerate(folds):
                            if f not in open_:
                                continue
                            n, own, p = added(b, made, i)
                            if not n:
                                continue
                            tables, slots = open_[f]
                            rest = b["y"][:n] - p if first else 2 * (b["y"][:n] - p)
                            at = slots[_codes(tables, own, n)]
                            for j in range(len(features)):
                                key = at + own[j]
                                for q, w in enumerate((None, rest)):
                                    counts[f][q, :, j] += np.bincount(key, w, width << d)[: width << d].reshape(1 << d, width)
            for f, c in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([c.tobytes()], pa.binary())], ["f", "c"])

        out = {f: np.zeros((2, 1 << d, len(features), width)) for f in open_}
        for r in spark.range(0, len(files), 1, len(files)).mapInArrow(run, "f int, c binary").collect():  # a bounded table a task
            out[r["f"]] += np.frombuffer(bytes(r["c"])).reshape(out[r["f"]].shape)
        return out

    def written_on(made: dict[int, list]) -> DataFrame:
        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                b = arrays(batch)
                for i in range(len(folds)):
                    n, _, p = added(b, made, i)
                    b["preds"][i, :n] = p
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("fold", "y", "bins")), _packed(np.ascontiguousarray(b["preds"].T))], batch.schema.names)

        return stored(table.mapInArrow(run, schema), "binned")

    since, files = 0, sorted(table.inputFiles())
    for t in range(trees):
        if t - since == EVERY:
            table = written_on(leaf_values(since))
            since, files = t, sorted(table.inputFiles())
        made = leaf_values(since)
        now = {f: Tree() for f in folds}
        for d in range(depth):
            going = [f for f in folds if d == 0 or any(h in now[f].split for h in range(1 << d - 1, 1 << d))]
            # rows of nodes that were not split are counted in a place beyond those of the depth
            place = {f: np.array([(h - (1 << d) if h >= 1 << d else 1 << d) * width for h in (now[f].reach(code, d) for code in range(128))]) for f in going}
            for f, (n, s) in scan(files, made, {f: (now[f].tables(d), place[f]) for f in going}, d, t == 0).items():
                for h in range(1 << d, 2 << d):
                    size, total = n[h - (1 << d), 0].sum(), s[h - (1 << d), 0].sum()
                    if d and h // 2 not in now[f].split or not size:
                        continue
                    now[f].size[h], now[f].mean[h] = size, total / size
                    found = best_split(n[h - (1 << d)], s[h - (1 << d)], [c in categories for c in features], sizes[f], least)
                    if found:
                        j, right = now[f].split[h] = found
                        for child, side in ((2 * h, ~right), (2 * h + 1, right)):
                            k = n[h - (1 << d), j][side].sum()
                            now[f].size[child], now[f].mean[child] = k, s[h - (1 << d), j][side].sum() / k
        for f in folds:
            done[f].append(now[f])

    def nodes(f: int, t: Tree) -> list[dict]:
        out = []
        for h in sorted(t.mean):
            n = {"id": h - 1, "prediction": t.mean[h], "rawCount": t.size[h], "leftChild": -1, "rightChild": -1, "split": None}
            if h in t.split:
                j, right = t.split[h]
                c = features[j]
                listed = [float(v) for v in np.flatnonzero(~right[: sizes[f][j]])] if c in categories else [edges[f, c][int(np.flatnonzero(right)[0]) - 1]]
                n |= {"leftChild": 2 * h - 1, "rightChild": 2 * h, "split": {"featureIndex": j, "leftCategoriesOrThreshold": listed, "numCategories": categories.get(c, -1)}}
            out.append(n)
        return out

    return {f: ([nodes(f, t) for t in done[f]], rates) for f in folds}
