"""Clustering: all restarts in one scan a step, silhouettes as pyspark.ml has them, losing streaks."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_hot(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """A 0/1 column for each level; null is 0 in all."""
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in levels})


@dataclass
class Clusters:
    """Standardisation and centres; ``centres`` are in standardised coordinates."""

    columns: list[str]
    means: np.ndarray
    scales: np.ndarray
    centres: np.ndarray
    cost: float
    silhouette: float

    @property
    def k(self) -> int:
        return len(self.centres)


#: Rows that starting centres are drawn from, the first by hash; all rows take part in everything after.
START_ROWS = 2000


def starts(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k starting centres, each drawn with a chance by its squared distance from those before."""
    centres = [rows[rng.integers(len(rows))]]
    while len(centres) < k:
        d = np.min([((rows - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(rows[rng.choice(len(rows), p=d / d.sum())] if d.sum() > 0 else centres[0])
    return np.array(centres)


#: Rows that a task measures against all centres at a time.
_CHUNK = 1024


def _plain(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """[centre, row]: squared distances, added up column by column."""
    return sum((rows[:, q] - centres[:, q : q + 1]) ** 2 for q in range(centres.shape[1]))


def _marks(models: list[np.ndarray]):
    """A function of [column, row] with rows of ones and of squared lengths below: [centre of all models, row], 1 at each model's nearest.

    All distances come from one product of matrices, less the rows' own lengths, which decide nothing.  Where two centres are
    equally near but for rounding, plain distances decide, the first of equals.
    """
    kinds = [(k, [i for i, m in enumerate(models) if len(m) == k]) for k in sorted({len(m) for m in models})]
    first = np.concatenate([[0], np.cumsum([len(m) for m in models])])
    order = np.concatenate([np.arange(first[i], first[i + 1]) for _, of in kinds for i in of])
    centres = np.concatenate(models)[order]
    lengths = (centres * centres).sum(axis=1)
    weights = np.column_stack([-2 * centres, lengths])
    width = centres.shape[1]
    back = np.argsort(order)

    space = [np.empty((len(centres), _CHUNK)) for _ in range(2)]  # used again by each chunk

    def mark(r: np.ndarray) -> np.ndarray:
        d, own = (b if r.shape[1] == _CHUNK else np.empty((len(centres), r.shape[1])) for b in space)
        np.matmul(weights, r[: width + 1], out=d)
        slack = 1e-12 * (1 + lengths.max() + r[width + 1].max())
        at = 0
        for k, of in kinds:
            part = d[at : at + k * len(of)].reshape(len(of), k, -1)
            near = part <= part.min(axis=1, keepdims=True) + slack
            if np.count_nonzero(near) > len(of) * r.shape[1]:
                for j, i in enumerate(of):
                    rows = np.flatnonzero(near[j].sum(axis=0) > 1)
                    near[j][:, rows] = _plain(r[:width, rows].T, models[i]).argmin(axis=0) == np.arange(k)[:, None]
            own[at : at + k * len(of)] = near.reshape(k * len(of), -1)
            at += k * len(of)
        return own if (back == np.arange(len(back))).all() else own[back]

    return mark


def _chunks(batches, width: int):
    """The rows of the batches as [column, row], ones and squared lengths below."""
    for b in batches:
        for i in range(0, b.num_rows, _CHUNK):
            part = b.slice(i, _CHUNK)
            r = np.ones((width + 2, part.num_rows))
            for q, c in enumerate(part.columns):
                r[q] = c.to_numpy(zero_copy_only=False)
            r[width + 1] = (r[:width] ** 2).sum(axis=0)
            yield r


def totals(x: DataFrame, models: list[np.ndarray]) -> list[np.ndarray]:
    """For each model [centre, sum]: the sums of the columns, number and squared lengths of the rows nearest to each centre, in one scan."""
    width = len(x.columns)
    names = [f"s{q}" for q in range(width + 2)]
    ids = [(i, j) for i, m in enumerate(models) for j in range(len(m))]

    def run(batches):
        mark = _marks(models)
        sums = np.zeros((len(ids), width + 2))
        for r in _chunks(batches, width):
            sums += mark(r) @ r.T
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in ids], pa.int32()), pa.array([j for _, j in ids], pa.int32()), *(pa.array(np.ascontiguousarray(sums[:, q])) for q in range(width + 2))], ["m", "j", *names])

    got = {(r["m"], r["j"]): np.array(r[2:]) for r in x.mapInArrow(run, "m int, j int, " + ", ".join(f"{n} double" for n in names)).groupBy("m", "j").agg(*(F.sum(n).alias(n) for n in names)).collect()}
    return [np.array([got[i, j] for j in range(len(m))]) for i, m in enumerate(models)]


def advance(x: DataFrame, models: list[np.ndarray]) -> tuple[list[np.ndarray], list[float]]:
    """One step of all models in one scan of the rows: new centres, and the costs of the old.  Tasks give out sums a centre."""
    width = len(x.columns)
    new, costs = [], []
    for m, t in zip(models, totals(x, models), strict=True):
        n = t[:, width]
        new.append(np.where(n[:, None] > 0, t[:, :width] / np.maximum(n, 1)[:, None], m))
        costs.append(float((t[:, width + 1] - 2 * (m * t[:, :width]).sum(axis=1) + (m * m).sum(axis=1) * n).sum()))
    return new, costs


def silhouettes(x: DataFrame, models: list[np.ndarray]) -> list[float]:
    """Mean silhouette of each model by squared distances, as pyspark.ml has it; -1 where all rows are in one cluster.  Two scans for all models."""
    width = len(x.columns)
    sums = totals(x, models)

    def run(batches):
        mark = _marks(models)
        edges = np.concatenate([[0], np.cumsum([len(m) for m in models])])
        out = np.zeros((len(models), 2))
        for r in _chunks(batches, width):
            own = mark(r)
            for i, t in enumerate(sums):
                n = t[:, width, None]
                mine = own[edges[i] : edges[i + 1]] > 0
                # mean squared distance to the rows of each cluster; those of an empty one are far
                d = np.where(n > 0, (t[:, width + 1, None] - 2 * (t[:, :width] @ r[:width])) / np.maximum(n, 1) + r[width + 1], np.inf)
                count = (mine * n).sum(axis=0)
                a = np.where(mine, d, 0.0).sum(axis=0) * count / np.maximum(count - 1, 1)
                b = np.where(mine, np.inf, d).min(axis=0)
                most = np.maximum(a, b)
                out[i] += np.where((count > 1) & (most > 0), (b - a) / np.where(most > 0, most, 1.0), 0.0).sum() if np.isfinite(b).all() else 0.0, len(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models), dtype=np.int32)), pa.array(out[:, 0]), pa.array(out[:, 1])], ["m", "s", "n"])

    got = {r["m"]: r["s"] / r["n"] for r in x.mapInArrow(run, "m int, s double, n double").groupBy("m").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
    return [got[i] if (t[:, width] > 0).sum() > 1 else -1.0 for i, t in enumerate(sums)]


def fit_all(x: DataFrame, models: list[np.ndarray], steps: int = 50, tol: float = 1e-4) -> tuple[list[np.ndarray], list[float]]:
    """Lloyd's steps of all models side by side until no centre moves by more than tol; those that stand still leave the scan."""
    models, costs, open_ = list(models), [math.inf] * len(models), list(range(len(models)))
    for _ in range(steps):
        new, cost = advance(x, [models[i] for i in open_])
        moved = []
        for i, m, c in zip(open_, new, cost, strict=True):
            costs[i] = c
            if ((m - models[i]) ** 2).sum(axis=1).max() > tol * tol:
                moved.append(i)
            models[i] = m
        open_ = moved
        if not open_:
            break
    if open_:
        for i, c in zip(open_, advance(x, [models[i] for i in open_])[1], strict=True):
            costs[i] = c
    return models, costs


def fit(df: DataFrame, columns: list[str], ks: tuple[int, ...] = (2, 3, 4, 5), restarts: int = 10, seed: int = 42) -> Clusters:
    """The k of the best silhouette; each k keeps the cheapest of its restarts.  Rows with nulls are left out.

    All restarts of all k advance together: one scan a step, whatever their number.  A silhouette is by squared distances.
    """
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna()
    s = rows.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_samp(c).alias(f"s_{c}") for c in columns)).first()
    if s["n"] < 15:
        raise ValueError("too few rows to cluster")
    means, scales = np.array([s[f"m_{c}"] for c in columns]), np.array([s[f"s_{c}"] or 1.0 for c in columns])
    x = rows.select(*(((F.col(c) - F.lit(float(m))) / F.lit(float(d))).alias(c) for c, m, d in zip(columns, means, scales, strict=True))).persist()
    try:
        some = np.array([list(r) for r in x.orderBy(F.xxhash64(*columns), *columns).limit(START_ROWS).collect()])
        plan = [(k, i) for k in ks for i in range(restarts)]
        models, costs = fit_all(x, [starts(some, k, np.random.default_rng([seed, k, i])) for k, i in plan])
        found = []
        for k in ks:
            at = min((i for i, (q, _) in enumerate(plan) if q == k), key=lambda i: costs[i])
            found.append(Clusters(columns, means, scales, models[at], costs[at], 0.0))
        best = None
        for c, value in zip(found, silhouettes(x, [c.centres for c in found]), strict=True):
            c.silhouette = value
            best = c if best is None or c.silhouette > best.silhouette else best
        return best
    finally:
        x.unpersist()


def lloyd(x: DataFrame, key: str, columns: list[str], k: int, steps: int, digits: int = 9) -> Column:
    """The cluster, as a column over x, after a fixed number of steps from fixed starts: the rows of the k least MD5 of their key.

    Coordinates are standardised (nulls to 0) and, like the centres of each step, rounded, so that the order of additions
    decides nothing.  A centre that no row is near to stays where it was.
    """
    s = x.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_samp(c).alias(f"s_{c}") for c in columns)).first()
    z = {c: F.round(F.coalesce((F.col(c) - F.lit(s[f"m_{c}"])) / F.lit(s[f"s_{c}"] or 1.0), F.lit(0.0)), digits) for c in columns}
    first = x.select(key, *(v.alias(c) for c, v in z.items())).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(k).collect()
    centres = np.array([list(r)[1:] for r in first], float).reshape(len(first), len(columns))
    points = x.select(*(v.alias(c) for c, v in z.items())).persist()
    for _ in range(steps if len(first) else 0):
        centres = np.round(advance(points, [centres])[0][0], digits)
    points.unpersist()
    return nearest(list(z.values()), np.zeros(len(columns)), np.ones(len(columns)), centres) if len(first) else F.lit(0)


def nearest(columns: list[str] | list[Column], means: np.ndarray, scales: np.ndarray, centres: np.ndarray) -> Column:
    """Number of the nearest centre, the first of equals; missing values count as 0."""
    z = [(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(0.0)) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(columns, means, scales, strict=True)]
    far = [F.struct(sum(((v - F.lit(float(p))) * (v - F.lit(float(p))) for v, p in zip(z, c, strict=True)), F.lit(0.0)).alias("d"), F.lit(i).alias("cluster")) for i, c in enumerate(centres)]
    return F.least(*far)["cluster"] if len(far) > 1 else F.lit(0)


def assign(df: DataFrame, fitted: Clusters) -> DataFrame:
    """df with its cluster; missing values count as 0."""
    return df.withColumn("cluster", nearest(fitted.columns, fitted.means, fitted.scales, fitted.centres))


def losing_streak(df: DataFrame, r: str, order: list[str], by: list[str]) -> DataFrame:
    """Longest run of losses of each series: its length and first row; the earliest of several."""
    w = Window.partitionBy(*by).orderBy(*order)
    x = df.withColumn("_loss", F.col(r) < 0).withColumn("_grp", F.sum((~F.col("_loss")).cast("int")).over(w))
    g = x.where("_loss").groupBy(*by, "_grp").agg(F.count("*").alias("length"), F.min(order[0]).alias("start"))
    return g.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("length"), "start"))).where("_k = 1").select(*by, "length", "start")
