"""Shapley values of boosted trees by tree path, from the node tables of a fitted ``pyspark.ml`` model.

For a leaf of value v whose path asks about the features D, feature j is followed with 1 where a row meets all of j's
questions (o_j) and else with the share of training rows that do, question by question (z_j).  The leaf's part of a
row's value for feature i is

    v (o_i - z_i) sum over S in D - {i} of |S|! (|D| - |S| - 1)! / |D|! prod_S o_j prod_(D - S - {i}) z_j

and a tree's values are sums over its leaves: the path-dependent values, exactly.  A path of depth d has at most d
features, so at most 2 ** d subsets.  Rows of a batch are handled at once in each of them.

Trees are a bounded model (trees x 2 ** depth nodes) and go to the tasks in the closure; rows are read once.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Question:
    """Whether a row goes left: value <= threshold, or value in categories."""

    feature: int
    threshold: float | None
    categories: tuple[float, ...] | None

    def left(self, x: np.ndarray) -> np.ndarray:
        v = x[:, self.feature]
        return v <= self.threshold if self.categories is None else np.isin(v, self.categories)


@dataclass
class Leaf:
    """A leaf's weighted value, and its path by feature: questions with the wanted answer, and the share of rows that gave it."""

    value: float
    path: dict[int, tuple[list[tuple[Question, bool]], float]]


def node_table(model: GBTRegressionModel, path: str) -> list[list[dict]]:
    """The nodes of each tree in order of their number, as the model's writer lays them down at ``path`` (a shared folder)."""
    model.write().overwrite().save(path)
    rows = SparkSession.active().read.parquet(f"{path}/data").selectExpr("treeID AS tree", "nodeData.*").collect()
    trees: dict[int, list] = {}
    for r in rows:
        trees.setdefault(r["tree"], []).append(r.asDict(recursive=True))
    return [sorted(trees[t], key=lambda n: n["id"]) for t in sorted(trees)]


def leaves(trees: list[list[dict]], weights: list[float]) -> list[Leaf]:
    out: list[Leaf] = []

    def walk(nodes: dict[int, dict], at: int, weight: float, path: dict) -> None:
        n = nodes[at]
        if n["leftChild"] < 0:
            out.append(Leaf(weight * n["prediction"], path))
            return
        s = n["split"]
        listed = tuple(s["leftCategoriesOrThreshold"])
        q = Question(s["featureIndex"], listed[0], None) if s["numCategories"] < 0 else Question(s["featureIndex"], None, listed)
        for child, answer in ((n["leftChild"], True), (n["rightChild"], False)):
            asked, share = path.get(q.feature, ([], 1.0))
            walk(nodes, child, weight, {**path, q.feature: ([*asked, (q, answer)], share * nodes[child]["rawCount"] / n["rawCount"])})

    for t, w in zip(trees, weights, strict=True):
        walk({n["id"]: n for n in t}, 0, w, {})
    return out


def base_value(found: list[Leaf]) -> float:
    """The value that the attributions of a row add up from: every leaf by its share of training rows."""
    return sum(f.value * math.prod(z for _, z in f.path.values()) for f in found)


def shapley(found: list[Leaf], x: np.ndarray) -> np.ndarray:
    """[row, feature] attributions; a row's sum is its prediction less ``base_value``."""
    out = np.zeros(x.shape)
    answers: dict[int, np.ndarray] = {}
    for f in found:
        met = {}
        for j, (asked, _) in f.path.items():
            o = np.ones(len(x), bool)
            for q, want in asked:
                if id(q) not in answers:
                    answers[id(q)] = q.left(x)
                o &= answers[id(q)] if want else ~answers[id(q)]
            met[j] = o.astype(float)
        d = len(met)
        for i in met:
            rest = [j for j in met if j != i]
            total = np.zeros(len(x))
            for k in range(d):
                w = math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d)
                for s in itertools.combinations(rest, k):
                    part = np.full(len(x), w * math.prod(f.path[j][1] for j in rest if j not in s))
                    for j in s:
                        part *= met[j]
                    total += part
            out[:, i] += f.value * (met[i] - f.path[i][1]) * total
    return out


def attributions(df: DataFrame, found: list[Leaf], features: list[str], keys: list[str]) -> DataFrame:
    """keys, and the attribution of each feature under its name; ``features`` are numeric columns in the model's order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame(shapley(found, b[[f"_x{i}" for i in range(len(features))]].to_numpy(float)), columns=features)
            for k in keys:
                out.insert(0, k, b[k].to_numpy())
            yield out[[*keys, *features]]

    source = df.select(*keys, *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)))
    schema = ", ".join([*(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys), *(f"`{c}` double" for c in features)])
    return source.mapInPandas(run, schema)


def mean_absolute(df: DataFrame, found: list[Leaf], features: list[str]) -> DataFrame:
    """One row: the mean absolute attribution of each feature; tasks give out sums alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = 0, np.zeros(len(features))
        for b in batches:
            n, sums = n + len(b), sums + np.abs(shapley(found, b.to_numpy(float))).sum(axis=0)
        yield pd.DataFrame([[n, *sums]], columns=["n", *features])

    source = df.select(*(F.col(c).cast("double").alias(c) for c in features))
    parts = source.mapInPandas(run, "n long, " + ", ".join(f"`{c}` double" for c in features))
    return parts.agg(*((F.sum(c) / F.nullif(F.sum("n"), F.lit(0))).alias(c) for c in features))
