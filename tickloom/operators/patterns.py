"""Condition patterns: binning, conditions as long rows, group statistics, folds, stability and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import quantiles


def matches(condition: dict[str, object]) -> Column:
    """AND of equalities; null equals nothing."""
    return reduce(lambda a, b: a & b, (F.coalesce(F.col(k) == F.lit(v), F.lit(False)) for k, v in condition.items()), F.lit(True))


def tertiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns cut at their exact 1/3 and 2/3 quantiles: right-closed bins 0, 1, 2; equal edges make fewer bins; null stays."""
    edges = quantiles(df, {f"{c}{i}": (c, i / 3) for c in columns for i in (1, 2)})[0]
    for c in columns:
        lo, hi = (F.lit(edges[f"{c}{i}"]).cast("double") for i in (1, 2))
        df = df.withColumn(f"{c}_bin", F.when(F.col(c).isNull(), None).when(F.col(c) <= lo, 0).when(F.col(c) <= hi, 1).otherwise(2))
    return df


def patterns(df: DataFrame, key: str, target: str, columns: list[str], depth: int = 2) -> DataFrame:
    """(key, target, cond) of all single conditions and, at depth 2, of all pairs of two columns: one pass over the rows.

    The pairs of a row's conditions are made inside the row, so there is no self join.
    """
    parts = F.filter(F.array(*(F.when(F.col(c).isNotNull(), F.concat_ws("=", F.lit(c), F.col(c).cast("string"))) for c in sorted(columns))), lambda x: x.isNotNull())
    x = df.select(key, F.col(target).alias("target"), parts.alias("p"))
    if depth == 1:
        return x.select(key, "target", F.explode("p").alias("cond"))
    pairs = F.flatten(F.transform("p", lambda a, i: F.transform(F.expr("p"), lambda b, j: F.when(j > i, F.concat_ws(" & ", a, b)))))
    return x.select(key, "target", F.explode(F.array_union(F.col("p"), F.filter(pairs, lambda v: v.isNotNull()))).alias("cond"))


def group_stats(long: DataFrame, least: int) -> DataFrame:
    """n, win rate, mean, moments and profit factor of each condition with at least so many rows."""
    r = F.col("target")
    g = long.groupBy("cond").agg(F.count("*").alias("n"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(r).alias("expectancy"), F.stddev_samp(r).alias("sd"), F.sum(F.when(r > 0, r)).alias("gain"), F.sum(F.when(r < 0, -r)).alias("loss"))
    return g.where(F.col("n") >= least).withColumn("profit_factor", F.when(F.col("loss") > 0, F.coalesce("gain", F.lit(0.0)) / F.col("loss"))).drop("gain", "loss")


SHIFTS = (-0.05, 0.0, 0.05)


def perturbed(df: DataFrame, target: str, binned: list[str], others: list[str], shifts: tuple[float, ...] = SHIFTS, bins: int = 3, least: int = 10) -> DataFrame:
    """(cond, column, shift, n, expectancy, original): every condition of a bin, alone or with one other, with its edges moved by each shift.

    Both edges of a moved bin are inclusive; ``original`` is the mean in the bin as it was cut; variants under ``least`` rows
    are left out.  Each row falls into one cell of the grid of all moved edges of a column, for each other condition it
    meets: one aggregate serves all conditions, and a variant is the sum of neighbouring cells.
    """
    shares = sorted({min(1.0, max(0.0, q + s)) for i in range(bins) for s in shifts for q in (i / bins, (i + 1) / bins)})
    edges = quantiles(df, {f"{c}:{q}": (c, q) for c in binned for q in shares})[0]
    grids = {c: [edges[f"{c}:{q}"] for q in shares] for c in binned}
    if any(e is None for g in grids.values() for e in g):
        return df.sparkSession.createDataFrame([], "cond string, column string, shift double, n long, expectancy double, original double")
    conds = {c: F.when(F.col(c).isNotNull(), F.concat_ws("=", F.lit(c), F.col(c).cast("string"))) for c in [*others, *(f"{c}_bin" for c in binned)]}
    rows = []
    for c in binned:
        # 2 i + 1 on the i-th edge, an even number between edges
        cell = sum((F.when(F.col(c) > e, 2).when(F.col(c) == e, 1).otherwise(0) for e in sorted(set(grids[c]))), F.lit(0))
        rest = F.filter(F.array(F.lit(""), *(v for n, v in conds.items() if n != f"{c}_bin")), lambda v: v.isNotNull())
        rows.append(F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("column"), cell.alias("cell"), F.col(f"{c}_bin").alias("bin"), rest.alias("rest"))))
    x = df.select(F.col(target).alias("r"), F.explode(F.filter(F.array(*rows), lambda v: v.isNotNull())).alias("g")).where("r IS NOT NULL")
    cells = x.select("g.column", "g.cell", "g.bin", "r", F.explode("g.rest").alias("rest")).groupBy("column", "rest", "cell", "bin").agg(F.count("*").alias("n"), F.sum("r").alias("s"))
    windows = []
    for c in binned:
        distinct = sorted(set(grids[c]))
        for i in range(bins):
            for s in shifts:
                lo, hi = (edges[f"{c}:{min(1.0, max(0.0, q + s))}"] for q in (i / bins, (i + 1) / bins))
                if min(1.0, (i + 1) / bins + s) > max(0.0, i / bins + s):
                    windows.append((c, i, s, 2 * distinct.index(lo) + 1, 2 * distinct.index(hi) + 1))
    w = df.sparkSession.createDataFrame(windows, "column string, of int, shift double, first int, last int")
    # few rows on both sides: windows a column, and cells by column and other condition
    hit = cells.join(F.broadcast(w), "column").where("cell >= first AND cell <= last")
    g = hit.groupBy("column", "rest", "of", "shift").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("expectancy"))
    was = cells.groupBy("column", "rest", F.col("bin").alias("of")).agg((F.sum("s") / F.sum("n")).alias("original"))
    own = F.concat(F.col("column"), F.lit("_bin="), F.col("of").cast("string"))
    both = F.when(F.col("rest") == "", own).when(F.split_part("rest", F.lit("="), F.lit(1)) < F.concat("column", F.lit("_bin")), F.concat_ws(" & ", "rest", own)).otherwise(F.concat_ws(" & ", own, "rest"))
    return g.where(F.col("n") >= least).join(was, ["column", "rest", "of"]).select(both.alias("cond"), "column", "shift", "n", "expectancy", "original")


def stability(variants: DataFrame) -> DataFrame:
    """(cond, n_variants, pass_share, label): the share of variants that keep the sign of the mean."""
    share = F.avg((F.signum("expectancy") == F.signum("original")).cast("int"))
    g = variants.groupBy("cond").agg(F.count("*").alias("n_variants"), share.alias("pass_share"))
    return g.withColumn("label", F.when(F.col("pass_share") >= 0.7, "stable").when(F.col("pass_share") >= 0.4, "mixed").otherwise("unstable"))
