"""Hypothesis tests from grouped moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered as O


def two_proportion_z(wins_a: Column, n_a: Column, wins_b: Column, n_b: Column) -> Column:
    """Pooled z; 0 without spread, null without rows."""
    p = (wins_a + wins_b) / F.nullif((n_a + n_b).cast("double"), F.lit(0.0))
    se = F.sqrt(p * (1 - p) * (1 / n_a.cast("double") + 1 / n_b.cast("double")))
    z = (wins_a / n_a - wins_b / n_b) / F.nullif(se, F.lit(0.0))
    return F.when((n_a > 0) & (n_b > 0), F.coalesce(z, F.lit(0.0)))


def welch(mean_a: Column, sd_a: Column, n_a: Column, mean_b: Column, sd_b: Column, n_b: Column) -> tuple[Column, Column]:
    """t and degrees of freedom; null under two rows."""
    va, vb = sd_a * sd_a / n_a, sd_b * sd_b / n_b
    enough = (n_a > 1) & (n_b > 1) & (va + vb > 0)
    t = F.when(enough, (mean_a - mean_b) / F.sqrt(va + vb))
    df = F.when(enough, (va + vb) * (va + vb) / (va * va / F.greatest(n_a - 1, F.lit(1)) + vb * vb / F.greatest(n_b - 1, F.lit(1))))
    return t, df


def paired(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """n, mean difference, paired t, its degrees of freedom and Cohen's d of a - b."""
    d = F.col(a) - F.col(b)
    g = df.groupBy(*(by or [])).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"))
    sd = F.nullif("sd", F.lit(0.0))
    return g.select(*(by or []), "n", "mean_diff", (F.col("mean_diff") / (sd / F.sqrt("n"))).alias("t"), (F.col("n") - 1).alias("df"), (F.col("mean_diff") / sd).alias("cohen_d"))


def wilcoxon(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Signed-rank statistic and its normal approximation with the tie correction; zero differences are left out."""
    x = df.select(key, (F.round(F.col(a) - F.col(b), 12)).alias("d")).where("d <> 0").withColumn("m", F.abs("d"))
    pieces = O.dealt(x, ["m", key])
    x = O.mean_ranks(pieces, "m", ["m", key], "rk")
    g = x.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("rk"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("rk"))), F.lit(0.0)).alias("w_minus"))
    n = F.col("n").cast("double")
    g = g.crossJoin(F.broadcast(O.ties(pieces, "m")))
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48
    return g.select("n", F.least("w_plus", "w_minus").alias("w"), ((F.least("w_plus", "w_minus") - n * (n + 1) / 4) / F.sqrt(F.nullif(var, F.lit(0.0)))).alias("z"))


def trend(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """n, Spearman's rho of the value against its place in order, the slope of the value over places, and their linear correlation."""
    placed = O.row_numbers(O.dealt(df.select(*order, value, F.round(value, 12).alias("_v")), order), order, "_seq").drop(O.PIECE)
    x = O.mean_ranks(O.dealt(placed, ["_v", "_seq"]), "_v", ["_v", "_seq"], "_rank")
    return x.agg(F.count("*").alias("n"), F.corr("_seq", "_rank").alias("rho"), F.regr_slope(value, F.col("_seq")).alias("slope"), F.corr(value, "_seq").alias("linear"))
