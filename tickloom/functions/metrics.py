"""Performance metrics as aggregate columns; all are null-safe and never divide by zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def profit_factor(r: Column) -> Column:
    """Gains over losses; infinite without losses but with gains, null without either."""
    win, loss = F.sum(F.when(r > 0, r)), F.sum(F.when(r < 0, -r))
    return F.when(loss > 0, F.coalesce(win, F.lit(0.0)) / loss).when(win > 0, F.lit(float("inf")))


def finite_profit_factor(r: Column) -> Column:
    """Gains over losses, null where it would be infinite."""
    win, loss = F.sum(F.when(r > 0, r)), F.sum(F.when(r < 0, -r))
    return F.when(loss > 0, F.coalesce(win, F.lit(0.0)) / loss)


def expectancy(r: Column) -> Column:
    return F.avg(r)


def win_rate(r: Column) -> Column:
    return F.avg((r > 0).cast("double"))


def sharpe(r: Column, per_year: Column) -> Column:
    """Mean over sample deviation, scaled by the square root of positions a year; null under two values or without spread."""
    return F.avg(r) / F.nullif(F.stddev_samp(r), F.lit(0.0)) * F.sqrt(per_year)


def years(ts: Column) -> Column:
    return F.greatest((F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / F.lit(365.25 * 86400 * 1e6), F.lit(1e-9))


def summary(r: Column, ts: Column) -> list[Column]:
    n = F.count(r)
    return [n.alias("n"), win_rate(r).alias("win_rate"), expectancy(r).alias("expectancy"), finite_profit_factor(r).alias("profit_factor"), sharpe(r, n / years(ts)).alias("sharpe")]
