"""Daily indicators and regimes over OHLCV bars.

Every function takes bars with a time column and returns them with new columns.  Windows count rows, not calendar time,
and are partitioned by the ``by`` columns; a single series is one partition, so pass daily bars, not ticks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

YEAR = 252


def ordered(by: list[str], ts: str = "bar_ts"):
    return Window.partitionBy(*by).orderBy(ts) if by else Window.partitionBy(F.lit(0)).orderBy(ts)


def safe_div(a: Column, b: Column) -> Column:
    """a / b in doubles, null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def true_range(b: DataFrame, by: list[str], ts: str = "bar_ts") -> DataFrame:
    """Largest of high - low and the distances to the previous close; the first row has high - low."""
    prev = F.lag("close").over(ordered(by, ts))
    return b.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))


def ewm(values: Iterator[float | None], alpha: float, least: int) -> list[float | None]:
    """Non-adjusted exponential mean; null until ``least`` values; a null carries the mean on while old weight decays."""
    out, y, weight, n = [], None, 1.0, 0
    for x in values:
        if x is None or x != x:
            weight *= 1 - alpha
        elif y is None:
            y, n, weight = float(x), 1, 1.0
        else:
            weight *= 1 - alpha
            y = (weight * y + alpha * x) / (weight + alpha)
            weight, n = 1.0, n + 1
        out.append(y if n >= least else None)
    return out


def fold(df: DataFrame, by: list[str], ts: str, new: dict[str, str], f: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Sequential computation over each ordered series, in Arrow batches; ``f`` adds the columns of ``new``."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in new.items())])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return f(g.sort_values(ts).reset_index(drop=True))[schema.fieldNames()]

    return df.groupBy(*by).applyInPandas(run, schema)


def atr(b: DataFrame, by: list[str], ts: str = "bar_ts", window: int = 14) -> DataFrame:
    """Wilder's average true range; null for the first window - 1 rows."""

    def f(g: pd.DataFrame) -> pd.DataFrame:
        return g.assign(atr=pd.Series(ewm(g["tr"], 1 / window, window), dtype="float64"))

    return fold(true_range(b, by, ts), by, ts, {"atr": "double"}, f)


def directional_move(b: DataFrame, by: list[str], ts: str = "bar_ts") -> DataFrame:
    """+DM and -DM; 0 in the first row."""
    w = ordered(by, ts)
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    plus = F.when((up > down) & (up > 0), up).otherwise(F.lit(0))
    minus = F.when((down > up) & (down > 0), down).otherwise(F.lit(0))
    return b.withColumn("plus_dm", plus).withColumn("minus_dm", minus)


def adx(b: DataFrame, by: list[str], ts: str = "bar_ts", window: int = 14) -> DataFrame:
    """Average directional index with its two indicators."""

    def f(g: pd.DataFrame) -> pd.DataFrame:
        a = 1 / window
        plus, minus = ewm(g["plus_dm"], a, 1), ewm(g["minus_dm"], a, 1)
        di = [(100 * p / r, 100 * m / r) if r == r and r else (None, None) for p, m, r in zip(plus, minus, g["atr"], strict=True)]
        dx = [100 * abs(p - m) / (p + m) if p is not None and p + m else None for p, m in di]
        return g.assign(plus_di=pd.Series([x[0] for x in di], dtype="float64"), minus_di=pd.Series([x[1] for x in di], dtype="float64"), adx=pd.Series(ewm(dx, a, window), dtype="float64"))

    return fold(directional_move(atr(b, by, ts, window), by, ts), by, ts, {"plus_di": "double", "minus_di": "double", "adx": "double"}, f)


def full_window(c: Column, column: str, n: int, w, offset: int = 0) -> Column:
    """An aggregate over the n rows that end ``offset`` rows before this one; null where there are fewer."""
    frame = w.rowsBetween(-(n - 1) - offset, -offset)
    return F.when(F.count(column).over(frame) == n, c.over(frame))


def bb_width(b: DataFrame, by: list[str], ts: str = "bar_ts", n: int = 20, k: float = 2.0) -> DataFrame:
    """Width of Bollinger bands over their middle."""
    w = ordered(by, ts)
    return b.withColumn("bb_width", safe_div(F.lit(2 * k) * full_window(F.stddev_samp("close"), "close", n, w), full_window(F.avg("close"), "close", n, w)))


def realized_vol(b: DataFrame, by: list[str], ts: str = "bar_ts", n: int = 20) -> DataFrame:
    """Annualised deviation of the last n returns."""
    w = ordered(by, ts)
    b = b.withColumn("ret", safe_div(F.col("close"), F.lag("close").over(w)) - 1)
    return b.withColumn("realized_vol", full_window(F.stddev_samp("ret"), "ret", n, w) * F.sqrt(F.lit(float(YEAR))))


def pct_rank_expanding(b: DataFrame, column: str, out: str, by: list[str], ts: str = "bar_ts", least: int = 60) -> DataFrame:
    """Share of all earlier rows (nulls in the count) whose value is smaller; null until ``least`` values.

    Counted by a fold with a sorted list: n log n for a series instead of a self join.
    """
    from bisect import bisect_left, insort

    def f(g: pd.DataFrame) -> pd.DataFrame:
        seen: list[float] = []
        ranks: list[float | None] = []
        for i, x in enumerate(g[column]):
            good = x is not None and x == x
            n = len(seen) + good
            ranks.append((bisect_left(seen, x) if good else 0) / i if n >= least and i else None)
            if good:
                insort(seen, x)
        return g.assign(**{out: pd.Series(ranks, dtype="float64")})

    return fold(b, by, ts, {out: "double"}, f)


def classify(value: Column, cut: float, high: str, low: str) -> Column:
    return F.when(value.isNull(), None).when(value > cut, high).otherwise(low)


def regime(b: DataFrame, by: list[str], ts: str = "bar_ts") -> DataFrame:
    """All indicators and the three labels of each day."""
    x = realized_vol(bb_width(adx(b, by, ts), by, ts), by, ts)
    # ranks of rounded values, so that the last bits of a long recursion decide nothing
    x = x.withColumns({"_a": F.round("atr", 3), "_b": F.round("bb_width", 9)})
    x = pct_rank_expanding(pct_rank_expanding(x, "_a", "atr_rank", by, ts), "_b", "bb_rank", by, ts).drop("_a", "_b")
    return x.withColumns({"trend_regime": classify(F.col("adx"), 25.0, "Trend", "Range"), "vol_regime": classify(F.col("atr_rank"), 0.5, "High Vol", "Low Vol"), "bb_regime": classify(F.col("bb_rank"), 0.5, "Expansion", "Compression")})


def shifted(b: DataFrame, columns: list[str], by: list[str], ts: str = "bar_ts", prefix: str = "") -> DataFrame:
    """The columns as of the previous row: what was known when the day began."""
    w = ordered(by, ts)
    return b.withColumns({prefix + c: F.lag(c).over(w) for c in columns})


def _alarms(threshold: float, drift: float, least: int, gap_us: float | None) -> Callable[[list[int], list[float]], list[bool]]:
    """One CUSUM that goes on from call to call: microseconds and values of the next rows, whether each is an alarm."""
    pos = neg = mean = m2 = 0.0
    n, last = 0, None

    def step(ts: list[int], values: list[float]) -> list[bool]:
        nonlocal pos, neg, mean, m2, n, last
        flags = []
        for t, x in zip(ts, values, strict=True):
            alarm = False
            if x == x:
                n += 1
                d = x - mean
                mean += d / n
                m2 += d * (x - mean)
                sd = (m2 / (n - 1)) ** 0.5 if n > 1 else 0.0
                if n >= least and sd > 0:
                    z = (x - mean) / sd
                    pos, neg = max(0.0, pos + z - drift), max(0.0, neg - z - drift)
                    if pos > threshold or neg > threshold:
                        pos = neg = 0.0
                        alarm = gap_us is None or last is None or t - last > gap_us
                        last = t if alarm else last
            flags.append(alarm)
        return flags

    return step


def cusum(b: DataFrame, column: str, by: list[str], ts: str = "bar_ts", threshold: float = 4.0, drift: float = 0.5, least: int = 20, shortest: int = 30, gap_days: float | None = None) -> DataFrame:
    """Alarm rows of a two-sided CUSUM against the expanding mean and deviation (this row included); both sums restart at an alarm.

    With ``gap_days`` an alarm is kept only if more days than that have passed since the last kept one.
    """

    def f(g: pd.DataFrame) -> pd.DataFrame:
        if int(g[column].notna().sum()) < shortest:
            return g.assign(alarm=False)
        step = _alarms(threshold, drift, least, None if gap_days is None else gap_days * 86400e6)
        return g.assign(alarm=step(g[ts].astype("datetime64[us]").astype("int64").tolist(), g[column].tolist()))

    return fold(b, by, ts, {"alarm": "boolean"}, f).where("alarm").drop("alarm")


def cusum_scan(b: DataFrame, column: str, order: list[str], threshold: float = 4.0, drift: float = 0.5, least: int = 20, shortest: int = 30, gap_days: float | None = None) -> DataFrame:
    """``cusum`` of one long series: a task sorts it by ``order``, a timestamp first, spilling, and goes through it batch by batch.

    The task holds a batch, whatever the length of the series.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, seen, held = _alarms(threshold, drift, least, None if gap_days is None else gap_days * 86400e6), 0, []
        for x in batches:
            v = x.column(column).to_numpy(zero_copy_only=False)
            found = x.filter(pa.array(step(x.column(order[0]).cast(pa.int64()).to_pylist(), v.tolist()), pa.bool_()))
            seen += int((v == v).sum())
            if found.num_rows:
                held.append(found)
            if seen >= shortest:  # a shorter series has no alarms
                yield from held
                held = []

    return b.repartition(1).sortWithinPartitions(*order).mapInArrow(run, b.schema)


def roll_hl(b: DataFrame, n: int, by: list[str], ts: str = "bar_ts") -> DataFrame:
    """Highest high and lowest low of the n rows before this one."""
    w = ordered(by, ts)
    return b.withColumn(f"hi_{n}", full_window(F.max("high"), "high", n, w, 1)).withColumn(f"lo_{n}", full_window(F.min("low"), "low", n, w, 1))


def avg_volume(b: DataFrame, n: int, by: list[str], ts: str = "bar_ts", parts: int = 1440) -> DataFrame:
    """Mean volume of the n rows before this one, for one of ``parts`` equal parts of the day."""
    return b.withColumn("avg_vol", full_window(F.avg("volume"), "volume", n, ordered(by, ts), 1) / parts)


def ffill(df: DataFrame, columns: list[str], ts: str = "date", rows: int = 5, by: list[str] | None = None) -> DataFrame:
    """Missing values take the last one of at most ``rows`` rows before."""
    w = ordered(by or [], ts).rowsBetween(-rows, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def change(df: DataFrame, columns: list[str], ts: str = "date", rows: int = 5, by: list[str] | None = None, suffix: str = "_chg") -> DataFrame:
    """Relative change against ``rows`` rows before; missing values first take the last known one."""
    w = ordered(by or [], ts)
    known = {c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in columns}
    df = df.withColumns({f"_{c}": x for c, x in known.items()})
    return df.withColumns({c + suffix: safe_div(F.col(f"_{c}"), F.lag(f"_{c}", rows).over(w)) - 1 for c in columns}).drop(*(f"_{c}" for c in columns))
