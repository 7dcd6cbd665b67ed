"""Joins of positions (intervals) with bars (instants), and as-of joins.

A range join as such would compare every position with every bar.  Here a position is exploded over the day buckets
its interval touches and joined on instrument and day, so both sides hash; the exact bounds are a filter after that.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import ordered as O


def interval_join(trades: DataFrame, bars: DataFrame, start: Column, end: Column, by: str = "instrument", ts: str = "bar_ts", how: str = "inner") -> DataFrame:
    """Every pair of a position and a bar of its instrument with start <= bar time <= end."""
    t = trades.withColumn("_s", start).withColumn("_e", end)
    t = t.withColumn("_day", F.explode(F.sequence(F.to_date("_s"), F.to_date("_e"))))
    b = bars.withColumn("_day", F.to_date(ts))
    return t.join(b, [by, "_day"], how).where(f"{ts} >= _s and {ts} <= _e").drop("_s", "_e", "_day")


def numbered(pairs: DataFrame, key: str = "id", ts: str = "bar_ts") -> DataFrame:
    """rn: the bar's place in its position, from 0."""
    return pairs.withColumn("rn", (F.row_number().over(Window.partitionBy(key).orderBy(ts)) - 1).cast("long"))


def windowed(trades: DataFrame, bars: DataFrame) -> DataFrame:
    return numbered(interval_join(trades, bars, F.col("t0"), F.col("t1")))


def signed(x: Column, side: str = "side") -> Column:
    return F.when(F.col(side) == "buy", x).otherwise(-x)


#: Positions of one instrument and day that are handled by one call.
GROUP_ROWS = 1 << 16
_DAY = 86_400_000_000


class Paths:
    """Positions of a group and the bars of their windows, a bar at a time; positions stand in falling order of their bars.

    Prices are doubles and null is NaN.  Those of a sale are negated, so every rule is written for a purchase alone.
    """

    def __init__(self, left: pa.Table, right: pa.Table):
        self._left = left
        at = right.column("_ts").to_numpy()
        order = np.argsort(at, kind="stable")
        self.times = at[order]
        raw = {c: right.column(c).to_numpy(zero_copy_only=False)[order] for c in ("open", "high", "low", "close")}
        self._prices = {"adverse": np.append(raw["low"], -raw["high"]), "favour": np.append(raw["high"], -raw["low"]), "open": np.append(raw["open"], -raw["open"]), "close": np.append(raw["close"], -raw["close"])}
        s, e = (left.column(c).to_numpy(zero_copy_only=False) for c in ("_s", "_e"))
        lo = np.searchsorted(self.times, s, "left")
        n = np.where(np.isnan(s.astype(float)) | np.isnan(e.astype(float)), 0, np.maximum(np.searchsorted(self.times, e, "right") - lo, 0))
        self.order = np.argsort(-n, kind="stable")
        self.first, self.bars = lo[self.order], n[self.order]
        self.buy = pc.fill_null(pc.equal(left.column("side"), "buy"), False).to_numpy()[self.order]
        self.sign = np.where(self.buy, 1.0, -1.0)
        self._shift = np.where(self.buy, 0, len(at)) + self.first

    def number(self, column: str) -> np.ndarray:
        return self._left.column(column).cast(pa.float64()).to_numpy()[self.order]

    def steps(self):
        """(k, m): the k-th bar of the first m positions; the others have no such bar."""
        for k in range(int(self.bars[0]) if len(self.bars) else 0):
            yield k, int(np.searchsorted(-self.bars, -k, "left"))

    def price(self, name: str, k: int, m: int) -> np.ndarray:
        return self._prices[name][self._shift[:m] + k]

    def time(self, k: int, m: int) -> np.ndarray:
        return self.times[self.first[:m] + k]


def over_bars(trades: DataFrame, bars: DataFrame, start: Column, end: Column, fold: Callable[[Paths], dict[str, np.ndarray]], columns: list[str], by: str = "instrument", ts: str = "bar_ts", key: str = "id") -> DataFrame:
    """trades with the columns (doubles, NaN is null) that ``fold`` makes of the bars with start <= bar time <= end.

    Pairs of positions and bars are never rows: positions of one instrument and start day, in parts of about GROUP_ROWS, meet
    the bars of the days they reach once, and are folded bar by bar.  Only positions are shuffled, whatever their length.
    """
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    day = lambda c: F.floor(c / F.lit(_DAY)).cast("long")
    t = trades.withColumns({"_s": micros(start), "_e": micros(end)}).withColumn("_day", day(F.col("_s")))
    need = stored(t.groupBy(by, "_day").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("long").alias("_parts"), F.greatest(day(F.max("_e")), F.col("_day")).alias("_last")), "reach")
    t = t.join(F.broadcast(need.select(by, "_day", "_parts")), [by, "_day"], "left")  # a row for each instrument and day
    t = t.withColumn("_part", F.pmod(F.xxhash64(key), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    prices = [F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")]
    b = need.withColumn("_bar_day", F.explode(F.sequence("_day", "_last"))).join(bars.select(by, micros(F.col(ts)).alias("_ts"), *prices).withColumn("_bar_day", day(F.col("_ts"))), [by, "_bar_day"])
    b = b.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(by, "_day", F.col("_part").cast("long").alias("_part"), "_ts", "open", "high", "low", "close")
    names = trades.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        p = Paths(left, right)
        out = left.select(names)
        for c, v in fold(p).items():
            whole = np.empty(len(v))
            whole[p.order] = v
            out = out.append_column(c, pa.array(whole, from_pandas=True))
        return out

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in trades.schema), *(f"`{c}` double" for c in columns)])
    keys = [by, "_day", "_part"]
    return t.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(run, schema)


def _extremes(p: Paths) -> dict[str, np.ndarray]:
    size = len(p.bars)
    best, worst, best_at, worst_at, last = (np.full(size, v) for v in (-np.inf, -np.inf, np.nan, np.nan, np.nan))
    for k, m in p.steps():
        for now, high, at in ((p.price("favour", k, m), best, best_at), (-p.price("adverse", k, m), worst, worst_at)):
            more = now > high[:m]
            high[:m][more], at[:m][more] = now[more], k
        ends = p.bars[:m] == k + 1
        last[:m][ends] = (p.price("close", k, m) * p.sign[:m])[ends]
    none = np.isinf(best), np.isinf(worst)
    return {"_b": np.where(none[0], np.nan, best), "_w": np.where(none[1], np.nan, worst), "_b_rn": best_at, "_w_rn": worst_at, "_n": p.bars.astype(float), "_last": last}


def _excursions(trades: DataFrame, bars: DataFrame) -> DataFrame:
    x = over_bars(trades, bars, F.col("t0"), F.col("t1"), _extremes, ["_b", "_w", "_b_rn", "_w_rn", "_n", "_last"])
    kind = bars.schema["high"].dataType
    x = x.withColumns({"n_bars": F.col("_n").cast("long"), "b": F.col("_b").cast(kind), "w": F.col("_w").cast(kind), "last_close": F.col("_last").cast(bars.schema["close"].dataType)})
    buy = F.col("side") == "buy"
    last = F.greatest(F.col("n_bars") - 1, F.lit(1))
    return x.select(
        *trades.columns, "n_bars", F.when(buy, F.col("b")).otherwise(-F.col("b")).alias("mfe_px"), F.when(buy, -F.col("w")).otherwise(F.col("w")).alias("mae_px"),
        (F.when(buy, F.col("b") - F.col("entry")).otherwise(F.col("entry") + F.col("b")) / F.nullif("risk", F.lit(0))).alias("mfe_r"),
        (F.when(buy, F.col("entry") + F.col("w")).otherwise(F.col("w") - F.col("entry")) / F.nullif("risk", F.lit(0))).alias("mae_r"),
        (F.col("_b_rn") / last).alias("mfe_frac"), (F.col("_w_rn") / last).alias("mae_frac"), "last_close",
    )


def excursions(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Best and worst price and R of each position, bars seen, and when the first best and worst came (share of the way)."""
    return _excursions(trades, bars).drop("last_close")


def realized(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Positions closed at their window's last close, or at entry where there is no bar; with R, best and worst R."""
    x = _excursions(trades, bars).withColumn("exit_px", F.coalesce("last_close", "entry"))
    return x.withColumn("r", signed(F.col("exit_px") - F.col("entry")) / F.nullif("risk", F.lit(0))).drop("last_close")


def latest_bar(trades: DataFrame, bars: DataFrame, columns: list[str], unit: int = 3600, by: str = "instrument", at: str = "t0", ts: str = "bar_ts") -> DataFrame:
    """trades with the columns of the last bar before their start, where bars begin at whole units (seconds).

    All positions of one unit have the same bar, so it is looked up once for each instrument and unit; that table is no larger than
    that of the bars' units, and is joined to the positions without a sort of them.
    """
    after = (-F.floor(-F.unix_micros(F.col(at).cast("timestamp")) / F.lit(unit * 1_000_000))).cast("long")
    t = trades.withColumn("_after", after)
    cells = t.select(by, "_after").distinct()
    b = bars.withColumn("_at", (F.unix_seconds(F.col(ts).cast("timestamp")) / unit).cast("long")).withColumn("_tie", F.lit(0))
    found = asof_before(cells, b, [by], "_after", "_at", columns, "_tie")
    return t.join(F.broadcast(found), [by, "_after"], "left").select(*trades.columns, *columns)


def lookback(bars: DataFrame, n: int, by: str = "instrument", ts: str = "bar_ts") -> DataFrame:
    """For each bar, features of the n bars that end with it; null where there are fewer."""
    w = Window.partitionBy(by).orderBy(ts)
    f = w.rowsBetween(-(n - 1), 0)
    full = F.count("*").over(f) == n
    body = F.abs(F.col("close") - F.col("open")) / F.nullif((F.col("high") - F.col("low")).cast("double"), F.lit(0.0))
    first_open = F.first("open").over(f)
    return bars.withColumns({
        f"mom_{n}": F.when(full, (F.col("close") - first_open) / F.nullif(first_open, F.lit(0))),
        f"pct_up_{n}": F.when(full, F.avg((F.col("close") > F.col("open")).cast("int")).over(f)),
        f"vol_{n}": F.when(full, F.avg("volume").over(f)),
        f"body_{n}": F.when(full, F.avg(body).over(f)),
    })


def streak(bars: DataFrame, n: int = 5, by: str = "instrument", ts: str = "bar_ts") -> DataFrame:
    """Bars of one direction that end with each bar, at most n; 0 after a bar without direction."""
    w = Window.partitionBy(by).orderBy(ts)
    d = F.signum(F.col("close") - F.col("open")).cast("int")
    b = bars.withColumn("_d", d)
    out = F.lit(n)
    for i in range(n - 1, 0, -1):
        out = F.when(F.coalesce(F.lag("_d", i).over(w), F.lit(9)) != F.col("_d"), F.lit(i)).otherwise(out)
    return b.withColumn(f"streak_{n}", F.when(F.col("_d") == 0, 0).otherwise(out)).drop("_d")


def window_extremes(trades: DataFrame, bars: DataFrame, start: Column, end: Column, unit: int = 3600, levels: int = 11, key: str = "id", by: str = "instrument", ts: str = "bar_ts") -> DataFrame:
    """(key, last, h, l): last close, highest high and lowest low of the bars with start <= bar time <= end; no row without bars.

    Bars are rolled up into spans of 1, 2, 4, ... 2 ** (levels - 1) units.  A window is put together from the spans that tile it,
    at most two a level, so a position meets a number of rows logarithmic in its window in place of all its bars (a window
    longer than the top level's span also takes as many of those as it holds).  Bars begin at whole units (seconds).
    """
    seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
    at = F.floor(seconds / unit).cast("long")
    b = bars.select(by, F.col(ts).alias("_ts"), "high", "low", "close", F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda j: F.struct(j.alias("j"), F.floor(at / F.pow(F.lit(2), j)).cast("long").alias("b")))).alias("_s"))
    spans = b.groupBy(by, F.col("_s.j").alias("_j"), F.col("_s.b").alias("_b")).agg(F.max("high").alias("h"), F.min("low").alias("l"), F.max(F.struct("_ts", "close")).alias("c"))
    # half-open range of units; bounds at level j are both divided by 2 ** j, the lower rounded up
    micros = unit * 1_000_000
    t = trades.select(key, by, (-F.floor(-F.unix_micros(start.cast("timestamp")) / micros)).cast("long").alias("_from"), (F.floor(F.unix_micros(end.cast("timestamp")) / micros) + 1).cast("long").alias("_to"))

    def tiles(j: Column) -> Column:
        size = F.pow(F.lit(2), j)
        lo, hi = (-F.floor(-F.col("_from") / size)).cast("long"), F.floor(F.col("_to") / size).cast("long")
        left, right = F.when((lo % 2 != 0) & (lo < hi), F.array(lo)), F.when((hi % 2 != 0) & (lo < hi), F.array(hi - 1))
        none = F.array().cast("array<bigint>")
        whole = F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(none)
        some = F.concat(F.coalesce(left, none), F.coalesce(right, none))
        return F.transform(F.when(j == levels - 1, whole).otherwise(some), lambda x: F.struct(j.alias("j"), x.alias("b")))

    t = t.withColumn("_s", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), tiles)))).select(key, by, F.col("_s.j").alias("_j"), F.col("_s.b").alias("_b"))
    x = t.join(spans, [by, "_j", "_b"])
    return x.groupBy(key).agg(F.max("c")["close"].alias("last"), F.max("h").alias("h"), F.min("l").alias("l"))


def asof_before(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, columns: list[str], tie: str, strict: bool = True) -> DataFrame:
    """For each left row the columns of the last right row before it (or at it), by a tagged union and one window: no theta join.  Without keys the window runs over range pieces."""
    sign = 1 if strict else -1
    keys = [F.col(k) for k in by]
    struct = F.struct(*columns)
    marks = right.select(*keys, F.col(right_ts).alias("_ts"), F.lit(0 if not strict else 1).alias("_tag"), F.col(tie).cast("long").alias("_tie"), struct.alias("_v"), F.lit(None).cast(left.schema.simpleString()).alias("_l"))
    rows = left.select(*keys, F.col(left_ts).alias("_ts"), F.lit(0 if sign > 0 else 1).alias("_tag"), F.lit(0).cast("long").alias("_tie"), F.lit(None).cast(marks.schema["_v"].dataType).alias("_v"), F.struct(*left.columns).alias("_l"))
    order = ["_ts", "_tag", "_tie"]
    u = marks.unionByName(rows)
    if by:
        u = u.withColumn("_found", F.last("_v", ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    else:
        u = O.last_before(O.dealt(u, order), "_v", order, "_found")
    return u.where("_l is not null").select("_l.*", *(F.col("_found")[c].alias(c) for c in columns))
