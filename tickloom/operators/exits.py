"""Exit rules as declarative plans over (position, bar) pairs.

No rule depends on its own past decisions, only on a running extreme of the prices before the current bar.  So each is
a trigger predicate over the bars of a position, and the first bar that meets it.  All rules are followed side by side, bar by
bar, for all positions of a group at once; a rule that never triggers leaves the actual R.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import Paths, interval_join, numbered, over_bars, signed, window_extremes

TRAILS = (0.01, 0.02, 0.03, 0.05, 0.08, 0.10, 0.15, 0.20)
ACTIVATION = 0.15


def r_of(price: Column) -> Column:
    return signed(price - F.col("entry")) / F.nullif(F.col("risk"), F.lit(0))


def touches_stop(level: Column) -> Column:
    return F.when(F.col("side") == "buy", F.col("low") <= level).otherwise(F.col("high") >= level)


def touches_target(level: Column) -> Column:
    return F.when(F.col("side") == "buy", F.col("high") >= level).otherwise(F.col("low") <= level)


def stop_fill(level: Column) -> Column:
    """The stop level, or the bar's open where it is beyond it already."""
    return F.when(F.col("side") == "buy", F.least(level, F.col("open").cast("double"))).otherwise(F.greatest(level, F.col("open").cast("double")))


@dataclass
class Bar:
    """One bar of each of m positions (prices of sales negated, null is NaN); peak: best price before this bar, at least the entry."""

    entry: np.ndarray
    risk: np.ndarray
    stop: np.ndarray
    target: np.ndarray
    peak: np.ndarray
    gain_r: np.ndarray
    open: np.ndarray
    adverse: np.ndarray
    favour: np.ndarray
    close: np.ndarray
    time: np.ndarray
    first: np.ndarray


#: Which positions the bar takes out, and the price that those of some numbers then get.
Rule = Callable[[Bar], tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]]


def _stopped(b: Bar, level: np.ndarray):
    """At the level, or at the bar's open where it is beyond it already."""
    return b.adverse <= level, lambda i: np.fmin(level[i], b.open[i])


def trailing(pct: float) -> Rule:
    """Once active, the peak less a share of its way from the entry, never worse than the stop; else the stop."""

    def rule(b: Bar):
        return _stopped(b, np.where(b.gain_r >= ACTIVATION, np.fmax(b.stop, b.peak - pct * (b.peak - b.entry)), b.stop))

    return rule


def mfe_aware() -> Rule:
    """The trail narrows with the gain: 10 % from 1 R, 2 % from 5 R."""

    def rule(b: Bar):
        pct = np.where(b.gain_r >= 5, 0.02, 0.10)
        return _stopped(b, np.where(b.gain_r >= 1, np.fmax(b.stop, b.peak - pct * (b.peak - b.entry)), b.stop))

    return rule


def target_level(b: Bar, multiple: float | None) -> np.ndarray:
    return b.target if multiple is None else b.entry + b.risk * multiple


def fixed_target(multiple: float | None = None, gap_fill: bool = True) -> Rule:
    """Target or stop, whichever a bar touches first; the target wins a bar that touches both."""

    def rule(b: Bar):
        level = target_level(b, multiple)
        hit = b.favour >= level
        out, fill = _stopped(b, b.stop)
        return hit | out, lambda i: np.where(hit[i], level[i], fill(i) if gap_fill else b.stop[i])

    return rule


def timed(hours: int) -> Rule:
    """Close of the first bar so many hours after the first bar; the stop comes first."""

    def rule(b: Bar):
        out, fill = _stopped(b, b.stop)
        return out | (b.time >= b.first + hours * 3_600_000_000), lambda i: np.where(out[i], fill(i), b.close[i])

    return rule


def rules() -> dict[str, Rule]:
    out = {f"trail_{p:.2f}": trailing(p) for p in TRAILS}
    out |= {"target": fixed_target(), "mfe_aware": mfe_aware()}
    out |= {f"fixed_{m}r": fixed_target(float(m)) for m in (2, 3, 4)}
    return out | {f"time_{h}h": timed(h) for h in (1, 2, 4, 8)}


LEGS = ((0.5, 2.0), (0.3, 4.0), (0.2, None))


def _follow(chosen: list[Rule], partial: bool) -> Callable[[Paths], dict[str, np.ndarray]]:
    """R of the exit by each rule, within the position's own window (c) and within the extended one (a); NaN where it never triggers."""

    def fold(p: Paths) -> dict[str, np.ndarray]:
        size = len(p.bars)
        entry, stop, target = (p.number(c) * p.sign for c in ("entry", "stop", "target"))
        risk, own_end = p.number("risk"), p.number("_own")
        risk = np.where(risk == 0, np.nan, risk)
        peak, first = entry.copy(), np.zeros(size, np.int64)
        hit, own_hit = np.full((len(chosen), size), np.nan), np.full((len(chosen), size), np.nan)
        waits = np.ones((len(chosen), size), bool)
        never = np.iinfo(np.int64).max
        # places of the first stop and of each leg's first touch, in both scopes, and the stop's R
        places, stop_r = np.full((2, 1 + len(LEGS), size), never), np.full((2, size), np.nan)
        for k, m in p.steps():
            t = p.time(k, m)
            if k == 0:
                first[:m] = t
            b = Bar(entry[:m], risk[:m], stop[:m], target[:m], peak[:m], (peak[:m] - entry[:m]) / risk[:m], *(p.price(c, k, m) for c in ("open", "adverse", "favour", "close")), t, first[:m])
            own = t <= own_end[:m]
            for j, rule in enumerate(chosen):
                out, fill = rule(b)
                i = np.flatnonzero(out & waits[j, :m])
                if len(i):
                    hit[j, i] = (fill(i) - b.entry[i]) / b.risk[i]
                    own_hit[j, i] = np.where(own[i], hit[j, i], np.nan)
                    waits[j, i] = False
            if partial:
                out, fill = _stopped(b, b.stop)
                touched = [out, *(b.favour >= target_level(b, x) for _, x in LEGS)]
                for sc, scope in enumerate((own, np.ones(m, bool))):
                    for q, x in enumerate(touched):
                        i = np.flatnonzero(x & scope & (places[sc, q, :m] == never))
                        places[sc, q, i] = k
                        if q == 0:
                            stop_r[sc, i] = (fill(i) - b.entry[i]) / b.risk[i]
            peak[:m] = np.fmax(b.peak, b.favour)
        out = {}
        for j in range(len(chosen)):
            out[f"c{j}"], out[f"a{j}"] = own_hit[j], hit[j]
        if partial:
            whole = Bar(entry, risk, stop, target, *(None,) * 8)
            for sc, name in enumerate("ca"):
                rest = np.where(np.isnan(stop_r[sc]), p.number("r"), stop_r[sc])
                parts = [share * np.where((places[sc, 1 + q] < never) & (places[sc, 1 + q] < places[sc, 0]), (target_level(whole, x) - entry) / risk, rest) for q, (share, x) in enumerate(LEGS)]
                out[f"{name}{len(chosen)}"] = np.where((places[sc] < never).any(axis=0), parts[0] + parts[1] + parts[2], np.nan)
        return out

    return fold


def exits(trades: DataFrame, bars: DataFrame, chosen: dict[str, Rule], partial: bool = False, extension_hours: int = 72) -> DataFrame:
    """trades with the R of the exit by the j-th rule in column c{j} (within the position's own window) and a{j} (with it extended).

    Null where a rule never triggers.  With ``partial`` the partial rule comes last.  All rules and both windows are followed
    in one pass over the bars of each position; a row stays one position, whatever the number of rules.
    """
    n = len(chosen) + partial
    t = trades.withColumn("_own", F.unix_micros(F.col("t1").cast("timestamp")))
    return over_bars(t, bars, F.col("t0"), F.col("t1") + F.make_dt_interval(hours=F.lit(extension_hours)), _follow(list(chosen.values()), partial), [f"{s}{j}" for j in range(n) for s in "ca"]).drop("_own")


def simulate(trades: DataFrame, bars: DataFrame, chosen: dict[str, Rule] | None = None, partial: bool = True, extension_hours: int = 72) -> DataFrame:
    """(id, t0, amount, risk, orig_r, strategy, scenario, exit_r, triggered): every rule within the position's own window
    (conservative) and with it extended (aggressive).  A rule that never triggers leaves the actual R."""
    chosen = rules() if chosen is None else chosen
    x = exits(trades, bars, chosen, partial, extension_hours)
    results = [F.struct(F.lit(n).alias("strategy"), F.lit(sc).alias("scenario"), F.col(f"{sc[0]}{j}").alias("hit_r")) for j, n in enumerate([*chosen, *(["partial"] if partial else [])]) for sc in ("conservative", "aggressive")]
    x = x.select("id", "t0", "amount", "risk", "r", F.explode(F.array(*results)).alias("_x"))
    hit = F.col("_x.hit_r")
    return x.select("id", "t0", "amount", "risk", F.col("r").alias("orig_r"), "_x.strategy", "_x.scenario", F.coalesce(hit, F.col("r")).alias("exit_r"), hit.isNotNull().alias("triggered"))


def no_stop(trades: DataFrame, bars: DataFrame, days: int = 30) -> DataFrame:
    """Ride every position for so many days without a stop: final, best and worst R (extremes not inside of the entry), and whether the bars end before."""
    end = F.col("t0") + F.make_dt_interval(days=F.lit(days))
    buy = F.col("side") == "buy"
    g = window_extremes(trades, bars, F.col("t0"), end)
    last_bar = bars.groupBy("instrument").agg(F.max("bar_ts").alias("data_end"))
    x = trades.join(g, "id", "left").join(F.broadcast(last_bar), "instrument", "left")
    best = F.when(buy, F.greatest(F.col("h"), F.col("entry"))).otherwise(F.least(F.col("l"), F.col("entry")))
    worst = F.when(buy, F.least(F.col("l"), F.col("entry"))).otherwise(F.greatest(F.col("h"), F.col("entry")))
    x = x.withColumns({"final_r": r_of(F.col("last")), "best_r": F.when(F.col("last").isNotNull(), r_of(best)), "worst_r": F.when(F.col("last").isNotNull(), r_of(worst)), "censored": end > F.col("data_end")})
    return x.select("id", "t0", "amount", F.col("r").alias("orig_r"), "final_r", "best_r", "worst_r", "censored", (F.col("worst_r") <= -3).alias("catastrophic"))


def end_of_day(trades: DataFrame, bars: DataFrame, hour: int = 16, zone: str = "America/New_York") -> DataFrame:
    """Target or stop (at its level) until the hour of the same local day, else the last close; without a bar no result."""
    local = F.from_utc_timestamp("t0", zone)
    deadline = F.to_utc_timestamp(F.date_trunc("day", local) + F.make_dt_interval(hours=F.lit(hour)), zone)
    t = trades.withColumn("deadline", F.greatest(deadline, F.col("t0")))
    p = numbered(interval_join(t, bars, F.col("t0"), F.col("deadline")))
    stop, target = F.col("stop").cast("double"), F.col("target").cast("double")
    hit, out = touches_target(target), touches_stop(stop)
    f = p.where(hit | out).groupBy("id").agg(F.min_by(F.when(hit, target).otherwise(stop), "rn").alias("px"), F.min_by(F.when(hit, "target").otherwise("stop"), "rn").alias("why"))
    last = p.groupBy("id").agg(F.max_by("close", "rn").alias("last"))
    x = t.join(last, "id", "left").join(f, "id", "left")
    return x.select("id", "t0", F.col("r").alias("orig_r"), r_of(F.coalesce("px", F.col("last").cast("double"))).alias("exit_r"), F.when(F.col("last").isNull(), "no_data").otherwise(F.coalesce("why", F.lit("eod_forced"))).alias("reason"))


def _resolved(p: Paths) -> dict[str, np.ndarray]:
    stop, target = p.number("stop") * p.sign, p.number("target") * p.sign
    tie = np.full(len(p.bars), np.nan)
    for k, m in p.steps():
        hit, out = p.price("favour", k, m) >= target[:m], p.price("adverse", k, m) <= stop[:m]
        i = np.flatnonzero((hit | out) & np.isnan(tie[:m]))
        tie[i] = (hit & out)[i]
    return {"tie": tie}


def tied(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """trades with tie: whether the first bar that resolves the position touches target and stop."""
    x = over_bars(trades, bars, F.col("t0"), F.col("t1"), _resolved, ["tie"])
    return x.withColumn("tie", F.coalesce(F.col("tie") == 1, F.lit(False)))


def track(pairs: DataFrame, trades: DataFrame, as_of: Column) -> DataFrame:
    """State of each position at an instant: closed at target or stop, still open, or no bar yet."""
    p = pairs.where(F.col("bar_ts") <= as_of)
    hit, out = touches_target(F.col("target").cast("double")), touches_stop(F.col("stop").cast("double"))
    f = p.groupBy("id").agg(F.min_by(F.when(hit, "closed_at_target").when(out, "closed_at_stop"), F.when(hit | out, F.col("rn"))).alias("state"), F.count("*").alias("n"))
    return trades.where(F.col("t0") <= as_of).join(f, "id", "left").select("id", F.when(F.col("n").isNull(), "no_candle_data_yet").otherwise(F.coalesce("state", F.lit("still_open"))).alias("state"))
