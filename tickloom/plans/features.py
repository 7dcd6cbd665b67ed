"""The feature table of positions: everything known of each, side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import intervals as J
from ..sources import fixtures as X
from ..sources.scratch import stored
from . import market as K
from .registry import Registry

R = Registry()

#: Digits that the single queries round to.
DIGITS = {"mom_5": 9, "mom_15": 9, "mom_30": 9, "pct_up_15": 6, "body_5": 6, "rr_setup": 11, "efficiency": 11, "left_r": 11, "left_usd": 11}
MORE = {"volume_ratio": 6, "speed_r": 11, "mfe_r": 11, "mae_r": 11}
_PARTS = ["feat_session", "date_parts", "feat_rr_setup", "feat_momentum", "feat_pct_up", "feat_body_wick", "feat_consecutive", "feat_prev_outcome", "exit_quality", "exit_efficiency", "left_on_table"]
_MORE = ["feat_volume_ratio", "feat_speed_30m", "feat_speed_bucket", "exc_mfe_mae"]


def _joined(parts: list[str]) -> str:
    return "SELECT * FROM " + " JOIN ".join(f"({K.R.oracles[p]}) {p}" + (" USING (id)" if i else "") for i, p in enumerate(parts))


def build(spark, sf):
    """One row a position: time, setup, the bars before it, the outcome of the position before, and how it was closed.

    Positions meet their own bars once and the bars before them once, for all features together.
    """
    h = X.bars_h1(spark, sf)
    s = stored(J.realized(X.trades(spark, sf), h))
    bars = J.streak(J.lookback(J.lookback(J.lookback(h, 5), 15), 30))
    x = J.asof_before(s, bars.withColumn("_tie", F.lit(0)), ["instrument"], "t0", "bar_ts", ["mom_5", "mom_15", "mom_30", "pct_up_15", "body_5", "streak_5", "vol_30"], "_tie")
    before = J.asof_before(s.select("id", "t0"), s.select(F.col("r").alias("pr"), "t1", F.col("id").alias("pid")), [], "t0", "t1", ["pr"], "pid")
    prev = F.when(F.col("pr").isNull(), "no_prior_trade").when(F.col("pr") > 0, "prev_win").otherwise("prev_loss")
    x = x.join(before.select("id", prev.alias("prev_outcome")), "id")
    hour = F.hour("t0")
    left = F.when(F.col("mfe_r").isNotNull(), F.greatest(F.col("mfe_r") - F.col("r"), F.lit(0.0)))
    return x.withColumns({
        "session": F.when(hour < 7, "asia").when(hour < 12, "london").when(hour < 16, "overlap").when(hour < 21, "new_york").otherwise("late"),
        "hr": hour.cast("long"), "yr": F.year("t0").cast("long"), "month": F.date_format("t0", "yyyy-MM"), "weekday": (F.weekday("t0") + 1).cast("long"), "day": F.date_trunc("day", "t0"),
        "rr_setup": I.safe_div(J.signed(F.col("target") - F.col("entry")), F.col("risk")), "quality": K.quality(F.col("r"), F.col("mfe_r")),
        "efficiency": F.when(F.col("mfe_r") > 0, F.col("r") / F.col("mfe_r")), "left_r": left, "left_usd": left * F.col("risk") * F.col("amount") / 100, "streak_5": F.col("streak_5").cast("long"),
    })


COLUMNS = ["id", "session", "hr", "yr", "month", "weekday", "day", "rr_setup", "mom_5", "mom_15", "mom_30", "pct_up_15", "body_5", "streak_5", "prev_outcome", "quality", "efficiency", "left_r", "left_usd"]


def _rounded(df, digits: dict[str, int]):
    return df.withColumns({c: F.round(c, d) + F.lit(0.0) for c, d in digits.items()})


@R.add("features_build", _joined(_PARTS))
def features_build(spark, sf):
    return _rounded(build(spark, sf).select(*COLUMNS), DIGITS)


@R.add("features_extended", _joined([*_PARTS, *_MORE]))
def features_extended(spark, sf):
    """The feature table with volume, speed and excursions."""
    h = X.bars_h1(spark, sf)
    x = build(spark, sf)
    days = h.groupBy("instrument", F.date_trunc("day", "bar_ts").alias("day")).agg(F.sum("volume").alias("volume"))
    days = I.avg_volume(days, 20, ["instrument"], "day", parts=24).select("instrument", "day", "avg_vol")
    x = x.join(days, ["instrument", "day"], "left").withColumn("volume_ratio", I.safe_div(F.col("vol_30"), F.col("avg_vol")))
    x = x.join(K._speed(spark, sf), "id")
    s = F.col("speed_r")
    x = x.withColumn("speed_bucket", F.when(s.isNull(), None).when(s <= 0.5, "slow").when(s <= 1.5, "medium").when(s <= 3, "fast").otherwise("very_fast"))
    return _rounded(x.select(*COLUMNS, "volume_ratio", "speed_r", "speed_bucket", "n_bars", "mfe_px", "mae_px", "mfe_r", "mae_r"), DIGITS | MORE)
