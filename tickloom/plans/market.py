"""Queries over bars and positions: profiling, indicators, interval joins and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import indicators as I
from ..operators import intervals as J
from ..sources import fixtures as X
from .registry import Registry

R = Registry()
TRADE = "id, instrument, t0, t1, side, entry, risk, stop, target, amount"


# Profiling


@R.add("profile_range", "SELECT (SELECT count(*) FROM trades) AS n_trades, (SELECT count(*) FROM bars_h1) AS n_bars, (SELECT min(t0) FROM trades) AS first_start, (SELECT max(t1) FROM trades) AS last_end, (SELECT min(bar_ts) FROM bars_h1) AS first_bar, (SELECT max(bar_ts) FROM bars_h1) AS last_bar, (SELECT min(bar_ts) FROM bars_h1) <= (SELECT min(t0) FROM trades) AND (SELECT max(bar_ts) FROM bars_h1) >= (SELECT max(t1) FROM trades) AS covered", ("trades", "bars_h1"))
def profile_range(spark, sf):
    t = X.trades(spark, sf).agg(F.count("*").alias("n_trades"), F.min("t0").alias("first_start"), F.max("t1").alias("last_end"))
    b = X.bars_h1(spark, sf).agg(F.count("*").alias("n_bars"), F.min("bar_ts").alias("first_bar"), F.max("bar_ts").alias("last_bar"))
    return t.crossJoin(b).select("n_trades", "n_bars", "first_start", "last_end", "first_bar", "last_bar", ((F.col("first_bar") <= F.col("first_start")) & (F.col("last_bar") >= F.col("last_end"))).alias("covered"))


@R.add("profile_gaps", "SELECT instrument, count(*) AS n_gaps FROM (SELECT instrument, bar_ts - lag(bar_ts) OVER (PARTITION BY instrument ORDER BY bar_ts) AS d FROM bars_h1) WHERE d > INTERVAL 1 HOUR GROUP BY instrument", ("bars_h1",))
def profile_gaps(spark, sf):
    gap = F.unix_micros("bar_ts") - F.lag(F.unix_micros("bar_ts")).over(I.ordered(["instrument"]))
    return X.bars_h1(spark, sf).withColumn("gap", gap).where("gap > 3600000000").groupBy("instrument").agg(F.count("*").alias("n_gaps"))


@R.add("profile_dups", "SELECT l_returnflag, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_dups FROM lineitem GROUP BY 1")
def profile_dups(spark, sf):
    return X.load(spark, sf, "lineitem").groupBy("l_returnflag").agg((F.count("*") - F.count_distinct("l_orderkey", "l_linenumber")).alias("n_dups"))


@R.add("profile_nulls", "SELECT unnest(['a', 'n', 'r']) AS name, unnest([count(*) - count(a), count(*) - count(n), count(*) - count(r)]) AS n_null FROM macro", ("macro",))
def profile_nulls(spark, sf):
    m = X.macro(spark, sf)
    return m.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in "anr")).selectExpr("stack(3, 'a', a, 'n', n, 'r', r) AS (name, n_null)")


@R.add("value_counts", "SELECT side, instrument, count(*) AS n FROM trades GROUP BY ALL", ("trades",))
def value_counts(spark, sf):
    return X.trades(spark, sf).groupBy("side", "instrument").agg(F.count("*").alias("n"))


# Bars and indicators

_D = "bar_ts, open, high, low, close, volume"


@R.add("resample_ohlcv", "SELECT instrument, date_trunc('day', bar_ts) AS bar_ts, arg_min(open, bar_ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_ts) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM bars_h1 GROUP BY 1, 2", ("bars_h1",))
def resample_ohlcv(spark, sf):
    h = X.bars_h1(spark, sf)
    return h.groupBy("instrument", F.date_trunc("day", "bar_ts").alias("day")).agg(F.min_by("open", "bar_ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_ts").alias("close"), F.sum("volume").alias("volume")).withColumnRenamed("day", "bar_ts")


_TR = f"SELECT {_D}, greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)) AS tr, row_number() OVER o AS k FROM bars_d1 WINDOW o AS (ORDER BY bar_ts)"


@R.add("ind_true_range", f"SELECT {_D}, tr FROM ({_TR})", ("bars_d1",))
def ind_true_range(spark, sf):
    return I.true_range(X.bars_d1(spark, sf), [])


def _ewm(x: str, k: str = "k", a: str = "1.0/14") -> str:
    """Closed form of the exponential mean: decaying powers around each row, for long tables in blocks."""
    return f"(power(1-{a}, {k}-1) * first_value({x}) OVER (ORDER BY {k}) + sum(CASE WHEN {k} > 1 THEN {a} * {x} * power(1-{a}, -({k}-1)) ELSE 0 END) OVER (ORDER BY {k}) * power(1-{a}, {k}-1))"


_ATR = f"SELECT *, CASE WHEN k >= 14 THEN {_ewm('tr')} END AS atr FROM ({_TR})"


@R.add("ind_atr", f"SELECT bar_ts, tr, atr FROM ({_ATR})", ("bars_d1",), doubles="atr", digits=3)
def ind_atr(spark, sf):
    return I.atr(X.bars_d1(spark, sf), []).select("bar_ts", "tr", "atr")


_DM = "SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS plus_dm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS minus_dm FROM (SELECT *, coalesce(high - lag(high) OVER (ORDER BY bar_ts), 0) AS up, coalesce(lag(low) OVER (ORDER BY bar_ts) - low, 0) AS dn FROM ({}))"


@R.add("ind_dm", f"SELECT {_D}, plus_dm, minus_dm FROM ({_DM.format('SELECT * FROM bars_d1')})", ("bars_d1",))
def ind_dm(spark, sf):
    return I.directional_move(X.bars_d1(spark, sf), [])


_DI = f"SELECT *, 100 * {_ewm('plus_dm')} / atr AS plus_di, 100 * {_ewm('minus_dm')} / atr AS minus_di FROM ({_DM.format(_ATR)})"
_ADX = f"SELECT bar_ts, plus_di, minus_di, CASE WHEN j >= 14 THEN {_ewm('dx', 'j')} END AS adx FROM (SELECT *, 100 * abs(plus_di - minus_di) / (plus_di + minus_di) AS dx, k - 13 AS j FROM ({_DI})) WHERE j >= 1"


@R.add("ind_adx", _ADX, ("bars_d1",), doubles="plus_di minus_di adx", digits=4)
def ind_adx(spark, sf):
    return I.adx(X.bars_d1(spark, sf), []).where("atr is not null").select("bar_ts", "plus_di", "minus_di", "adx")


_BB = "SELECT *, CASE WHEN count(close) OVER w = 20 THEN 4 * stddev_samp(close) OVER w / avg(close) OVER w END AS bb_width FROM ({}) WINDOW w AS (ORDER BY bar_ts ROWS 19 PRECEDING)"


@R.add("ind_bb_width", f"SELECT bar_ts, bb_width FROM ({_BB.format('SELECT * FROM bars_d1')})", ("bars_d1",), doubles="bb_width")
def ind_bb_width(spark, sf):
    return I.bb_width(X.bars_d1(spark, sf), []).select("bar_ts", "bb_width")


_RV = "SELECT *, CASE WHEN count(ret) OVER (ORDER BY bar_ts ROWS 19 PRECEDING) = 20 THEN stddev_samp(ret) OVER (ORDER BY bar_ts ROWS 19 PRECEDING) * sqrt(252) END AS realized_vol FROM (SELECT *, close::DOUBLE / lag(close) OVER (ORDER BY bar_ts) - 1 AS ret FROM bars_d1)"


@R.add("ind_realized_vol", f"SELECT bar_ts, realized_vol FROM ({_RV})", ("bars_d1",), doubles="realized_vol")
def ind_realized_vol(spark, sf):
    return I.realized_vol(X.bars_d1(spark, sf), []).select("bar_ts", "realized_vol")


@R.add("ind_pct_rank_expanding", f"SELECT c.bar_ts, CASE WHEN n >= 60 THEN (SELECT count(*) FROM v p WHERE p.k < c.k AND p.bb_width < c.bb_width)::DOUBLE / (k - 1) END AS bb_rank FROM (SELECT *, count(bb_width) OVER (ORDER BY k) AS n FROM v) c", ("bars_d1",), doubles="bb_rank")
def ind_pct_rank_expanding(spark, sf):
    return I.pct_rank_expanding(I.bb_width(X.bars_d1(spark, sf), []), "bb_width", "bb_rank", []).select("bar_ts", "bb_rank")


R.oracles["ind_pct_rank_expanding"] = R.oracles["ind_pct_rank_expanding"].replace("SELECT * REPLACE", f", v AS (SELECT bar_ts, round(bb_width, 12) AS bb_width, row_number() OVER (ORDER BY bar_ts) AS k FROM ({_BB.format('SELECT * FROM bars_d1')}))\nSELECT * REPLACE", 1)


def ranked(src: str, x: str, key: str = "bar_ts") -> str:
    """Twin of the expanding rank of column x of src: the share of earlier rows with a smaller value, null under 60 values."""
    return f"(WITH v AS MATERIALIZED (SELECT {key}, {x} AS x, row_number() OVER (ORDER BY {key}) AS k, count({x}) OVER (ORDER BY {key}) AS n FROM {src}) SELECT {key}, CASE WHEN n >= 60 AND k > 1 THEN (SELECT count(*) FROM v p WHERE p.k < c.k AND p.x < c.x)::DOUBLE / (k - 1) END AS rank FROM v c)"


def _label(x: str, cut: float, high: str, low: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} > {cut} THEN '{high}' ELSE '{low}' END"


_REGIME = f"""(SELECT t.bar_ts, adx, t.atr, ra.rank AS atr_rank, bb_width, rb.rank AS bb_rank, realized_vol, {_label('adx', 25, 'Trend', 'Range')} AS trend_regime, {_label('ra.rank', 0.5, 'High Vol', 'Low Vol')} AS vol_regime, {_label('rb.rank', 0.5, 'Expansion', 'Compression')} AS bb_regime
 FROM ({_ATR}) t LEFT JOIN ({_ADX}) a USING (bar_ts) JOIN (SELECT bar_ts, bb_width FROM ({_BB.format('SELECT * FROM bars_d1')})) USING (bar_ts) JOIN (SELECT bar_ts, realized_vol FROM ({_RV})) USING (bar_ts)
 JOIN {ranked(f'(SELECT bar_ts, round(atr, 3) AS y FROM ({_ATR}))', 'y')} ra USING (bar_ts) JOIN {ranked(f"(SELECT bar_ts, round(bb_width, 9) AS y FROM ({_BB.format('SELECT * FROM bars_d1')}))", 'y')} rb USING (bar_ts))"""
_LABELS, _LEVELS = ["trend_regime", "vol_regime", "bb_regime"], ["adx", "atr", "atr_rank", "bb_width", "bb_rank", "realized_vol"]
REGIME = [*_LABELS, *_LEVELS]
_BEFORE = f"(SELECT bar_ts, {', '.join(f'lag({c}) OVER (ORDER BY bar_ts) AS {c}' for c in REGIME)} FROM {_REGIME})"


@R.add("regime_classify", f"SELECT bar_ts, {', '.join(_LABELS)} FROM {_REGIME}", ("bars_d1",))
def regime_classify(spark, sf):
    return I.regime(X.bars_d1(spark, sf), []).select("bar_ts", *_LABELS)


def day_before(spark, sf):
    """Labels and levels of the last daily bar, as known when a day begins; one row a day."""
    return I.shifted(I.regime(X.bars_d1(spark, sf), []), REGIME, []).select("bar_ts", *REGIME)


@R.add("regime_asof_shift", f"SELECT * FROM {_BEFORE}", ("bars_d1",), doubles=" ".join(_LEVELS), digits=3)
def regime_asof_shift(spark, sf):
    return day_before(spark, sf)


@R.add("regime_attach", f"SELECT o_orderkey, {', '.join(REGIME)} FROM orders o LEFT JOIN {_BEFORE} d ON d.bar_ts = date_trunc('day', o.o_orderdate)", ("bars_d1",), doubles=" ".join(_LEVELS), digits=3)
def regime_attach(spark, sf):
    o = X.load(spark, sf, "orders").select("o_orderkey", F.date_trunc("day", "o_orderdate").alias("bar_ts"))
    return o.join(F.broadcast(day_before(spark, sf)), "bar_ts", "left").select("o_orderkey", *REGIME)


def cusum_sql(src: str, ts: str, x: str, threshold: float = 4.0, gap_days: float | None = None) -> str:
    """Twin of the CUSUM: kept alarms (ts, x) of a series, one row after the other."""
    keep = f"alarm AND (last IS NULL OR date_diff('microsecond', last, ts) > {gap_days} * 86400000000.0)" if gap_days is not None else "alarm"
    return f"""(WITH RECURSIVE cs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {ts}) AS k, {ts} AS ts, {x}::DOUBLE AS x, count({x}) OVER () >= 30 AS ok FROM {src}),
cu AS (SELECT 0::BIGINT AS k, NULL::TIMESTAMP AS ts, NULL::DOUBLE AS x, 0::BIGINT AS n, 0::DOUBLE AS mean, 0::DOUBLE AS m2, 0::DOUBLE AS pos, 0::DOUBLE AS neg, false AS kept, NULL::TIMESTAMP AS last UNION ALL
 SELECT k, ts, x, n, mean, m2, CASE WHEN alarm THEN 0 ELSE pos END, CASE WHEN alarm THEN 0 ELSE neg END, kept, CASE WHEN kept THEN ts ELSE last END FROM (SELECT *, {keep} AS kept FROM (SELECT *, pos > {threshold} OR neg > {threshold} AS alarm FROM
 (SELECT * EXCLUDE (pos, neg, z), CASE WHEN z IS NULL THEN pos ELSE greatest(0, pos + z - 0.5) END AS pos, CASE WHEN z IS NULL THEN neg ELSE greatest(0, neg - z - 0.5) END AS neg FROM
 (SELECT *, CASE WHEN used AND n >= 20 AND m2 > 0 THEN (x - mean) / sqrt(m2 / (n - 1)) END AS z FROM
 (SELECT s.k, s.ts, s.x, s.ok AND s.x IS NOT NULL AS used, c.pos, c.neg, c.last, CASE WHEN s.ok AND s.x IS NOT NULL THEN c.n + 1 ELSE c.n END AS n, CASE WHEN s.ok AND s.x IS NOT NULL THEN c.mean + (s.x - c.mean) / (c.n + 1) ELSE c.mean END AS mean,
 CASE WHEN s.ok AND s.x IS NOT NULL THEN c.m2 + (s.x - c.mean) * (s.x - (c.mean + (s.x - c.mean) / (c.n + 1))) ELSE c.m2 END AS m2 FROM cu c JOIN cs s ON s.k = c.k + 1))))))
SELECT ts, x FROM cu WHERE kept)"""


@R.add("cusum_changepoints", f"SELECT ts AS bar_ts, x AS realized_vol FROM {cusum_sql(f'({_RV})', 'bar_ts', 'realized_vol')}", ("bars_d1",), doubles="realized_vol")
def cusum_changepoints(spark, sf):
    return I.cusum(I.realized_vol(X.bars_d1(spark, sf), []), "realized_vol", []).select("bar_ts", "realized_vol")


@R.add("cusum_merge_gap", f"SELECT ts AS bar_ts, x AS realized_vol FROM {cusum_sql(f'({_RV})', 'bar_ts', 'realized_vol', gap_days=30)}", ("bars_d1",), doubles="realized_vol")
def cusum_merge_gap(spark, sf):
    return I.cusum(I.realized_vol(X.bars_d1(spark, sf), []), "realized_vol", [], gap_days=30).select("bar_ts", "realized_vol")


# Volatility regime of a position's instrument, as of the last hourly bar before it

_HOURLY = "(SELECT *, CASE WHEN count(ret) OVER h = 20 THEN round(stddev_samp(ret) OVER h * sqrt(252), 12) END AS rv, row_number() OVER (PARTITION BY instrument ORDER BY bar_ts) AS k FROM (SELECT instrument, bar_ts, close::DOUBLE / lag(close) OVER (PARTITION BY instrument ORDER BY bar_ts) - 1 AS ret FROM bars_h1) WINDOW h AS (PARTITION BY instrument ORDER BY bar_ts ROWS 19 PRECEDING))"
VOL_SQL = f"(WITH hv AS MATERIALIZED (SELECT *, count(rv) OVER (PARTITION BY instrument ORDER BY k) AS n FROM {_HOURLY}), hr AS MATERIALIZED (SELECT instrument, bar_ts, CASE WHEN n >= 60 AND k > 1 THEN (SELECT count(*) FROM hv p WHERE p.instrument = c.instrument AND p.k < c.k AND p.rv < c.rv)::DOUBLE / (k - 1) END AS rank FROM hv c) SELECT t.id, {_label('rank', 0.5, 'High Vol', 'Low Vol')} AS regime FROM trades t ASOF LEFT JOIN hr ON t.instrument = hr.instrument AND t.t0 > hr.bar_ts)"


def vol_regime(spark, sf):
    """(id, regime) of every position: null before its instrument has 60 hourly deviations."""
    by = ["instrument"]
    b = I.realized_vol(X.bars_h1(spark, sf), by).withColumn("rv", F.round("realized_vol", 12))
    b = I.pct_rank_expanding(b.select("instrument", "bar_ts", "rv"), "rv", "rank", by).withColumn("regime", I.classify(F.col("rank"), 0.5, "High Vol", "Low Vol"))
    t = X.trades(spark, sf).select("id", "instrument", "t0")
    return J.asof_before(t, b.select("instrument", "bar_ts", F.coalesce("regime", F.lit("")).alias("regime")), by, "t0", "bar_ts", ["regime"], "bar_ts").select("id", F.nullif("regime", F.lit("")).alias("regime"))


@R.add("ind_roll_hl", "SELECT bar_ts, CASE WHEN count(*) OVER a = 20 THEN max(high) OVER a END AS hi_20, CASE WHEN count(*) OVER a = 20 THEN min(low) OVER a END AS lo_20, CASE WHEN count(*) OVER b = 50 THEN max(high) OVER b END AS hi_50, CASE WHEN count(*) OVER b = 50 THEN min(low) OVER b END AS lo_50 FROM bars_d1 WINDOW a AS (ORDER BY bar_ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), b AS (ORDER BY bar_ts ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)", ("bars_d1",))
def ind_roll_hl(spark, sf):
    return I.roll_hl(I.roll_hl(X.bars_d1(spark, sf), 20, []), 50, []).select("bar_ts", "hi_20", "lo_20", "hi_50", "lo_50")


@R.add("ind_avg_vol_20d", "SELECT bar_ts, CASE WHEN count(*) OVER a = 20 THEN avg(volume) OVER a / 1440 END AS avg_vol FROM bars_d1 WINDOW a AS (ORDER BY bar_ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)", ("bars_d1",), doubles="avg_vol", digits=9)
def ind_avg_vol_20d(spark, sf):
    return I.avg_volume(X.bars_d1(spark, sf), 20, []).select("bar_ts", "avg_vol")


@R.add("feat_hl_distance", "SELECT bar_ts, (hi - close)::DOUBLE / nullif(hi - lo, 0) AS dist_hi, (close - lo)::DOUBLE / nullif(hi - lo, 0) AS dist_lo FROM (SELECT bar_ts, close, CASE WHEN count(*) OVER a = 20 THEN max(high) OVER a END AS hi, CASE WHEN count(*) OVER a = 20 THEN min(low) OVER a END AS lo FROM bars_d1 WINDOW a AS (ORDER BY bar_ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))", ("bars_d1",), doubles="dist_hi dist_lo")
def feat_hl_distance(spark, sf):
    b = I.roll_hl(X.bars_d1(spark, sf), 20, [])
    span = F.col("hi_20") - F.col("lo_20")
    return b.select("bar_ts", I.safe_div(F.col("hi_20") - F.col("close"), span).alias("dist_hi"), I.safe_div(F.col("close") - F.col("lo_20"), span).alias("dist_lo"))


@R.add("feat_sl_pct_atr", f"SELECT o_orderkey, abs(c - o)::DOUBLE / nullif(a, 0) AS sl_pct_atr FROM (SELECT o_orderkey, date_trunc('day', o_orderdate) AS bar_ts, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders) LEFT JOIN (SELECT bar_ts, open AS o, lag(atr) OVER (ORDER BY bar_ts) AS a FROM ({_ATR})) USING (bar_ts)", ("bars_d1",), doubles="sl_pct_atr")
def feat_sl_pct_atr(spark, sf):
    d = I.shifted(I.atr(X.bars_d1(spark, sf), []), ["atr"], []).select("bar_ts", "open", "atr")
    o = X.load(spark, sf, "orders").select("o_orderkey", F.date_trunc("day", "o_orderdate").alias("bar_ts"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    return o.join(F.broadcast(d), "bar_ts", "left").select("o_orderkey", I.safe_div(F.abs(F.col("c") - F.col("open")), F.col("atr")).alias("sl_pct_atr"))


# Macro series

_FF = ", ".join(f"last_value({c} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS {c}" for c in "anr")
CHANGES = _CH = "SELECT date, " + ", ".join(f"{c}f / lag({c}f, 5) OVER (ORDER BY date) - 1 AS {c}_chg" for c in "anr") + " FROM (SELECT date, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS {c}f" for c in "anr") + " FROM macro)"


def _macro_daily(spark, sf):
    """Three series joined fully on date, then filled forward."""
    m = X.macro(spark, sf)
    parts = [m.where(F.col(c).isNotNull()).select("date", c) for c in "anr"]
    full = parts[0].join(parts[1], "date", "full").join(parts[2], "date", "full")
    return I.ffill(full, list("anr"))


@R.add("macro_daily", f"SELECT date, {_FF} FROM (SELECT * FROM macro WHERE a IS NOT NULL OR n IS NOT NULL OR r IS NOT NULL)", ("macro",), doubles="a n r", digits=4)
def macro_daily(spark, sf):
    return _macro_daily(spark, sf)


@R.add("macro_chg_5d", _CH, ("macro",), doubles="a_chg n_chg r_chg")
def macro_chg_5d(spark, sf):
    return I.change(X.macro(spark, sf), list("anr")).select("date", "a_chg", "n_chg", "r_chg")


@R.add("macro_relative", f"SELECT date, a_chg - n_chg AS a_vs_n, r_chg - n_chg AS r_vs_n FROM ({_CH})", ("macro",), doubles="a_vs_n r_vs_n")
def macro_relative(spark, sf):
    x = I.change(X.macro(spark, sf), list("anr"))
    return x.select("date", (F.col("a_chg") - F.col("n_chg")).alias("a_vs_n"), (F.col("r_chg") - F.col("n_chg")).alias("r_vs_n"))


@R.add("macro_vix_regime", "SELECT c.date, CASE WHEN n < 60 THEN NULL WHEN (SELECT count(*) FROM v p WHERE p.k < c.k AND p.r < c.r)::DOUBLE / (k - 1) > 0.5 THEN 'High' ELSE 'Low' END AS r_regime FROM (SELECT *, count(r) OVER (ORDER BY k) AS n FROM v) c", ("macro",))
def macro_vix_regime(spark, sf):
    x = I.pct_rank_expanding(X.macro(spark, sf).select("date", F.round("r", 9).alias("r")), "r", "rank", [], "date")
    return x.select("date", I.classify(F.col("rank"), 0.5, "High", "Low").alias("r_regime"))


R.oracles["macro_vix_regime"] = R.oracles["macro_vix_regime"].replace("SELECT *  FROM (SELECT c.date", ", v AS (SELECT date, round(r, 9) AS r, row_number() OVER (ORDER BY date) AS k FROM macro)\nSELECT * FROM (SELECT c.date", 1)


@R.add("macro_asof_attach", "SELECT o_orderkey, a, n, r FROM orders LEFT JOIN (SELECT date, lag(a) OVER (ORDER BY date) AS a, lag(n) OVER (ORDER BY date) AS n, lag(r) OVER (ORDER BY date) AS r FROM macro) m ON m.date = CAST(o_orderdate AS DATE)", ("macro",), doubles="a n r", digits=4)
def macro_asof_attach(spark, sf):
    m = I.shifted(X.macro(spark, sf), list("anr"), [], "date")
    o = X.load(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return o.join(F.broadcast(m), "date", "left").select("o_orderkey", "a", "n", "r")


@R.add("macro_corr", "SELECT corr(ret, ra) AS corr_a, corr(ret, rn) AS corr_n, corr(ret, rr) AS corr_r, count(*) AS n_days FROM (SELECT bar_ts::DATE AS date, close::DOUBLE / lag(close) OVER (ORDER BY bar_ts) - 1 AS ret FROM bars_d1) JOIN (SELECT date, a / lag(a) OVER (ORDER BY date) - 1 AS ra, n / lag(n) OVER (ORDER BY date) - 1 AS rn, r / lag(r) OVER (ORDER BY date) - 1 AS rr FROM macro) USING (date) WHERE ret IS NOT NULL AND ra IS NOT NULL AND rn IS NOT NULL AND rr IS NOT NULL", ("bars_d1", "macro"), doubles="corr_a corr_n corr_r")
def macro_corr(spark, sf):
    w = I.ordered([], "date")
    m = X.macro(spark, sf).select("date", *((I.safe_div(F.col(c), F.lag(c).over(w)) - 1).alias(f"r{c}") for c in "anr"))
    d = I.realized_vol(X.bars_d1(spark, sf), []).select(F.to_date("bar_ts").alias("date"), "ret")
    return d.join(m, "date").dropna().agg(F.corr("ret", "ra").alias("corr_a"), F.corr("ret", "rn").alias("corr_n"), F.corr("ret", "rr").alias("corr_r"), F.count("*").alias("n_days"))


# Positions and bars


@R.add("exc_mfe_mae", "SELECT id, n_bars, CASE WHEN side = 'buy' THEN hi ELSE lo END AS mfe_px, CASE WHEN side = 'buy' THEN lo ELSE hi END AS mae_px, mfe_r, mae_r FROM trades_r LEFT JOIN x0 USING (id, n_bars)", ("trades_r",), doubles="mfe_r mae_r", digits=11)
def exc_mfe_mae(spark, sf):
    return J.excursions(X.trades(spark, sf), X.bars_h1(spark, sf)).select("id", "n_bars", "mfe_px", "mae_px", "mfe_r", "mae_r")


R.oracles["exc_mfe_mae"] = R.oracles["exc_mfe_mae"].replace("FROM trades_r LEFT JOIN x0 USING (id, n_bars)", "FROM trades_r LEFT JOIN (SELECT id, hi, lo FROM x0) USING (id)")


@R.add("exc_time_frac", "SELECT id, b::DOUBLE / greatest(n - 1, 1) AS mfe_frac, w::DOUBLE / greatest(n - 1, 1) AS mae_frac FROM (SELECT id, count(*) AS n, arg_min(rn, (CASE WHEN side = 'buy' THEN -high ELSE low END, rn)) AS b, arg_min(rn, (CASE WHEN side = 'buy' THEN low ELSE -high END, rn)) AS w FROM tb GROUP BY id)", ("tb",), doubles="mfe_frac mae_frac")
def exc_time_frac(spark, sf):
    return J.excursions(X.trades(spark, sf), X.bars_h1(spark, sf)).where("n_bars > 0").select("id", "mfe_frac", "mae_frac")


def _look(expr: str, n: int) -> str:
    return f"SELECT t.id, b.v FROM trades t ASOF LEFT JOIN (SELECT instrument, bar_ts, CASE WHEN count(*) OVER w = {n} THEN {expr} END AS v FROM bars_h1 WINDOW w AS (PARTITION BY instrument ORDER BY bar_ts ROWS {n - 1} PRECEDING)) b ON t.instrument = b.instrument AND t.t0 > b.bar_ts"


def _attached(spark, sf, bars, columns):
    return J.asof_before(X.trades(spark, sf), bars.withColumn("_tie", F.lit(0)), ["instrument"], "t0", "bar_ts", columns, "_tie")


@R.add("feat_momentum", "SELECT id, m5.v AS mom_5, m15.v AS mom_15, m30.v AS mom_30 FROM (" + _look("(close - first_value(open) OVER w)::DOUBLE / first_value(open) OVER w", 5) + ") m5 JOIN (" + _look("(close - first_value(open) OVER w)::DOUBLE / first_value(open) OVER w", 15) + ") m15 USING (id) JOIN (" + _look("(close - first_value(open) OVER w)::DOUBLE / first_value(open) OVER w", 30) + ") m30 USING (id)", ("trades", "bars_h1"), doubles="mom_5 mom_15 mom_30", digits=9)
def feat_momentum(spark, sf):
    b = X.bars_h1(spark, sf)
    for n in (5, 15, 30):
        b = J.lookback(b, n)
    return _attached(spark, sf, b, ["mom_5", "mom_15", "mom_30"]).select("id", "mom_5", "mom_15", "mom_30")


@R.add("feat_pct_up", "SELECT id, v AS pct_up_15 FROM (" + _look("avg(CASE WHEN close > open THEN 1 ELSE 0 END) OVER w", 15) + ")", ("trades", "bars_h1"), doubles="pct_up_15")
def feat_pct_up(spark, sf):
    return _attached(spark, sf, J.lookback(X.bars_h1(spark, sf), 15), ["pct_up_15"]).select("id", "pct_up_15")


@R.add("feat_body_wick", "SELECT id, v AS body_5 FROM (" + _look("avg(abs(close - open)::DOUBLE / nullif(high - low, 0)) OVER w", 5) + ")", ("trades", "bars_h1"), doubles="body_5")
def feat_body_wick(spark, sf):
    return _attached(spark, sf, J.lookback(X.bars_h1(spark, sf), 5), ["body_5"]).select("id", "body_5")


_DAY_VOLUME = "(SELECT instrument, day, CASE WHEN count(*) OVER w = 20 THEN avg(volume) OVER w / 24 END AS per_hour FROM (SELECT instrument, date_trunc('day', bar_ts)::TIMESTAMP AS day, sum(volume) AS volume FROM bars_h1 GROUP BY ALL) WINDOW w AS (PARTITION BY instrument ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"


@R.add("feat_volume_ratio", "SELECT id, v / nullif(per_hour, 0) AS volume_ratio FROM (" + _look("avg(volume) OVER w", 30) + f") JOIN trades t USING (id) LEFT JOIN {_DAY_VOLUME} d ON d.instrument = t.instrument AND d.day = date_trunc('day', t.t0)", ("trades", "bars_h1"), doubles="volume_ratio")
def feat_volume_ratio(spark, sf):
    """Mean volume of the 30 bars before a position over an hour's share of the mean of the 20 days before its day; null before 20 days."""
    h = X.bars_h1(spark, sf)
    days = h.groupBy("instrument", F.date_trunc("day", "bar_ts").alias("day")).agg(F.sum("volume").alias("volume"))
    days = I.avg_volume(days, 20, ["instrument"], "day", parts=24).select("instrument", "day", "avg_vol")
    x = _attached(spark, sf, J.lookback(h, 30), ["vol_30"]).withColumn("day", F.date_trunc("day", "t0"))
    return x.join(days, ["instrument", "day"], "left").select("id", I.safe_div(F.col("vol_30"), F.col("avg_vol")).alias("volume_ratio"))


_DIR = "sign(close - open)"


@R.add("feat_consecutive", f"SELECT t.id, b.s AS streak_5 FROM trades t ASOF LEFT JOIN (SELECT instrument, bar_ts, CASE WHEN d = 0 THEN 0 ELSE least(5, row_number() OVER (PARTITION BY instrument, grp ORDER BY bar_ts)) END AS s FROM (SELECT *, sum(CASE WHEN d IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY instrument ORDER BY bar_ts) AS grp FROM (SELECT instrument, bar_ts, {_DIR} AS d, lag({_DIR}) OVER (PARTITION BY instrument ORDER BY bar_ts) AS p FROM bars_h1))) b ON t.instrument = b.instrument AND t.t0 > b.bar_ts", ("trades", "bars_h1"), longs="streak_5")
def feat_consecutive(spark, sf):
    return _attached(spark, sf, J.streak(X.bars_h1(spark, sf)), ["streak_5"]).select("id", "streak_5")


@R.add("feat_prev_outcome", "SELECT a.id, CASE WHEN b.r IS NULL THEN 'no_prior_trade' WHEN b.r > 0 THEN 'prev_win' ELSE 'prev_loss' END AS prev_outcome FROM trades_r a ASOF LEFT JOIN (SELECT t1, arg_max(r, id) AS r FROM trades_r GROUP BY t1) b ON a.t0 > b.t1", ("trades_r",))
def feat_prev_outcome(spark, sf):
    t = J.realized(X.trades(spark, sf), X.bars_h1(spark, sf))
    x = J.asof_before(t.select("id", "t0"), t.select(F.col("r").alias("pr"), "t1", F.col("id").alias("pid")), [], "t0", "t1", ["pr"], "pid")
    return x.select("id", F.when(F.col("pr").isNull(), "no_prior_trade").when(F.col("pr") > 0, "prev_win").otherwise("prev_loss").alias("prev_outcome"))


@R.add("feat_speed_30m", "SELECT t.id, max(CASE WHEN side = 'buy' THEN high - entry ELSE entry - low END::DOUBLE / risk) AS speed_r FROM trades t LEFT JOIN bars_h1 b ON b.instrument = t.instrument AND b.bar_ts >= t0 AND b.bar_ts <= least(t0 + INTERVAL 3 HOUR, t1) GROUP BY t.id", ("trades", "bars_h1"), doubles="speed_r", digits=11)
def feat_speed_30m(spark, sf):
    return _speed(spark, sf)


def _speed(spark, sf, hours: int = 3):
    t = X.trades(spark, sf)
    p = J.interval_join(t, X.bars_h1(spark, sf), F.col("t0"), F.least(F.col("t0") + F.make_dt_interval(hours=F.lit(hours)), F.col("t1")))
    g = p.groupBy("id").agg(F.max(F.when(F.col("side") == "buy", F.col("high") - F.col("entry")).otherwise(F.col("entry") - F.col("low")) / F.col("risk")).alias("speed_r"))
    return t.select("id").join(g, "id", "left")


@R.add("feat_speed_bucket", "SELECT id, CASE WHEN s IS NULL THEN NULL WHEN s <= 0.5 THEN 'slow' WHEN s <= 1.5 THEN 'medium' WHEN s <= 3 THEN 'fast' ELSE 'very_fast' END AS speed_bucket FROM (SELECT t.id, max(CASE WHEN side = 'buy' THEN high - entry ELSE entry - low END::DOUBLE / risk) AS s FROM trades t LEFT JOIN bars_h1 b ON b.instrument = t.instrument AND b.bar_ts >= t0 AND b.bar_ts <= least(t0 + INTERVAL 3 HOUR, t1) GROUP BY t.id)", ("trades", "bars_h1"))
def feat_speed_bucket(spark, sf):
    s = F.col("speed_r")
    return _speed(spark, sf).select("id", F.when(s.isNull(), None).when(s <= 0.5, "slow").when(s <= 1.5, "medium").when(s <= 3, "fast").otherwise("very_fast").alias("speed_bucket"))


# Scalar rules


@R.add("feat_session", "SELECT id, CASE WHEN hour(t0) < 7 THEN 'asia' WHEN hour(t0) < 12 THEN 'london' WHEN hour(t0) < 16 THEN 'overlap' WHEN hour(t0) < 21 THEN 'new_york' ELSE 'late' END AS session FROM trades", ("trades",))
def feat_session(spark, sf):
    h = F.hour("t0")
    return X.trades(spark, sf).select("id", F.when(h < 7, "asia").when(h < 12, "london").when(h < 16, "overlap").when(h < 21, "new_york").otherwise("late").alias("session"))


@R.add("date_parts", "SELECT id, hour(t0) AS hr, year(t0) AS yr, strftime(t0, '%Y-%m') AS month, isodow(t0) AS weekday, date_trunc('day', t0)::TIMESTAMP AS day FROM trades", ("trades",), longs="hr yr weekday")
def date_parts(spark, sf):
    return X.trades(spark, sf).select("id", F.hour("t0").alias("hr"), F.year("t0").alias("yr"), F.date_format("t0", "yyyy-MM").alias("month"), (F.weekday("t0") + 1).alias("weekday"), F.date_trunc("day", "t0").alias("day"))


@R.add("string_ops", "SELECT id, substr(strftime(t0, '%Y-%m-%d'), 1, 7) AS month, array_to_string([side, instrument], ' & ') AS label, left(array_to_string([side, instrument], ' & '), 9) AS short_label FROM trades", ("trades",))
def string_ops(spark, sf):
    label = F.concat_ws(" & ", "side", "instrument")
    return X.trades(spark, sf).select("id", F.substring(F.date_format("t0", "yyyy-MM-dd"), 1, 7).alias("month"), label.alias("label"), F.left(label, F.lit(9)).alias("short_label"))


@R.add("feat_rr_setup", "SELECT id, CASE WHEN side = 'buy' THEN target - entry ELSE entry - target END::DOUBLE / nullif(risk, 0) AS rr_setup FROM trades", ("trades",), doubles="rr_setup", digits=11)
def feat_rr_setup(spark, sf):
    return X.trades(spark, sf).select("id", I.safe_div(J.signed(F.col("target") - F.col("entry")), F.col("risk")).alias("rr_setup"))


_QUALITY = "CASE WHEN mfe_r IS NULL OR mfe_r < 0.15 THEN 'No Favorable Excursion' WHEN mfe_r > 0 AND r / mfe_r >= 0.9 THEN 'Perfect' WHEN mfe_r > 0 AND r / mfe_r >= 0.6 THEN 'Good' WHEN r < 0 THEN 'Terrible' WHEN mfe_r > 0 AND r / mfe_r >= 0.3 THEN 'Early' ELSE 'Terrible' END"


def quality(r, mfe):
    eff = F.when(mfe > 0, r / mfe)
    return F.when(mfe.isNull() | (mfe < 0.15), "No Favorable Excursion").when(eff >= 0.9, "Perfect").when(eff >= 0.6, "Good").when(r < 0, "Terrible").when(eff >= 0.3, "Early").otherwise("Terrible")


def _realized(spark, sf):
    return J.realized(X.trades(spark, sf), X.bars_h1(spark, sf))


@R.add("exit_quality", f"SELECT id, {_QUALITY} AS quality FROM trades_r", ("trades_r",))
def exit_quality(spark, sf):
    return _realized(spark, sf).select("id", quality(F.col("r"), F.col("mfe_r")).alias("quality"))


@R.add("exit_efficiency", "SELECT id, CASE WHEN mfe_r > 0 THEN r / mfe_r END AS efficiency FROM trades_r", ("trades_r",), doubles="efficiency", digits=11)
def exit_efficiency(spark, sf):
    return _realized(spark, sf).select("id", F.when(F.col("mfe_r") > 0, F.col("r") / F.col("mfe_r")).alias("efficiency"))


@R.add("left_on_table", "SELECT id, CASE WHEN mfe_r IS NOT NULL THEN greatest(mfe_r - r, 0) END AS left_r, CASE WHEN mfe_r IS NOT NULL THEN greatest(mfe_r - r, 0) * risk * amount / 100 END AS left_usd FROM trades_r", ("trades_r",), doubles="left_r left_usd", digits=11)
def left_on_table(spark, sf):
    left = F.when(F.col("mfe_r").isNotNull(), F.greatest(F.col("mfe_r") - F.col("r"), F.lit(0.0)))
    return _realized(spark, sf).select("id", left.alias("left_r"), (left * F.col("risk") * F.col("amount") / 100).alias("left_usd"))


@R.add("exit_quality_summary", f"SELECT {_QUALITY} AS quality, count(*) AS n, sum(CASE WHEN mfe_r IS NOT NULL THEN greatest(mfe_r - r, 0) * risk * amount / 100 END) AS left_usd, avg(CASE WHEN mfe_r IS NOT NULL THEN greatest(mfe_r - r, 0) END) AS left_r, avg(r) AS mean_r FROM trades_r GROUP BY 1", ("trades_r",), doubles="left_usd left_r mean_r")
def exit_quality_summary(spark, sf):
    left = F.when(F.col("mfe_r").isNotNull(), F.greatest(F.col("mfe_r") - F.col("r"), F.lit(0.0)))
    return _realized(spark, sf).groupBy(quality(F.col("r"), F.col("mfe_r")).alias("quality")).agg(F.count("*").alias("n"), F.sum(left * F.col("risk") * F.col("amount") / 100).alias("left_usd"), F.avg(left).alias("left_r"), F.avg("r").alias("mean_r"))


@R.add("stop_fill", "SELECT id, rn, CASE WHEN side = 'buy' THEN least(stop, open) ELSE greatest(stop, open) END AS fill FROM tb WHERE CASE WHEN side = 'buy' THEN low <= stop ELSE high >= stop END", ("tb",), doubles="fill")
def stop_fill(spark, sf):
    from ..operators import exits as E

    p = J.windowed(X.trades(spark, sf), X.bars_h1(spark, sf))
    return p.where(E.touches_stop(F.col("stop"))).select("id", "rn", E.stop_fill(F.col("stop").cast("double")).alias("fill"))


@R.add("deadline_utc", "SELECT id, greatest(timezone('UTC', timezone('America/New_York', date_trunc('day', timezone('America/New_York', timezone('UTC', t0))) + INTERVAL 16 HOUR)), t0) AS deadline FROM trades", ("trades",))
def deadline_utc(spark, sf):
    z = "America/New_York"
    d = F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp("t0", z)) + F.expr("INTERVAL 16 HOURS"), z)
    return X.trades(spark, sf).select("id", F.greatest(d, F.col("t0")).alias("deadline"))


@R.add("apply_condition", "SELECT id FROM trades WHERE side = 'buy' AND instrument = 'click'", ("trades",))
def apply_condition(spark, sf):
    from ..operators.patterns import matches

    return X.trades(spark, sf).where(matches({"side": "buy", "instrument": "click"})).select("id")
