"""Queries over exit rules: simulation, performance tables, comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import clusters as C
from ..operators import exits as E
from ..operators import intervals as J
from ..operators import ordered as O
from ..operators import selection as S
from ..sources import fixtures as X
from ..sources.scratch import stored
from .market import VOL_SQL, vol_regime
from .market import _look as look
from .registry import Registry

R = Registry()

# DuckDB twins of the rules, over pairs with a running peak.
_S = "(CASE WHEN side = 'buy' THEN 1 ELSE -1 END)"


def _r(px: str) -> str:
    return f"({_S} * ({px} - entry)::DOUBLE / risk)"


def _stop(level: str) -> str:
    return f"(CASE WHEN side = 'buy' THEN low <= {level} ELSE high >= {level} END)"


def _tgt(level: str) -> str:
    return f"(CASE WHEN side = 'buy' THEN high >= {level} ELSE low <= {level} END)"


def _fill(level: str) -> str:
    return f"(CASE WHEN side = 'buy' THEN least({level}, open::DOUBLE) ELSE greatest({level}, open::DOUBLE) END)"


_GAIN = _r("peak")


def _trail(p: str) -> str:
    return f"(CASE WHEN {_GAIN} >= 0.15::DOUBLE AND {p} IS NOT NULL THEN CASE WHEN side = 'buy' THEN greatest(stop::DOUBLE, peak - {p} * (peak - entry)) ELSE least(stop::DOUBLE, peak - {p} * (peak - entry)) END ELSE stop::DOUBLE END)"


def _rule_sql() -> dict[str, tuple[str, str]]:
    out = {}
    for p in E.TRAILS:
        level = _trail(f"{p}::DOUBLE")
        out[f"trail_{p:.2f}"] = (_stop(level), _r(_fill(level)))
    aware = _trail(f"(CASE WHEN {_GAIN} >= 5 THEN 0.02::DOUBLE WHEN {_GAIN} >= 1 THEN 0.10::DOUBLE END)")
    out["mfe_aware"] = (_stop(aware), _r(_fill(aware)))
    for n, level in (("target", "target::DOUBLE"), *((f"fixed_{m}r", f"(entry + {_S} * risk * {m})::DOUBLE") for m in (2, 3, 4))):
        out[n] = (f"({_tgt(level)} OR {_stop('stop')})", f"CASE WHEN {_tgt(level)} THEN {_r(level)} ELSE {_r(_fill('stop::DOUBLE'))} END")
    for h in (1, 2, 4, 8):
        out[f"time_{h}h"] = (f"({_stop('stop')} OR bar_ts >= bts + INTERVAL {h} HOUR)", f"CASE WHEN {_stop('stop')} THEN {_r(_fill('stop::DOUBLE'))} ELSE {_r('close')} END")
    return out


RULES = _rule_sql()
_PK = """(SELECT *, CASE WHEN side = 'buy' THEN greatest(entry, coalesce(max(high) OVER w, entry)) ELSE least(entry, coalesce(min(low) OVER w, entry)) END AS peak, min(bar_ts) OVER (PARTITION BY id) AS bts,
 row_number() OVER (PARTITION BY id ORDER BY bar_ts) - 1 AS rn FROM (SELECT t.*, b.bar_ts, b.open, b.high, b.low, b.close FROM trades_r t JOIN bars_h1 b ON b.instrument = t.instrument AND b.bar_ts >= t0 AND b.bar_ts <= t1 + INTERVAL 72 HOUR)
 WINDOW w AS (PARTITION BY id ORDER BY bar_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _sim_sql(names: list[str], partial: bool = False) -> str:
    parts = []
    for n in names:
        trig, r = RULES[n]
        for sc, cond in (("conservative", "bar_ts <= t1"), ("aggressive", "true")):
            parts.append(f"SELECT id, '{n}' AS strategy, '{sc}' AS scenario, arg_min({r}, rn) AS hit FROM pk WHERE {trig} AND {cond} GROUP BY id")
    if partial:
        for sc, cond in (("conservative", "bar_ts <= t1"), ("aggressive", "true")):
            legs = ((0.5, f"(entry + {_S} * risk * 2)::DOUBLE"), (0.3, f"(entry + {_S} * risk * 4)::DOUBLE"), (0.2, "target::DOUBLE"))
            cols = ", ".join(f"min(rn) FILTER ({_tgt(lv)}) AS l{i}, any_value({_r(lv)}) AS r{i}" for i, (_, lv) in enumerate(legs))
            val = " + ".join(f"{sh}::DOUBLE * CASE WHEN l{i} IS NOT NULL AND (s IS NULL OR l{i} < s) THEN r{i} ELSE coalesce(sr, r) END" for i, (sh, _) in enumerate(legs))
            parts.append(f"SELECT id, 'partial' AS strategy, '{sc}' AS scenario, CASE WHEN coalesce(s, l0, l1, l2) IS NOT NULL THEN {val} END AS hit FROM (SELECT id, any_value(r) AS r, min(rn) FILTER ({_stop('stop')}) AS s, arg_min({_r(_fill('stop::DOUBLE'))}, rn) FILTER ({_stop('stop')}) AS sr, {cols} FROM pk WHERE {cond} GROUP BY id)")
        names = [*names, "partial"]
    listed = ", ".join(f"'{n}'" for n in names)
    return f"(WITH pk AS {_PK}, hits AS ({' UNION ALL '.join(parts)}) SELECT t.id, t.t0, t.amount, t.risk, t.r AS orig_r, n.strategy, s.scenario, coalesce(h.hit, t.r) AS exit_r, h.hit IS NOT NULL AS triggered FROM trades_r t CROSS JOIN (SELECT unnest([{listed}]) AS strategy) n CROSS JOIN (SELECT unnest(['conservative', 'aggressive']) AS scenario) s LEFT JOIN hits h ON h.id = t.id AND h.strategy = n.strategy AND h.scenario = s.scenario)"


V = ("trades_r",)


def base(spark, sf):
    t, b = X.market(spark, sf)
    return stored(J.realized(t, b), "positions"), b


def sim(spark, sf, names: list[str], partial: bool = False):
    t, b = base(spark, sf)
    every = E.rules()
    return E.simulate(t, b, {n: every[n] for n in names}, partial)


def _sim_query(query: str, names: list[str], partial: bool = False, digits: int = 11):
    cols = "id, strategy, scenario, exit_r, triggered"

    @R.add(query, f"SELECT {cols} FROM {_sim_sql(names, partial)}", V, doubles="exit_r", digits=digits)
    def f(spark, sf):
        return sim(spark, sf, names, partial).select(*cols.split(", "))


TRAIL = [f"trail_{p:.2f}" for p in E.TRAILS]
FIXED = ["target", "fixed_2r", "fixed_3r", "fixed_4r"]
TIMED = ["time_1h", "time_2h", "time_4h", "time_8h"]
_sim_query("sim_trailing", TRAIL, digits=11)
_sim_query("sim_fixed_tp", FIXED)
_sim_query("sim_time", TIMED)
_sim_query("sim_mfe_aware", ["mfe_aware"], digits=11)
_sim_query("sim_partial", [], True)
_sim_query("sim_all_strategies", [*TRAIL, *FIXED, "mfe_aware", *TIMED], True, digits=11)


@R.add("sim_trailing_grid", f"SELECT id, strategy, scenario, exit_r, triggered, exit_r - orig_r AS gain FROM {_sim_sql(TRAIL)}", V, doubles="exit_r gain", digits=11)
def sim_trailing_grid(spark, sf):
    """Every position at every step of the trailing grid in both scenarios, with its gain on the actual exit."""
    return sim(spark, sf, TRAIL).select("id", "strategy", "scenario", "exit_r", "triggered", (F.col("exit_r") - F.col("orig_r")).alias("gain"))


@R.add("sim_trailing_long", f"SELECT id, strategy, scenario, exit_r * risk * amount / 100 AS exit_usd, orig_r * risk * amount / 100 AS orig_usd, strftime(t0, '%Y-%m') AS month, year(t0) AS yr FROM {_sim_sql(TRAIL)}", V, doubles="exit_usd orig_usd", longs="yr", digits=7)
def sim_trailing_long(spark, sf):
    usd = F.col("risk") * F.col("amount") / 100
    return sim(spark, sf, TRAIL).select("id", "strategy", "scenario", (F.col("exit_r") * F.col("risk") * F.col("amount") / 100).alias("exit_usd"), (F.col("orig_r") * F.col("risk") * F.col("amount") / 100).alias("orig_usd"), F.date_format("t0", "yyyy-MM").alias("month"), F.year("t0").alias("yr"))


_NS = f"(SELECT t.id, t.t0, t.amount, t.r AS orig_r, {_r('last')} AS final_r, CASE WHEN last IS NOT NULL THEN {_r('(CASE WHEN side = ' + chr(39) + 'buy' + chr(39) + ' THEN greatest(h, entry) ELSE least(l, entry) END)')} END AS best_r, CASE WHEN last IS NOT NULL THEN {_r('(CASE WHEN side = ' + chr(39) + 'buy' + chr(39) + ' THEN least(l, entry) ELSE greatest(h, entry) END)')} END AS worst_r, t0 + INTERVAL 30 DAY > e.data_end AS censored FROM trades_r t LEFT JOIN (SELECT id, arg_max(close, bar_ts) AS last, max(high) AS h, min(low) AS l FROM trades t2 JOIN bars_h1 b ON b.instrument = t2.instrument AND b.bar_ts >= t0 AND b.bar_ts <= t0 + INTERVAL 30 DAY GROUP BY id) g USING (id) LEFT JOIN (SELECT instrument, max(bar_ts) AS data_end FROM bars_h1 GROUP BY 1) e USING (instrument))"


def no_stop(spark, sf):
    t, b = base(spark, sf)
    return E.no_stop(t, b)


@R.add("sim_no_stop", f"SELECT id, orig_r, final_r, best_r, worst_r, censored, worst_r <= -3 AS catastrophic FROM {_NS}", V, doubles="orig_r final_r best_r worst_r", digits=11)
def sim_no_stop(spark, sf):
    return no_stop(spark, sf).drop("t0", "amount")


_EOD = f"(SELECT t.id, t.t0, t.r AS orig_r, {_r('coalesce(px, last)')} AS exit_r, CASE WHEN last IS NULL THEN 'no_data' ELSE coalesce(why, 'eod_forced') END AS reason FROM trades_r t LEFT JOIN (SELECT id, arg_max(close, bar_ts)::DOUBLE AS last, arg_min(CASE WHEN {_tgt('target')} THEN target ELSE stop END, bar_ts) FILTER ({_tgt('target')} OR {_stop('stop')})::DOUBLE AS px, arg_min(CASE WHEN {_tgt('target')} THEN 'target' ELSE 'stop' END, bar_ts) FILTER ({_tgt('target')} OR {_stop('stop')}) AS why FROM trades t2 JOIN bars_h1 b ON b.instrument = t2.instrument AND b.bar_ts >= t0 AND b.bar_ts <= greatest(t0, timezone('UTC', timezone('America/New_York', date_trunc('day', timezone('America/New_York', timezone('UTC', t0))) + INTERVAL 16 HOUR))) GROUP BY id) g USING (id))"


def eod(spark, sf):
    t, b = base(spark, sf)
    return E.end_of_day(t, b)


@R.add("sim_eod", f"SELECT id, exit_r, reason FROM {_EOD}", V, doubles="exit_r", digits=11)
def sim_eod(spark, sf):
    return eod(spark, sf).select("id", "exit_r", "reason")


_TIE = f"(SELECT id FROM (SELECT id, arg_min({_tgt('target')} AND {_stop('stop')}, rn) AS tie FROM tb WHERE {_tgt('target')} OR {_stop('stop')} GROUP BY id) WHERE tie)"


@R.add("sim_tie_detect", f"SELECT id FROM {_TIE}", V)
def sim_tie_detect(spark, sf):
    t, b = X.market(spark, sf)
    return E.tied(t, b).where("tie").select("id")


@R.add("sim_track", f"SELECT id, CASE WHEN n IS NULL THEN 'no_candle_data_yet' ELSE coalesce(state, 'still_open') END AS state FROM trades LEFT JOIN (SELECT id, count(*) AS n, arg_min(CASE WHEN {_tgt('target')} THEN 'closed_at_target' ELSE 'closed_at_stop' END, rn) FILTER ({_tgt('target')} OR {_stop('stop')}) AS state FROM tb WHERE bar_ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY id) USING (id) WHERE t0 <= TIMESTAMP '2024-01-15 12:00:00'", V)
def sim_track(spark, sf):
    t = X.trades(spark, sf)
    return E.track(J.windowed(t, X.bars_h1(spark, sf)), t, F.lit("2024-01-15 12:00:00").cast("timestamp"))


# Metrics

_PF = "CASE WHEN sum({0}) FILTER ({0} < 0) < 0 THEN coalesce(sum({0}) FILTER ({0} > 0), 0) / -sum({0}) FILTER ({0} < 0) END"
_YEARS = "greatest((epoch_us(max(t0)) - epoch_us(min(t0))) / (365.25 * 86400 * 1e6), 1e-9)"


def _summary(r: str) -> str:
    return f"count({r}) AS n, avg(({r} > 0)::INT) AS win_rate, avg({r}) AS expectancy, {_PF.format(r)} AS profit_factor, avg({r}) / nullif(stddev_samp({r}), 0) * sqrt(count({r}) / {_YEARS}) AS sharpe"


_SUM_COLS = "win_rate expectancy profit_factor sharpe max_dd"


def _metric(name: str, sql: str, col):
    @R.add(name, f"SELECT instrument, {sql} AS value FROM trades_r GROUP BY instrument", V, doubles="value")
    def f(spark, sf):
        return base(spark, sf)[0].groupBy("instrument").agg(col().alias("value"))


_metric("agg_profit_factor", "CASE WHEN sum(r) FILTER (r < 0) < 0 THEN coalesce(sum(r) FILTER (r > 0), 0) / -sum(r) FILTER (r < 0) WHEN sum(r) FILTER (r > 0) > 0 THEN 'inf'::DOUBLE END", lambda: M.profit_factor(F.col("r")))
_metric("agg_expectancy", "avg(r)", lambda: M.expectancy(F.col("r")))
_metric("agg_win_rate", "avg((r > 0)::INT)", lambda: M.win_rate(F.col("r")))
_metric("agg_sharpe", f"avg(r) / nullif(stddev_samp(r), 0) * sqrt(count(r) / {_YEARS})", lambda: M.sharpe(F.col("r"), F.count("r") / M.years(F.col("t0"))))
_metric("agg_years_spanned", _YEARS, lambda: M.years(F.col("t0")))


def _dd(src: str, r: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    sel, grp = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"SELECT {sel}max(pk - eq) AS max_dd FROM (SELECT *, max(eq) OVER ({part}ORDER BY t0, id ROWS UNBOUNDED PRECEDING) AS pk FROM (SELECT *, sum({r}) OVER ({part}ORDER BY t0, id ROWS UNBOUNDED PRECEDING) AS eq FROM {src})){grp}"


def summarised(df, columns: dict[str, str], by: str | None = None, name: str = "strategy"):
    """The summary of each column (``columns`` by label, under ``name``) with its deepest fall, in each group ``by``.

    df is stored and a row stays one position: it is spread over the labels only inside the first stage of the aggregate, and
    sorted once for all falls.
    """
    keys = [*([by] if by else []), name]
    s = spread(df, columns, [*([by] if by else []), "t0"], name).groupBy(*keys).agg(*M.summary(F.col("v"), F.col("t0")))
    return s.join(F.broadcast(O.falls(df, columns, ["t0", "id"], by).withColumnRenamed("label", name)), keys, "left")


def spread(df, columns: dict[str, str], keep: list[str], name: str = "strategy"):
    """(keep, name, v): a row for each of the columns."""
    pairs = F.array(*(F.struct(F.lit(n).alias("n"), F.col(c).cast("double").alias("v")) for n, c in columns.items()))
    return df.select(*keep, F.explode(pairs).alias("_x")).select(*keep, F.col("_x.n").alias(name), F.col("_x.v").alias("v"))


def _summarised(src: str, r: str, by: str, extra: str = "") -> str:
    """Twin of ``summarised``."""
    return f"(WITH sx AS MATERIALIZED (SELECT * FROM {src}) SELECT * FROM (SELECT {by}, {_summary(r)}{extra} FROM sx GROUP BY {by}) JOIN ({_dd('sx', r, by)}) USING ({by}))"


def deepest(df, r: str, by: list[str] | None = None):
    """Deepest fall of the cumulated R of each group in order of start and id."""
    order = [*(by or []), "t0", "id"]
    return O.drawdown(O.dealt(df, order), r, ["t0", "id"], by)


@R.add("agg_max_drawdown", _dd("trades_r", "r", "instrument"), V, doubles="max_dd")
def agg_max_drawdown(spark, sf):
    return deepest(base(spark, sf)[0].select("instrument", "t0", "id", "r"), "r", ["instrument"])


_TR = f"(SELECT * FROM {_sim_sql(TRAIL)} WHERE scenario = 'conservative')"


_TRB = f"(SELECT strategy, t0, id, exit_r FROM {_TR} UNION ALL SELECT 'baseline', t0, id, r FROM trades_r)"


def wide(spark, sf, names: list[str], extra: list[str] | None = None, start=None):
    """Stored positions (id, t0, amount, risk, orig_r) with the R of each exit within the own window in the columns of ``cols(names)``."""
    t, b = base(spark, sf) if start is None else start
    every = E.rules()
    x = E.exits(t, b, {n: every[n] for n in names})
    return stored(x.select("id", "t0", "amount", "risk", F.col("r").alias("orig_r"), *(extra or []), *(F.coalesce(f"c{j}", "r").alias(f"x{j}") for j in range(len(names)))), "exits")


def cols(names: list[str]) -> dict[str, str]:
    return {n: f"x{j}" for j, n in enumerate(names)}


@R.add("trail_summary", f"WITH s AS (SELECT * FROM {_summarised(_TRB, 'exit_r', 'strategy')}) SELECT s.*, (s.expectancy - b.expectancy) / abs(b.expectancy) AS expectancy_change, s.profit_factor / b.profit_factor - 1 AS pf_change FROM s, (SELECT expectancy, profit_factor FROM s WHERE strategy = 'baseline') b", V, doubles=_SUM_COLS + " expectancy_change pf_change", digits=8)
def trail_summary(spark, sf):
    s = summarised(wide(spark, sf, TRAIL), {**cols(TRAIL), "baseline": "orig_r"})
    return changes(s, "strategy")


def changes(s, name: str):
    """s with the changes of mean and profit factor against its row ``baseline``."""
    s = stored(s)  # a row a label
    ref = s.where(F.col(name) == "baseline").select(F.col("expectancy").alias("be"), F.col("profit_factor").alias("bp"))
    x = s.crossJoin(F.broadcast(ref))
    return x.select(*s.columns, ((F.col("expectancy") - F.col("be")) / F.abs("be")).alias("expectancy_change"), (F.col("profit_factor") / F.col("bp") - 1).alias("pf_change"))


SOME = [*TRAIL, *FIXED, "mfe_aware", *TIMED]
_SOME = f"(SELECT * FROM {_sim_sql(SOME)} WHERE scenario = 'conservative')"


def some(spark, sf):
    """Positions with the R of every exit of SOME."""
    return wide(spark, sf, SOME)


#: Clusters of positions by what is known at entry: risk, size, hour and the move of the 15 bars before.
ENTRY, GROUPS, STEPS = ["risk", "amount", "hour", "mom_15"], 3, 12


def clustered(t, b):
    """Positions with their cluster."""
    x = J.latest_bar(t, J.lookback(b, 15), ["mom_15"])
    entry = {"risk": F.col("risk"), "amount": F.col("amount"), "hour": F.hour("t0"), "mom_15": F.round("mom_15", 12)}
    x = stored(x.withColumns({f"e_{c}": v.cast("double") for c, v in entry.items()}).drop("mom_15"), "entries")
    found = C.lloyd(x, "id", [f"e_{c}" for c in ENTRY], GROUPS, STEPS)
    return x.withColumn("cluster", found).drop(*(f"e_{c}" for c in ENTRY))


def some_clustered(spark, sf):
    t, b = base(spark, sf)
    return wide(spark, sf, SOME, ["cluster"], (clustered(t, b), b))


def _cluster_sql() -> str:
    """Twin: (id, cluster)."""
    near = [f"({' + '.join(f'pow(z{i} - c[{j}][{i + 1}], 2)' for i in range(4))})" for j in (1, 2, 3)]
    at = f"CASE WHEN {near[0]} <= {near[1]} AND {near[0]} <= {near[2]} THEN 0 WHEN {near[1]} <= {near[2]} THEN 1 ELSE 2 END"
    x = f"SELECT t.id, t.risk::DOUBLE AS e0, t.amount::DOUBLE AS e1, hour(t.t0)::DOUBLE AS e2, round(m.v, 12) AS e3 FROM trades t JOIN ({look('(close - first_value(open) OVER w)::DOUBLE / first_value(open) OVER w', 15)}) m USING (id)"
    z = ", ".join(f"round(coalesce((e{i} - m{i}) / s{i}, 0), 9) AS z{i}" for i in range(4))
    moments = ", ".join(f"avg(e{i}) AS m{i}, stddev_samp(e{i}) AS s{i}" for i in range(4))
    return f"""(WITH RECURSIVE ex AS MATERIALIZED ({x}), ez AS MATERIALIZED (SELECT id, {z} FROM ex, (SELECT {moments} FROM ex)),
km AS (SELECT 0 AS it, list([z0, z1, z2, z3] ORDER BY h, id) AS c FROM (SELECT *, md5(id::VARCHAR) AS h FROM ez ORDER BY h, id LIMIT {GROUPS}) UNION ALL
 SELECT it + 1, list(n ORDER BY j) FROM (SELECT it, j, [round(avg(z0), 9), round(avg(z1), 9), round(avg(z2), 9), round(avg(z3), 9)] AS n FROM (SELECT it, z0, z1, z2, z3, {at} AS j FROM km, ez WHERE it < {STEPS}) GROUP BY it, j) GROUP BY it)
SELECT id, {at} AS cluster FROM ez, km WHERE it = {STEPS})"""


_CL = _cluster_sql()
_TABLE = _summarised(f"(SELECT s.*, cluster FROM {_SOME} s JOIN {_CL} USING (id))", "exit_r", "cluster, strategy", ", count(DISTINCT id) < 30 AS low_confidence")
_BEST = f"(SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(profit_factor, 9) DESC NULLS LAST, strategy) = 1 AS is_best FROM {_TABLE})"


def cluster_table(spark, sf):
    x = some_clustered(spark, sf)
    few = x.groupBy("cluster").agg((F.count_distinct("id") < 30).alias("low_confidence"))
    g = summarised(x, cols(SOME), "cluster").join(F.broadcast(few), "cluster")
    return g.withColumn("is_best", F.row_number().over(Window.partitionBy("cluster").orderBy(F.round("profit_factor", 9).desc_nulls_last(), "strategy")) == 1)


@R.add("strat_cluster_table", f"SELECT * FROM {_BEST}", V, doubles=_SUM_COLS, digits=8)
def strat_cluster_table(spark, sf):
    return cluster_table(spark, sf)


@R.add("strat_global_table", f"SELECT * FROM {_summarised(_SOME, 'exit_r', 'strategy')}", V, doubles=_SUM_COLS, digits=8)
def strat_global_table(spark, sf):
    return summarised(some(spark, sf), cols(SOME)).orderBy(F.desc_nulls_last("profit_factor"))


@R.add("best_per_cluster", f"SELECT cluster, strategy, profit_factor FROM {_BEST} WHERE is_best", V, doubles="profit_factor")
def best_per_cluster(spark, sf):
    return cluster_table(spark, sf).where("is_best").select("cluster", "strategy", "profit_factor")


_SC = f"sc AS MATERIALIZED (SELECT s.*, cluster FROM {_SOME} s JOIN {_CL} USING (id))"
_CHOSEN = f"(SELECT cluster, strategy, pf FROM (SELECT cluster, strategy, {_PF.format('exit_r')} AS pf FROM sc GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(pf, 9) DESC NULLS LAST, strategy) = 1)"
_HY = f"(WITH {_SC} SELECT s.id, s.t0, s.amount, s.risk, s.orig_r, s.exit_r AS hybrid_r, s.cluster, s.strategy FROM sc s JOIN {_CHOSEN} b ON b.cluster = s.cluster AND b.strategy = s.strategy)"


def chosen(s):
    """(cluster, strategy, pf): the exit of the greatest profit factor in each cluster."""
    g = spread(s, cols(SOME), ["cluster"]).groupBy("cluster", "strategy").agg(M.finite_profit_factor(F.col("v")).alias("pf"))
    return g.withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy(F.round("pf", 9).desc_nulls_last(), "strategy"))).where("k = 1").drop("k")


def overall(s, n: int = 1) -> list[str]:
    """The exits of the greatest profit factors of all."""
    g = spread(s, cols(SOME), []).groupBy("strategy").agg(M.finite_profit_factor(F.col("v")).alias("pf"))
    return [r["strategy"] for r in g.orderBy(F.round("pf", 9).desc_nulls_last(), "strategy").limit(n).collect()]


def picked(strategy):
    """The R of the exit that the column names."""
    return F.element_at(F.create_map(*(v for n, c in cols(SOME).items() for v in (F.lit(n), F.col(c)))), strategy)


def hybrid(spark, sf, more: list[str] | None = None, source=None):
    """Positions with the exit of their cluster; ``more`` keeps columns of the source."""
    s = some_clustered(spark, sf) if source is None else source
    best = s.sparkSession.createDataFrame(chosen(s).select("cluster", "strategy").collect(), "cluster int, strategy string")  # one row a cluster
    return s.join(F.broadcast(best), "cluster").select("id", "t0", "amount", "risk", "orig_r", picked(F.col("strategy")).alias("hybrid_r"), "cluster", "strategy", *(more or []))


@R.add("hybrid_exit", f"SELECT id, cluster, strategy, hybrid_r FROM {_HY}", V, doubles="hybrid_r", digits=11)
def hybrid_exit(spark, sf):
    return hybrid(spark, sf).select("id", "cluster", "strategy", "hybrid_r")


_GLOBAL = f"(SELECT strategy FROM (SELECT strategy, {_PF.format('exit_r')} AS pf FROM sm GROUP BY 1) ORDER BY round(pf, 9) DESC NULLS LAST, strategy LIMIT 1)"
_THREE = f"(WITH sm AS MATERIALIZED {_SOME} SELECT 'baseline' AS label, t0, id, orig_r AS v FROM {_HY} UNION ALL SELECT 'hybrid', t0, id, hybrid_r FROM {_HY} UNION ALL SELECT 'global', t0, id, exit_r FROM sm WHERE strategy = {_GLOBAL})"


@R.add("hybrid_compare", f"WITH s AS (SELECT * FROM {_summarised(_THREE, 'v', 'label')}) SELECT s.*, (s.expectancy - b.expectancy) / abs(b.expectancy) AS expectancy_change, s.profit_factor / b.profit_factor - 1 AS pf_change FROM s, (SELECT * FROM s WHERE label = 'baseline') b", V, doubles=_SUM_COLS + " expectancy_change pf_change", digits=8)
def hybrid_compare(spark, sf):
    """Actual exits, the best exit of all and the best exit of each cluster, with changes against the actual ones."""
    s = some_clustered(spark, sf)
    best = cols(SOME)[overall(s)[0]]
    h = stored(hybrid(spark, sf, [best], s))
    return changes(summarised(h, {"baseline": "orig_r", "hybrid": "hybrid_r", "global": best}, name="label"), "label")


@R.add("drawdown_profile", f"SELECT (SELECT max_dd FROM ({_dd(_HY, 'orig_r')})) AS baseline_dd, (SELECT max_dd FROM ({_dd(_HY, 'hybrid_r')})) AS hybrid_dd", V, doubles="baseline_dd hybrid_dd", digits=8)
def drawdown_profile(spark, sf):
    h = stored(hybrid(spark, sf).select("t0", "id", "orig_r", "hybrid_r"))
    f = O.falls(h, {"baseline_dd": "orig_r", "hybrid_dd": "hybrid_r"}, ["t0", "id"])
    return f.agg(*(F.max(F.when(F.col("label") == n, F.col("max_dd"))).alias(n) for n in ("baseline_dd", "hybrid_dd")))


@R.add("yearly_perf", f"SELECT year(t0) AS yr, count(*) AS n, avg((r > 0)::INT) AS win_rate, avg(r) AS expectancy, {_PF.format('r')} AS profit_factor FROM orders_r GROUP BY 1", ("orders_r",), doubles="win_rate expectancy profit_factor", longs="yr")
def yearly_perf(spark, sf):
    o = X.orders_r(spark, sf).select(F.year("t0").alias("yr"), "r")
    return o.groupBy("yr").agg(F.count("*").alias("n"), M.win_rate(F.col("r")).alias("win_rate"), M.expectancy(F.col("r")).alias("expectancy"), M.finite_profit_factor(F.col("r")).alias("profit_factor"))


def _monthly(src: str, r: str, extra: str = "") -> str:
    return f"SELECT strftime(t0, '%Y-%m') AS period, count(*) AS n, sum(orig_r * risk * amount / 100) AS orig_usd, sum({r} * risk * amount / 100) AS new_usd{extra} FROM {src} GROUP BY 1"


def monthly(df, r: str, *extra):
    usd = F.col("risk") * F.col("amount") / 100
    return df.groupBy(F.date_format("t0", "yyyy-MM").alias("period")).agg(F.count("*").alias("n"), F.sum(F.col("orig_r") * usd).alias("orig_usd"), F.sum(F.col(r) * usd).alias("new_usd"), *extra)


def direction(df):
    d = F.round(F.col("new_usd") - F.col("orig_usd"), 6)
    return df.withColumn("diff", F.col("new_usd") - F.col("orig_usd")).withColumn("direction", F.when(d > 0, "improved").when(d < 0, "degraded").otherwise("unchanged"))


def _direct(sql: str) -> str:
    return f"SELECT *, new_usd - orig_usd AS diff, CASE WHEN round(new_usd - orig_usd, 6) > 0 THEN 'improved' WHEN round(new_usd - orig_usd, 6) < 0 THEN 'degraded' ELSE 'unchanged' END AS direction FROM ({sql})"


_T1 = f"(SELECT * FROM {_sim_sql(['trail_0.01'])} WHERE scenario = 'conservative')"


def t1(spark, sf):
    return sim(spark, sf, ["trail_0.01"]).where("scenario = 'conservative'")


@R.add("monthly_trailing", _direct(_monthly(_T1, "exit_r")), V, doubles="orig_usd new_usd diff", digits=7)
def monthly_trailing(spark, sf):
    return direction(monthly(t1(spark, sf), "exit_r"))


@R.add("direction_label", f"SELECT direction, count(*) AS n FROM ({_direct(_monthly(_T1, 'exit_r'))}) GROUP BY 1", V)
def direction_label(spark, sf):
    return monthly_trailing(spark, sf).groupBy("direction").agg(F.count("*").alias("n"))


@R.add("monthly_hybrid", _direct(_monthly(_HY, "hybrid_r", ", avg((orig_r > 0)::INT) AS orig_win, avg((hybrid_r > 0)::INT) AS new_win")), V, doubles="orig_usd new_usd diff orig_win new_win", digits=7)
def monthly_hybrid(spark, sf):
    return direction(monthly(hybrid(spark, sf), "hybrid_r", M.win_rate(F.col("orig_r")).alias("orig_win"), M.win_rate(F.col("hybrid_r")).alias("new_win")))


@R.add("yearly_stability", f"WITH {_SC} SELECT cluster, yr, strategy AS year_best, strategy = best AS same FROM (SELECT *, row_number() OVER (PARTITION BY cluster, yr ORDER BY round(pf, 9) DESC NULLS LAST, strategy) AS k FROM (SELECT cluster, year(t0) AS yr, strategy, {_PF.format('exit_r')} AS pf FROM sc GROUP BY ALL)) JOIN (SELECT cluster, strategy AS best FROM {_CHOSEN}) USING (cluster) WHERE k = 1", V, longs="yr")
def yearly_stability(spark, sf):
    s = some_clustered(spark, sf)
    g = spread(s.withColumn("yr", F.year("t0")), cols(SOME), ["cluster", "yr"]).groupBy("cluster", "yr", "strategy").agg(M.finite_profit_factor(F.col("v")).alias("pf"))
    k = F.row_number().over(Window.partitionBy("cluster", "yr").orderBy(F.round("pf", 9).desc_nulls_last(), "strategy"))
    best = chosen(s).select("cluster", F.col("strategy").alias("best"))
    return g.withColumn("k", k).where("k = 1").join(F.broadcast(best), "cluster").select("cluster", "yr", F.col("strategy").alias("year_best"), (F.col("strategy") == F.col("best")).alias("same"))


@R.add("no_stop_summary", f"WITH nv AS MATERIALIZED (SELECT 'actual' AS label, t0, id, orig_r AS v FROM {_NS} WHERE final_r IS NOT NULL UNION ALL SELECT 'no_stop', t0, id, final_r FROM {_NS} WHERE final_r IS NOT NULL) SELECT * FROM (SELECT label, avg(v) AS mean_r, median(v) AS median_r, avg((v > 0)::INT) AS win_rate, {_PF.format('v')} AS profit_factor, min(v) AS worst FROM nv GROUP BY label) JOIN ({_dd('nv', 'v', 'label')}) USING (label)", V, doubles="mean_r median_r win_rate profit_factor worst max_dd", digits=8)
def no_stop_summary(spark, sf):
    x = O.dealt(no_stop(spark, sf).where("final_r is not null").selectExpr("t0", "id", "stack(2, 'actual', orig_r, 'no_stop', final_r) AS (label, v)"), ["label", "t0", "id"])
    v = F.col("v")
    return x.join(F.broadcast(S.quantile_table(x, {"median_r": ("v", 0.5)}, "label")), "label").groupBy("label").agg(F.avg(v).alias("mean_r"), F.first("median_r").alias("median_r"), M.win_rate(v).alias("win_rate"), M.finite_profit_factor(v).alias("profit_factor"), F.min(v).alias("worst")).join(O.drawdown(x, "v", ["t0", "id"], ["label"]), "label")


@R.add("tail_risk", f"SELECT count(*) AS n, count(*) FILTER (worst_r <= -3) AS n_catastrophic, quantile_cont(worst_r, 0.01) AS p1, quantile_cont(worst_r, 0.05) AS p5, median(worst_r) AS p50, min(worst_r) AS worst FROM {_NS} WHERE worst_r IS NOT NULL", V, doubles="p1 p5 p50 worst", digits=8)
def tail_risk(spark, sf):
    x = stored(no_stop(spark, sf).where("worst_r is not null").select("worst_r"))
    q = S.quantile_table(x, {"p1": ("worst_r", 0.01), "p5": ("worst_r", 0.05), "p50": ("worst_r", 0.5)})
    return x.agg(F.count("*").alias("n"), F.count_if(F.col("worst_r") <= -3).alias("n_catastrophic"), F.min("worst_r").alias("worst")).crossJoin(F.broadcast(q))


@R.add("stopout_recovery", f"SELECT count(*) AS n, avg((final_r > 0)::INT) AS recovered, median(CASE WHEN final_r > 0 THEN final_r END) AS median_recovered FROM {_NS} WHERE orig_r <= -0.99 AND final_r IS NOT NULL", V, doubles="recovered median_recovered", digits=9)
def stopout_recovery(spark, sf):
    x = stored(no_stop(spark, sf).where("orig_r <= -0.99 and final_r is not null").select("final_r", F.when(F.col("final_r") > 0, F.col("final_r")).alias("won")))
    return x.agg(F.count("*").alias("n"), F.avg((F.col("final_r") > 0).cast("double")).alias("recovered")).crossJoin(F.broadcast(S.quantile_table(x, {"median_recovered": ("won", 0.5)})))


_TG = f"(SELECT * FROM {_sim_sql(['target'])} WHERE scenario = 'conservative')"
_ST = "CASE WHEN abs(exit_r - orig_r) < 1e-6 THEN 'no_diff' WHEN exit_r > orig_r THEN 'missed_profit' WHEN orig_r > 0 AND exit_r <= -0.99 THEN 'flipped_to_loss' ELSE 'protected' END"
_TOS = f"(SELECT s.*, {_ST} AS status, t.id IS NOT NULL AS tie FROM {_TG} s LEFT JOIN {_TIE} t ON t.id = s.id)"


def tos(spark, sf):
    t, b = base(spark, sf)
    x = E.exits(E.tied(t, b), b, {"target": E.fixed_target()})
    x = x.select("id", "t0", "amount", "risk", F.col("r").alias("orig_r"), F.coalesce("c0", "r").alias("exit_r"), "tie")
    a, c = F.col("orig_r"), F.col("exit_r")
    status = F.when(F.abs(c - a) < 1e-6, "no_diff").when(c > a, "missed_profit").when((a > 0) & (c <= -0.99), "flipped_to_loss").otherwise("protected")
    return x.withColumn("status", status)


@R.add("tos_trade_table", f"SELECT id, orig_r, exit_r, status, tie FROM {_TOS}", V, doubles="orig_r exit_r", digits=11)
def tos_trade_table(spark, sf):
    return tos(spark, sf).select("id", "orig_r", "exit_r", "status", "tie")


@R.add("status_classify", f"SELECT status, count(*) AS n FROM {_TOS} GROUP BY 1", V)
def status_classify(spark, sf):
    return tos(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@R.add("tos_monthly", _monthly(_TOS, "exit_r"), V, doubles="orig_usd new_usd", digits=7)
def tos_monthly(spark, sf):
    return monthly(tos(spark, sf), "exit_r")


@R.add("tos_kpis", f"WITH ts AS MATERIALIZED {_TOS} SELECT k.*, n_months, n_months_improved FROM (SELECT count(*) AS n, count(*) FILTER (tie) AS n_ties, count(*) FILTER (status = 'missed_profit') AS n_missed, count(*) FILTER (status IN ('protected', 'flipped_to_loss')) AS n_protected, count(*) FILTER (status = 'flipped_to_loss') AS n_flipped, count(*) FILTER (status = 'no_diff') AS n_no_diff, sum((exit_r - orig_r) * risk * amount / 100) AS diff_usd, count(*) FILTER (tie) / greatest(count(*) FILTER (orig_r <> 0), 1)::DOUBLE AS tie_share FROM ts) k, (SELECT count(*) AS n_months, count(*) FILTER (new_usd > orig_usd) AS n_months_improved FROM ({_monthly('ts', 'exit_r')}))", V, doubles="diff_usd tie_share", digits=6)
def tos_kpis(spark, sf):
    """Ten figures of the target-or-stop exits; a flipped loss counts as protected as well."""
    return kpis(stored(tos(spark, sf)))


def kpis(x):
    s = lambda *v: F.count_if(F.col("status").isin(*v))
    diff = F.sum((F.col("exit_r") - F.col("orig_r")) * F.col("risk") * F.col("amount") / 100)
    share = F.count_if("tie") / F.greatest(F.count_if(F.col("orig_r") != 0), F.lit(1))
    k = x.agg(F.count("*").alias("n"), F.count_if("tie").alias("n_ties"), s("missed_profit").alias("n_missed"), s("protected", "flipped_to_loss").alias("n_protected"), s("flipped_to_loss").alias("n_flipped"), s("no_diff").alias("n_no_diff"), diff.alias("diff_usd"), share.alias("tie_share"))
    m = monthly(x, "exit_r").agg(F.count("*").alias("n_months"), F.count_if(F.col("new_usd") > F.col("orig_usd")).alias("n_months_improved"))
    return k.crossJoin(F.broadcast(m))


@R.add("tos_tie_worst_case", f"SELECT count(*) AS n, sum(-risk * amount / 100 - exit_r * risk * amount / 100) AS worst_usd FROM {_TOS} WHERE tie", V, doubles="worst_usd", digits=7)
def tos_tie_worst_case(spark, sf):
    usd = F.col("risk") * F.col("amount") / 100
    return tos(spark, sf).where("tie").agg(F.count("*").alias("n"), F.sum(-usd - F.col("exit_r") * usd).alias("worst_usd"))


@R.add("trail_regime_perf", f"SELECT regime, {_PF.format('exit_r')} AS trail_pf, {_PF.format('orig_r')} AS orig_pf, avg(exit_r) AS trail_exp, avg(orig_r) AS orig_exp, avg(exit_r) > avg(orig_r) AS beats FROM (SELECT s.*, regime FROM {_T1} s JOIN {VOL_SQL} USING (id)) WHERE regime IS NOT NULL GROUP BY regime", V, doubles="trail_pf orig_pf trail_exp orig_exp", digits=8)
def trail_regime_perf(spark, sf):
    x = t1(spark, sf).join(vol_regime(spark, sf), "id").where("regime IS NOT NULL")
    return x.groupBy("regime").agg(M.finite_profit_factor(F.col("exit_r")).alias("trail_pf"), M.finite_profit_factor(F.col("orig_r")).alias("orig_pf"), F.avg("exit_r").alias("trail_exp"), F.avg("orig_r").alias("orig_exp"), (F.avg("exit_r") > F.avg("orig_r")).alias("beats"))


_EDD = f"ed AS MATERIALIZED (SELECT * FROM {_EOD} WHERE exit_r IS NOT NULL), ev AS MATERIALIZED (SELECT 'actual' AS label, t0, id, orig_r AS v FROM ed UNION ALL SELECT 'end_of_day', t0, id, exit_r FROM ed)"


@R.add("eod_summary", f"WITH {_EDD} SELECT s.*, max_dd FROM (SELECT label, count(*) AS n, avg(v) AS mean_r, median(v) AS median_r, avg((v > 0)::INT) AS win_rate, {_PF.format('v')} AS profit_factor FROM ev GROUP BY label) s JOIN ({_dd('ev', 'v', 'label')}) USING (label) UNION ALL SELECT 'exit ' || reason, count(*), NULL, NULL, NULL, NULL, NULL FROM ed GROUP BY reason", V, doubles="mean_r median_r win_rate profit_factor max_dd", digits=8)
def eod_summary(spark, sf):
    """Actual and end-of-day exits side by side, and how many exits there were for each reason."""
    x = stored(eod(spark, sf).where("exit_r IS NOT NULL"))
    p = O.dealt(x.selectExpr("t0", "id", "stack(2, 'actual', orig_r, 'end_of_day', exit_r) AS (label, v)"), ["label", "t0", "id"])
    v = F.col("v")
    s = p.groupBy("label").agg(F.count("*").alias("n"), F.avg(v).alias("mean_r"), M.win_rate(v).alias("win_rate"), M.finite_profit_factor(v).alias("profit_factor"))
    s = s.join(F.broadcast(S.quantile_table(p, {"median_r": ("v", 0.5)}, "label")), "label").join(O.drawdown(p, "v", ["t0", "id"], ["label"]), "label")
    reasons = x.groupBy(F.concat(F.lit("exit "), F.col("reason")).alias("label")).agg(F.count("*").alias("n"))
    return s.unionByName(reasons, allowMissingColumns=True)


_SPLIT = f"(SELECT *, CASE WHEN row_number() OVER (PARTITION BY strategy ORDER BY t0, id) <= floor(0.6 * count(*) OVER (PARTITION BY strategy)) THEN 'train' ELSE 'test' END AS part FROM {_TR})"


def chrono(df):
    """Adds part: the first three fifths of the positions in order of start and id are train."""
    x = O.first_share(df, ["t0", "id"], 0.6)
    return x.withColumn("part", F.when(F.col("train"), "train").otherwise("test")).drop("train")


@R.add("split_chrono", f"SELECT part, strategy, count(*) AS n, min(t0) AS first, max(t0) AS last FROM {_SPLIT} GROUP BY ALL", V)
def split_chrono(spark, sf):
    return spread(chrono(wide(spark, sf, TRAIL)), cols(TRAIL), ["part", "t0"]).groupBy("part", "strategy").agg(F.count("*").alias("n"), F.min("t0").alias("first"), F.max("t0").alias("last"))


@R.add("overfit_check", f"WITH s AS (SELECT strategy, part, {_PF.format('exit_r')} AS pf, avg(exit_r) AS ex FROM {_SPLIT} GROUP BY ALL) SELECT a.strategy, a.pf AS train_pf, b.pf AS test_pf, a.ex AS train_exp, b.ex AS test_exp, row_number() OVER (ORDER BY round(a.pf, 9) DESC NULLS LAST, a.strategy) AS train_rank, row_number() OVER (ORDER BY round(b.pf, 9) DESC NULLS LAST, a.strategy) AS test_rank FROM s a JOIN s b ON a.strategy = b.strategy AND a.part = 'train' AND b.part = 'test'", V, doubles="train_pf test_pf train_exp test_exp", longs="train_rank test_rank", digits=8)
def overfit_check(spark, sf):
    r = F.col("v")
    g = spread(chrono(wide(spark, sf, TRAIL)), cols(TRAIL), ["part"]).groupBy("strategy").agg(*(f.alias(f"{p}_{n}") for p in ("train", "test") for n, f in (("pf", M.finite_profit_factor(F.when(F.col("part") == p, r))), ("exp", F.avg(F.when(F.col("part") == p, r))))))
    rank = lambda p: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.round(f"{p}_pf", 9).desc_nulls_last(), "strategy"))
    return g.select("strategy", "train_pf", "test_pf", "train_exp", "test_exp", rank("train").alias("train_rank"), rank("test").alias("test_rank"))
