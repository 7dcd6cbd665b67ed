"""Queries over patterns, resampling, tests and clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import stats as S
from ..operators import indicators as I
from ..operators import ordered as O
from ..operators import patterns as P
from ..operators import resampling as B
from ..operators import selection
from ..operators import testing as H
from ..sources import fixtures as X
from ..sources.scratch import stored
from . import strategies as Q
from .market import CHANGES as _CH
from .market import _RV, cusum_sql
from .registry import Registry

R = Registry()
OR = ("orders_r",)
CATEGORICAL = ["prio", "segment", "status", "weekday"]
BINNED = ["acctbal", "cents"]
COLUMNS = [*CATEGORICAL, *(f"{c}_bin" for c in BINNED)]
PF = Q._PF


def binned(spark, sf, orders=None) -> DataFrame:
    return P.tertiles(X.orders_r(spark, sf) if orders is None else orders, BINNED)


_BIN = "(SELECT o.*, " + ", ".join(f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} <= q.{c}1 THEN 0 WHEN {c} <= q.{c}2 THEN 1 ELSE 2 END AS {c}_bin" for c in BINNED) + " FROM orders_r o, (SELECT " + ", ".join(f"quantile_cont({c}, 1.0/3) AS {c}1, quantile_cont({c}, 2.0/3) AS {c}2" for c in BINNED) + " FROM orders_r) q)"
_CONDS = " UNION ALL ".join(f"SELECT id, t0, r, '{c}' AS c, '{c}=' || {c}::VARCHAR AS cond FROM {_BIN} WHERE {c} IS NOT NULL" for c in COLUMNS)


def _stats(src: str, least: int) -> str:
    return f"SELECT cond, count(*) AS n, avg((r > 0)::INT) AS win_rate, avg(r) AS expectancy, stddev_samp(r) AS sd, {PF.format('r')} AS profit_factor FROM ({src}) GROUP BY cond HAVING count(*) >= {least}"


_D1 = _stats(_CONDS, 20)
_PAIRS = f"WITH c AS ({_CONDS}) SELECT a.id, a.t0, a.r, a.cond || ' & ' || b.cond AS cond FROM c a JOIN c b ON a.id = b.id AND a.c < b.c"
_D2 = _stats(_PAIRS, 20)
_SC = "win_rate expectancy sd profit_factor"


@R.add("bin_tertile", f"SELECT acctbal_bin, cents_bin, count(*) AS n, min(acctbal) AS lo, max(acctbal) AS hi FROM {_BIN} GROUP BY 1, 2", OR, longs="acctbal_bin cents_bin", doubles="lo hi")
def bin_tertile(spark, sf):
    return binned(spark, sf).groupBy("acctbal_bin", "cents_bin").agg(F.count("*").alias("n"), F.min("acctbal").alias("lo"), F.max("acctbal").alias("hi"))


@R.add("condition_columns", f"SELECT c AS name, CASE WHEN c LIKE '%\\_bin' ESCAPE '\\' THEN 'binned' ELSE 'categorical' END AS kind, count(DISTINCT cond) AS n_levels, count(*) AS n_rows FROM ({_CONDS}) GROUP BY c", OR)
def condition_columns(spark, sf):
    """The columns that conditions are made of, with their levels and rows in the data; a column without values is none."""
    long = P.patterns(binned(spark, sf), "id", "r", COLUMNS, 1).select(F.split_part("cond", F.lit("="), F.lit(1)).alias("name"), "cond")
    kind = F.when(F.col("name").isin(CATEGORICAL), "categorical").otherwise("binned")
    return long.groupBy("name").agg(F.count_distinct("cond").alias("n_levels"), F.count("*").alias("n_rows")).select("name", kind.alias("kind"), "n_levels", "n_rows")


@R.add("pattern_depth1", _D1, OR, doubles=_SC, digits=7)
def pattern_depth1(spark, sf):
    return P.group_stats(P.patterns(binned(spark, sf), "id", "r", COLUMNS, 1), 20)


def depth2(spark, sf, rows=None):
    return P.group_stats(P.patterns(binned(spark, sf) if rows is None else rows, "id", "r", COLUMNS, 2), 20)


@R.add("pattern_depth2", f"{_D1} UNION ALL {_D2}", OR, doubles=_SC, digits=7)
def pattern_depth2(spark, sf):
    return depth2(spark, sf)


def _area(density: str, x: str) -> str:
    """Area of a density of u from 0 to |x|, by Simpson's rule."""
    return f"(list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {density.format(f'(least(abs({x}), 60) * i / 2000.0)')})) * least(abs({x}), 60) / 6000)"


def _p_t(t: str, df: str) -> str:
    """Two-sided p value of Student's t."""
    dense = f"pow(1 + pow({{0}}, 2) / ({df})::DOUBLE, -(({df}) + 1) / 2.0)"
    return f"greatest(0, 1 - 2 * {_area(dense, t)} * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi()))"


def _p_z(z: str) -> str:
    return f"greatest(0, 1 - 2 * {_area('exp(-pow({0}, 2) / 2)', z)} / sqrt(2 * pi()))"


_BASE = "(SELECT count(*) AS bn, sum((r > 0)::INT) AS bw, avg(r) AS be, stddev_samp(r) AS bs FROM orders_r)"
_ST = f"(SELECT s.*, win_rate - bw / bn::DOUBLE AS win_rate_delta, expectancy - be AS expectancy_delta, (win_rate - bw / bn::DOUBLE) / sqrt((win_rate * n + bw) / (n + bn) * (1 - (win_rate * n + bw) / (n + bn)) * (1.0::DOUBLE / n + 1.0::DOUBLE / bn)) AS z, (expectancy - be) / sqrt(sd * sd / n + bs * bs / bn) AS t, pow(sd * sd / n + bs * bs / bn, 2) / (pow(sd * sd / n, 2) / (n - 1) + pow(bs * bs / bn, 2) / (bn - 1)) AS df FROM ({_D1} UNION ALL {_D2}) s, {_BASE})"


def tested(spark, sf, source=None, rows=None):
    o = X.orders_r(spark, sf) if rows is None else rows
    base = o.agg(F.count("*").alias("bn"), F.sum((F.col("r") > 0).cast("int")).alias("bw"), F.avg("r").alias("be"), F.stddev_samp("r").alias("bs"))
    s = (depth2(spark, sf) if source is None else source).crossJoin(F.broadcast(base))
    c = F.col
    t, df = H.welch(c("expectancy"), c("sd"), c("n"), c("be"), c("bs"), c("bn"))
    return s.select("cond", "n", "win_rate", "expectancy", "sd", "profit_factor", (c("win_rate") - c("bw") / c("bn")).alias("win_rate_delta"), (c("expectancy") - c("be")).alias("expectancy_delta"), H.two_proportion_z(c("win_rate") * c("n"), c("n"), c("bw"), c("bn")).alias("z"), t.alias("t"), df.alias("df"))


@R.add("pattern_stats", f"SELECT * FROM {_ST}", OR, doubles=_SC + " win_rate_delta expectancy_delta z t df", digits=5)
def pattern_stats(spark, sf):
    return tested(spark, sf)


@R.add("test_two_prop_z", f"SELECT cond, z, {_p_z('z')} AS p_value FROM {_ST}", OR, doubles="z p_value")
def test_two_prop_z(spark, sf):
    return tested(spark, sf).select("cond", "z", S.normal_pvalue("z").alias("p_value"))


@R.add("test_welch", f"SELECT cond, t, df, {_p_t('t', 'df')} AS p_value FROM {_ST}", OR, doubles="t df p_value", digits=5)
def test_welch(spark, sf):
    return tested(spark, sf).select("cond", "t", "df", S.t_pvalue("t", "df").alias("p_value"))


def with_p(spark, sf, rows=None):
    x = stored(tested(spark, sf, depth2(spark, sf, rows), rows).withColumns({"p_win": S.normal_pvalue("z"), "p_exp": S.t_pvalue("t", "df")}))  # a row a condition, read several times
    return O.benjamini_hochberg(x, "p_exp", "cond").withColumn("low_confidence", F.col("n") < 25)


@R.add("pattern_fdr")
def pattern_fdr(spark, sf):
    return with_p(spark, sf)


_P = "(SELECT id, (cents % 997) / 997.0::DOUBLE AS p FROM orders_r)"


@R.add("test_bh_fdr", f"SELECT id, p, least(min(raw) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS p_fdr, least(p * m, 1) AS p_bonferroni FROM (SELECT *, p * m / k AS raw FROM (SELECT *, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS m FROM {_P}))", OR, doubles="p p_fdr p_bonferroni", digits=8)
def test_bh_fdr(spark, sf):
    """Here the p values are synthetic, of a fixed family that both engines can form: one of each order."""
    x = X.orders_r(spark, sf).select("id", (F.col("cents") % 997 / F.lit(997.0)).alias("p"))
    return O.benjamini_hochberg(x, "p", "id").select("id", "p", "p_fdr", "p_bonferroni")


_WF = f"(SELECT cond, year(t0) AS yr, count(*) AS n, count(*) < 25 AS low_sample, avg((r > 0)::INT) AS win_rate, avg(r) AS expectancy, {PF.format('r')} AS profit_factor FROM ({_CONDS}) GROUP BY 1, 2)"


def folds(spark, sf, rows=None):
    b = binned(spark, sf) if rows is None else rows
    long = P.patterns(b.withColumn("target", F.struct("t0", "r")), "id", "target", COLUMNS, 1)
    r = F.col("target.r")
    return long.groupBy("cond", F.year("target.t0").alias("yr")).agg(F.count("*").alias("n"), (F.count("*") < 25).alias("low_sample"), M.win_rate(r).alias("win_rate"), F.avg(r).alias("expectancy"), M.finite_profit_factor(r).alias("profit_factor"))


@R.add("wf_breakdown", f"WITH w AS MATERIALIZED {_WF} SELECT cond, yr, coalesce(n, 0) AS n, coalesce(low_sample, true) AS low_sample, win_rate, expectancy, profit_factor FROM (SELECT * FROM (SELECT DISTINCT cond FROM w), (SELECT DISTINCT year(t0) AS yr FROM orders_r)) LEFT JOIN w USING (cond, yr)", OR, doubles="win_rate expectancy profit_factor", longs="yr", digits=7)
def wf_breakdown(spark, sf):
    """Every condition in every year, years without a row of it too."""
    g = stored(folds(spark, sf))
    years = X.orders_r(spark, sf).select(F.year("t0").alias("yr")).distinct()
    grid = g.select("cond").distinct().crossJoin(F.broadcast(years))  # conditions and years: few
    return grid.join(g, ["cond", "yr"], "left").fillna({"n": 0, "low_sample": True})


_WS = f"(SELECT cond, count(*) AS folds_with_data, count(*) FILTER (expectancy > 0) AS positive_folds, count(*) FILTER (expectancy > 0) IN (0, count(*)) AS sign_consistent, stddev_samp(expectancy) AS sd_expectancy FROM {_WF} GROUP BY cond)"


def fold_summary(spark, sf, rows=None):
    pos = F.count_if(F.col("expectancy") > 0)
    return folds(spark, sf, rows).groupBy("cond").agg(F.count("*").alias("folds_with_data"), pos.alias("positive_folds"), ((pos == 0) | (pos == F.count("*"))).alias("sign_consistent"), F.stddev_samp("expectancy").alias("sd_expectancy"))


@R.add("wf_summary", f"SELECT * FROM {_WS}", OR, doubles="sd_expectancy", digits=8)
def wf_summary(spark, sf):
    return fold_summary(spark, sf)


@R.add("wf_run", f"SELECT d.cond, d.n, d.expectancy, w.positive_folds, w.sign_consistent FROM ({_D1}) d JOIN {_WS} w USING (cond) QUALIFY row_number() OVER (ORDER BY round(abs(expectancy), 9) DESC, cond) <= 10", OR, doubles="expectancy", digits=7)
def wf_run(spark, sf):
    top = pattern_depth1(spark, sf).orderBy(F.round(F.abs("expectancy"), 9).desc(), "cond").limit(10)
    return top.join(fold_summary(spark, sf), "cond").select("cond", "n", "expectancy", "positive_folds", "sign_consistent")


_RB = f"(SELECT cond, status, count(*) AS n, avg(r) AS expectancy FROM (SELECT c.cond, c.r, o.status FROM ({_CONDS}) c JOIN orders_r o USING (id)) GROUP BY 1, 2)"


@R.add("regime_breakdown", f"SELECT cond, count(*) AS n_regimes, count(DISTINCT sign(expectancy)) FILTER (n >= 10) > 1 AS regime_dependent FROM {_RB} GROUP BY cond", OR)
def regime_breakdown(spark, sf):
    long = P.patterns(binned(spark, sf).withColumn("target", F.struct("status", "r")), "id", "target", COLUMNS, 1)
    g = long.groupBy("cond", "target.status").agg(F.count("*").alias("n"), F.avg("target.r").alias("expectancy"))
    return g.groupBy("cond").agg(F.count("*").alias("n_regimes"), (F.count_distinct(F.when(F.col("n") >= 10, F.signum("expectancy"))) > 1).alias("regime_dependent"))


def _variants() -> str:
    """Every binned column, bin and shift: the mean within the moved edges, with each other condition and without."""
    rest = f"SELECT id, c, cond AS rest FROM ({_CONDS}) UNION ALL SELECT id, '' AS c, '' AS rest FROM orders_r"
    parts = []
    for col in BINNED:
        for b in range(3):
            for s in P.SHIFTS:
                lo, hi = max(0.0, b / 3 + s), min(1.0, (b + 1) / 3 + s)
                parts.append(f"SELECT '{col}' AS col, {b} AS b, {s}::DOUBLE AS shift, id, r, {col} >= lo AND {col} <= hi AS hit, {col}_bin = {b} AS was FROM {_BIN}, (SELECT quantile_cont({col}, {lo}) AS lo, quantile_cont({col}, {hi}) AS hi FROM orders_r)")
    own = "col || '_bin=' || b"
    cond = f"CASE WHEN rest = '' THEN {own} WHEN c < col || '_bin' THEN rest || ' & ' || {own} ELSE {own} || ' & ' || rest END"
    return f"(WITH rest AS MATERIALIZED ({rest}) SELECT {cond} AS cond, col, shift, count(*) FILTER (hit) AS n, avg(r) FILTER (hit) AS e, avg(r) FILTER (was) AS o FROM ({' UNION ALL '.join(parts)}) v JOIN rest USING (id) WHERE c <> col || '_bin' AND (hit OR was) GROUP BY ALL HAVING count(*) FILTER (hit) >= 10 AND count(*) FILTER (was) > 0)"


_PERTURBED = f"(SELECT *, CASE WHEN pass_share >= 0.7 THEN 'stable' WHEN pass_share >= 0.4 THEN 'mixed' ELSE 'unstable' END AS label FROM (SELECT cond, count(*) AS n_variants, avg((sign(e) = sign(o))::INT) AS pass_share FROM {_variants()} GROUP BY cond))"


def perturbation(spark, sf, rows=None):
    return P.stability(P.perturbed(binned(spark, sf) if rows is None else rows, "r", BINNED, CATEGORICAL))


@R.add("stability_perturb", f"SELECT * FROM {_PERTURBED}", OR, doubles="pass_share")
def stability_perturb(spark, sf):
    """Every condition with a bin, its edges moved by five points of quantile: does the sign of the mean stay?"""
    return perturbation(spark, sf)


_REGIMES = f"SELECT cond, count(*) AS n_regimes, count(DISTINCT sign(expectancy)) FILTER (n >= 10) > 1 AS regime_dependent FROM {_RB} GROUP BY cond"


@R.add("stability_run", f"SELECT r.*, pass_share, coalesce(label, CASE WHEN contains(cond, '_bin=') THEN 'insufficient_data' ELSE 'not_applicable' END) AS label FROM ({_REGIMES}) r LEFT JOIN {_PERTURBED} p USING (cond)", OR, doubles="pass_share")
def stability_run(spark, sf):
    """Both stability views of every single condition; only those of a bin have edges to move."""
    p = perturbation(spark, sf).select("cond", "pass_share", "label")
    label = F.coalesce("label", F.when(F.contains("cond", F.lit("_bin=")), "insufficient_data").otherwise("not_applicable"))
    return regime_breakdown(spark, sf).join(p, "cond", "left").withColumn("label", label)


# Resampling

_32 = "& 4294967295::UBIGINT"


def _mix(x: str) -> str:
    """Lateral columns m1 to m5 of the mixer of the resampling operators, over an unsigned 32-bit number."""
    return f"xor({x}, {x} >> 16) AS m1, (m1 * {B.MIX[0]}::UBIGINT) {_32} AS m2, xor(m2, m2 >> 13) AS m3, (m3 * {B.MIX[1]}::UBIGINT) {_32} AS m4, xor(m4, m4 >> 16) AS m5"


def _drawn(src: str, cols: str, iterations: int, seed: int = 42) -> str:
    """Each row of src in each iteration, with its 32 random bits m5."""
    keys = f"SELECT * EXCLUDE (m1, m2, m3, m4, m5), m5 AS hk FROM (SELECT *, {_mix('k0')} FROM (SELECT xor(id::UBIGINT, {seed}::UBIGINT) AS k0, {cols} FROM {src}))"
    return f"SELECT *, {_mix('k1')} FROM (SELECT *, (hk + (iter::UBIGINT * {B.STEP}::UBIGINT) {_32}) {_32} AS k1 FROM ({keys}), range({iterations}) i(iter))"


def _resampled(src: str, values: dict[str, str], iterations: int, by: str = "", chance: str = "", seed: int = 42) -> str:
    """Twin of ``resampled_sums``; ids are below 2 ** 32."""
    b = f"{by}, " if by else ""
    cols = b + ", ".join(f"{v} AS v_{n}" for n, v in values.items()) + (f", {chance} AS chance" if chance else "")
    drawn = _drawn(src, cols, iterations, seed)
    w = "(m5::DOUBLE < chance * 4294967296)::INT" if chance else " + ".join(f"(m5 >= {t})::INT" for t in B.DRAWN)
    return f"(SELECT {b}iter, " + ", ".join(f"coalesce(sum(({w}) * v_{n}), 0)::DOUBLE AS {n}" for n in values) + f" FROM ({drawn}) GROUP BY {b}iter)"


def _gains(r: str, tag: str = "") -> dict[str, str]:
    return {f"g{tag}": f"CASE WHEN {r} > 0 THEN {r} END", f"l{tag}": f"CASE WHEN {r} < 0 THEN -{r} END"}


def gains(r: str, tag: str = "") -> dict:
    return {f"g{tag}": F.when(F.col(r) > 0, F.col(r)), f"l{tag}": F.when(F.col(r) < 0, -F.col(r))}


def factor(tag: str = ""):
    """Profit factor of resampled gains and losses, null without losses."""
    return F.when(F.col(f"l{tag}") > 0, F.col(f"g{tag}") / F.col(f"l{tag}"))


_MEAN = {"w": "1", "s": "r"}


def mean() -> dict:
    return {"w": F.lit(1), "s": F.col("r")}


T = ("trades_r",)


def realized(spark, sf):
    return Q.base(spark, sf)[0]


@R.add("boot_mean_ci", f"SELECT quantile_cont(s / w, 0.025) AS lo, quantile_cont(s / w, 0.975) AS hi FROM {_resampled('trades_r', _MEAN, 2000)} WHERE w > 0", T, doubles="lo hi")
def boot_mean_ci(spark, sf):
    m = B.resampled_sums(realized(spark, sf), "id", mean(), 2000).where("w > 0").select((F.col("s") / F.col("w")).alias("m"))
    return m.agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))


@R.add("boot_survival", f"SELECT avg((m <= 0)::INT) AS p_loss, avg((pf < 1)::INT) AS p_pf, quantile_cont(m, 0.05) AS p05, quantile_cont(m, 0.95) AS p95 FROM (SELECT s / w AS m, CASE WHEN l > 0 THEN g / l END AS pf FROM {_resampled('trades_r', {**_MEAN, **_gains('r')}, 5000)} WHERE w > 0)", T, doubles="p_loss p_pf p05 p95")
def boot_survival(spark, sf):
    m = B.resampled_sums(realized(spark, sf), "id", {**mean(), **gains("r")}, 5000).where("w > 0").select((F.col("s") / F.col("w")).alias("m"), factor().alias("pf"))
    return m.agg(F.avg((F.col("m") <= 0).cast("int")).alias("p_loss"), F.avg((F.col("pf") < 1).cast("int")).alias("p_pf"), F.percentile("m", 0.05).alias("p05"), F.percentile("m", 0.95).alias("p95"))


_MASK = "side = 'buy' AND instrument = 'click'"
_SIDES = f"(SELECT count(*) FILTER ({_MASK}) AS n, avg(r) FILTER ({_MASK}) AS obs, avg((r > 0)::INT) FILTER ({_MASK}) AS obs_win, count(*) FILTER (NOT ({_MASK})) AS cn, avg(r) FILTER (NOT ({_MASK})) AS cm, avg((r > 0)::INT) FILTER (NOT ({_MASK})) AS cw FROM trades_r)"
_FIRST = f"(SELECT iter, avg(r) AS m, avg((r > 0)::INT) AS g FROM (SELECT *, row_number() OVER (PARTITION BY iter ORDER BY m5, id) AS k FROM ({_drawn(f'(SELECT * FROM trades_r WHERE NOT ({_MASK}))', 'id, r', 5000)})), {_SIDES} WHERE k <= n AND n >= 5 AND cn > n GROUP BY iter)"


@R.add("perm_test", f"SELECT n, obs, avg((abs(m - cm) >= abs(obs - cm))::INT) AS p_value, avg((abs(g - cw) >= abs(obs_win - cw))::INT) AS p_win FROM {_SIDES} LEFT JOIN {_FIRST} ON true GROUP BY n, obs", T, doubles="obs p_value p_win")
def perm_test(spark, sf):
    """5000 draws from the complement, without replacement and of the mask's size; null under 5 rows or where the complement is no larger."""
    t = realized(spark, sf).select("id", "r", F.when(P.matches({"side": "buy", "instrument": "click"}), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("met"))
    return permutation_p(t, {0: "mask"}, 5000).select("n", "obs", "p_value", "p_win")


#: Rounding of differences before they are compared, so that sums in another order decide alike.
_EQUAL = 12


def permutation_p(rows, conds: dict[int, str], iterations: int):
    """(cond, n, obs, p_value, p_win) of each condition, from rows (id, r, met: the numbers of its conditions).

    Two-sided against the mean of the complement; null under 5 rows or where the complement is no larger.
    """
    rows = stored(rows.where("r IS NOT NULL"))
    whole = rows.agg(F.count("*").alias("tn"), F.sum("r").alias("ts"), F.count_if(F.col("r") > 0).alias("tw"))
    inside = rows.select("r", F.explode("met").alias("c")).groupBy("c").agg(F.count("*").alias("n"), F.sum("r").alias("s"), F.count_if(F.col("r") > 0).alias("w"))
    c = F.col
    sides = inside.crossJoin(F.broadcast(whole)).select("c", "n", (c("s") / c("n")).alias("obs"), (c("w") / c("n")).alias("obs_win"), (c("tn") - c("n")).alias("cn"), ((c("ts") - c("s")) / F.nullif(c("tn") - c("n"), F.lit(0))).alias("cm"), ((c("tw") - c("w")) / F.nullif(c("tn") - c("n"), F.lit(0))).alias("cw"))
    found = sides.collect()  # one row a condition
    sizes = {r["c"]: r["n"] for r in found if r["n"] >= 5 and r["cn"] > r["n"]}
    names = rows.sparkSession.createDataFrame(list(conds.items()), "c int, cond string")
    sides = names.join(F.broadcast(rows.sparkSession.createDataFrame(found, sides.schema)), "c", "left").fillna(0, ["n"])
    if not sizes:
        return sides.select("cond", "n", "obs", F.lit(None).cast("double").alias("p_value"), F.lit(None).cast("double").alias("p_win"))
    drawn = B.subset_sums(rows, "id", "r", "met", sizes, found[0]["cn"] + found[0]["n"], iterations).withColumnRenamed("cond", "c").withColumnRenamed("n", "drawn")
    far = lambda v, m, o: F.avg((F.round(F.abs(v - c(m)), _EQUAL) >= F.round(F.abs(c(o) - c(m)), _EQUAL)).cast("int"))
    p = drawn.join(F.broadcast(sides), "c").groupBy("cond").agg(far(c("s") / c("drawn"), "cm", "obs").alias("p_value"), far(c("wins") / c("drawn"), "cw", "obs_win").alias("p_win"))
    return sides.select("cond", "n", "obs").join(p, "cond", "left")


def monte_carlo(spark, sf, conds: list[str], source=None):
    """(cond, n, obs, sign_flip, p_value, p_win, verdict) of conditions of depth one or two, over all orders.

    sign_flip: share of 5000 bootstrap means without the sign of the mean.  p_value, p_win: 5000 draws from the rows
    without the condition.  A condition under 5 rows is not drawn for.
    """
    b = (binned(spark, sf) if source is None else source).where("r IS NOT NULL").select("id", "r", *COLUMNS)
    number = {c: i for i, c in enumerate(sorted(conds))}
    met = [F.when(P.matches({k: v for k, _, v in (part.partition("=") for part in c.split(" & "))}), F.lit(i)) for c, i in number.items()]
    rows = stored(b.select("id", "r", F.array_compact(F.array(*met)).alias("met")))
    names = {i: c for c, i in number.items()}
    seen = rows.select("r", F.explode("met").alias("c")).groupBy("c").agg(F.avg("r").alias("mean"))
    of = spark.createDataFrame(list(names.items()), "c int, cond string").join(F.broadcast(seen), "c")  # a row a condition
    s = B.condition_sums(rows, "id", "r", "met", list(names), 5000).withColumnRenamed("cond", "c").join(F.broadcast(of), "c")
    flips = s.groupBy("cond").agg(F.avg(((F.col("s") > 0) != (F.col("mean") > 0)).cast("int")).alias("sign_flip"))
    x = permutation_p(rows, names, 5000).join(F.broadcast(flips), "cond", "left").withColumn("sign_flip", F.when(F.col("n") >= 5, F.col("sign_flip")))
    verdict = F.when(F.col("sign_flip").isNull(), "insufficient_data").when(F.col("sign_flip") > 0.10, "fragile").when(F.coalesce("p_value", F.lit(1.0)) > 0.05, "like_random_subset").otherwise("survives")
    return x.withColumn("verdict", verdict)


@R.add("mc_pattern")
def mc_pattern(spark, sf):
    conds = [r["cond"] for r in pattern_depth1(spark, sf).select("cond").collect()]
    return monte_carlo(spark, sf, conds).select("cond", "n", *(F.round(c, 6).alias(c) for c in ("sign_flip", "p_value", "p_win")))


@R.add("mc_label")
def mc_label(spark, sf):
    conds = [r["cond"] for r in pattern_depth1(spark, sf).select("cond").collect()]
    return monte_carlo(spark, sf, conds).select("cond", "verdict")


def _paired_pf(src: str, new: str, iterations: int, by: str = "") -> str:
    b = f"{by}, " if by else ""
    x = _resampled(src, {**_gains(new, "n"), **_gains("orig_r", "o")}, iterations, by)
    return f"(SELECT {b}avg(pn) AS mean_pf, quantile_cont(pn, 0.05) AS p05, quantile_cont(pn, 0.95) AS p95, avg((pn > po)::INT) AS beats FROM (SELECT {b}CASE WHEN ln > 0 THEN gn / ln END AS pn, CASE WHEN lo > 0 THEN go / lo END AS po FROM {x}){f' GROUP BY {by}' if by else ''})"


def paired_pf(df, new: str, iterations: int, by: str | None = None):
    m = B.resampled_sums(df, "id", {**gains(new, "n"), **gains("orig_r", "o")}, iterations, by=by).withColumns({"pn": factor("n"), "po": factor("o")})
    return m.groupBy(*([by] if by else [])).agg(F.avg("pn").alias("mean_pf"), F.percentile("pn", 0.05).alias("p05"), F.percentile("pn", 0.95).alias("p95"), F.avg((F.col("pn") > F.col("po")).cast("int")).alias("beats"))


_PC = "mean_pf p05 p95 beats"


def _crossing(src: str, iterations: int) -> str:
    return f"WITH bx AS MATERIALIZED {src} SELECT x.*, base, base BETWEEN p05 AND p95 AS crosses_baseline FROM {_paired_pf('bx', 'exit_r', iterations)} x, (SELECT {PF.format('orig_r')} AS base FROM bx)"


def crossing(df, iterations: int):
    """The resampled factor with the actual exits' own factor, and whether that lies inside of the interval."""
    df = stored(df.select("id", "exit_r", "orig_r"))
    base = df.agg(M.finite_profit_factor(F.col("orig_r")).alias("base"))
    return paired_pf(df, "exit_r", iterations).crossJoin(F.broadcast(base)).withColumn("crosses_baseline", F.col("base").between(F.col("p05"), F.col("p95")))


@R.add("boot_pf_paired", _crossing(Q._T1, 1000), T, doubles=_PC + " base")
def boot_pf_paired(spark, sf):
    return crossing(Q.t1(spark, sf), 1000)


_TOP = f"(SELECT * FROM {Q._SOME} WHERE strategy IN (SELECT strategy FROM (SELECT strategy, {PF.format('exit_r')} AS pf FROM {Q._SOME} GROUP BY 1 ORDER BY round(pf, 9) DESC NULLS LAST, strategy LIMIT 3)))"


@R.add("boot_pf_top3", f"SELECT * FROM {_paired_pf(_TOP, 'exit_r', 1000, 'strategy')}", T, doubles=_PC)
def boot_pf_top3(spark, sf):
    s = Q.some(spark, sf)
    top = Q.overall(s, 3)
    x = s.select("id", "orig_r", F.explode(F.array(*(F.struct(F.lit(n).alias("strategy"), F.col(Q.cols(Q.SOME)[n]).alias("exit_r")) for n in top))).alias("_x")).select("id", "orig_r", "_x.*")
    return paired_pf(x, "exit_r", 1000, "strategy")


_CLUSTER_PF = f"SELECT x.*, CASE WHEN p05 > base THEN 'robust' WHEN p95 < base THEN 'not_robust' WHEN (p95 - base) / nullif(p95 - p05, 0) < 0.9 THEN 'borderline' ELSE 'not_robust' END AS verdict FROM {_paired_pf(Q._HY, 'hybrid_r', 1000, 'cluster')} x JOIN (SELECT cluster, {PF.format('orig_r')} AS base FROM {Q._HY} GROUP BY 1) USING (cluster)"


@R.add("boot_pf_cluster", _CLUSTER_PF, T, doubles=_PC)
def boot_pf_cluster(spark, sf):
    return cluster_pf(stored(Q.hybrid(spark, sf).select("id", "cluster", "hybrid_r", "orig_r")))


def cluster_pf(h):
    base = h.groupBy("cluster").agg(M.finite_profit_factor(F.col("orig_r")).alias("base"))
    x = paired_pf(h, "hybrid_r", 1000, "cluster").join(F.broadcast(base), "cluster")
    p5, p95, b = F.col("p05"), F.col("p95"), F.col("base")
    v = F.when(p5 > b, "robust").when(p95 < b, "not_robust").when((p95 - b) / F.nullif(p95 - p5, F.lit(0.0)) < 0.9, "borderline").otherwise("not_robust")
    return x.withColumn("verdict", v).drop("base")


def _shuffled(src: str, r: str, iterations: int, by: str = "") -> str:
    b = f"{by}, " if by else ""
    w = f"OVER (PARTITION BY {b}iter ORDER BY m5, v ROWS UNBOUNDED PRECEDING)"
    return f"(SELECT {b}iter, max(pk - eq) AS max_dd FROM (SELECT *, max(eq) {w} AS pk FROM (SELECT *, sum(v) {w} AS eq FROM ({_drawn(src, f'{b}{r} AS v', iterations)}))) GROUP BY {b}iter)"


@R.add("shuffle_dd", f"SELECT median(max_dd) AS median_dd, quantile_cont(max_dd, 0.95) AS p95_dd FROM {_shuffled('trades_r', 'r', 1000)}", T, doubles="median_dd p95_dd")
def shuffle_dd(spark, sf):
    return B.permuted_drawdown(realized(spark, sf), "r", "id", 1000).agg(F.median("max_dd").alias("median_dd"), F.percentile("max_dd", 0.95).alias("p95_dd"))


@R.add("shuffle_dd_actual", f"SELECT actual, median(max_dd) AS median_dd, avg((max_dd < actual)::INT) AS share_smaller FROM {_shuffled('trades_r', 'r', 2000)}, (SELECT max_dd AS actual FROM ({Q._dd('trades_r', 'r')})) GROUP BY actual", T, doubles="actual median_dd share_smaller")
def shuffle_dd_actual(spark, sf):
    t = realized(spark, sf)
    actual = Q.deepest(t.select("t0", "id", "r"), "r").withColumnRenamed("max_dd", "actual")
    return B.permuted_drawdown(t, "r", "id", 2000).crossJoin(F.broadcast(actual)).groupBy("actual").agg(F.median("max_dd").alias("median_dd"), F.avg((F.col("max_dd") < F.col("actual")).cast("int")).alias("share_smaller"))


@R.add("mc_best_cluster", f"WITH hy AS MATERIALIZED {Q._HY} SELECT * FROM ({_CLUSTER_PF.replace(Q._HY, 'hy')}) JOIN (SELECT cluster, median(max_dd) AS median_dd FROM {_shuffled('hy', 'hybrid_r', 1000, 'cluster')} GROUP BY 1) USING (cluster)", T, doubles=_PC + " median_dd")
def mc_best_cluster(spark, sf):
    h = stored(Q.hybrid(spark, sf).select("id", "cluster", "hybrid_r", "orig_r"))
    dd = B.permuted_drawdown(h, "hybrid_r", "id", 1000, by="cluster").groupBy("cluster").agg(F.median("max_dd").alias("median_dd"))
    return cluster_pf(h).join(dd, "cluster")


@R.add("boot_tos", _crossing(Q._TG, 2000), T, doubles=_PC + " base")
def boot_tos(spark, sf):
    return crossing(Q.sim(spark, sf, ["target"]).where("scenario = 'conservative'"), 2000)


_ED = f"(SELECT * FROM {Q._NS} WHERE final_r IS NOT NULL)"


@R.add("boot_equity_diff", f"SELECT avg(d) AS mean_diff, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi, avg((d < 0)::INT) AS p_worse FROM (SELECT n * s / w AS d FROM {_resampled(_ED, {'w': '1', 's': 'final_r - orig_r'}, 5000)}, (SELECT count(*) AS n FROM {_ED}) WHERE w > 0)", T, doubles="mean_diff lo hi p_worse")
def boot_equity_diff(spark, sf):
    """Difference of totals, each resampled mean scaled back to the number of rows."""
    x = Q.no_stop(spark, sf).where("final_r is not null")
    m = B.resampled_sums(x, "id", {"w": F.lit(1), "s": F.col("final_r") - F.col("orig_r")}, 5000).where("w > 0")
    m = m.crossJoin(F.broadcast(x.agg(F.count("*").alias("n")))).select((F.col("n") * F.col("s") / F.col("w")).alias("d"))
    return m.agg(F.avg("d").alias("mean_diff"), F.percentile("d", 0.025).alias("lo"), F.percentile("d", 0.975).alias("hi"), F.avg((F.col("d") < 0).cast("int")).alias("p_worse"))


# Tests


def _pt(src: str, a: str, b: str) -> str:
    x = f"SELECT count({a} - {b}) AS n, avg({a} - {b}) AS mean_diff, avg({a} - {b}) / (nullif(stddev_samp({a} - {b}), 0) / sqrt(count({a} - {b}))) AS t, count({a} - {b}) - 1 AS df, avg({a} - {b}) / nullif(stddev_samp({a} - {b}), 0) AS cohen_d FROM {src}"
    return f"(SELECT *, {_p_t('t', 'df')} AS p_value, {_LABEL} AS label FROM ({x}))"


_LABEL = f"CASE WHEN t IS NULL THEN 'no_difference' WHEN {_p_t('t', 'df')} >= 0.05 THEN 'not_significant' WHEN abs(cohen_d) >= 0.2 THEN 'significant' ELSE 'significant_but_small' END"


def paired_test(df, a: str, b: str):
    """Paired t with its p value and label: significant from a p under 0.05 and an effect of at least 0.2 deviations."""
    x = H.paired(df, a, b).withColumn("p_value", S.t_pvalue("t", F.col("df").cast("double")))
    label = F.when(F.col("t").isNull(), "no_difference").when(F.col("p_value") >= 0.05, "not_significant").when(F.abs("cohen_d") >= 0.2, "significant").otherwise("significant_but_small")
    return x.withColumn("label", label)


_PTC = "mean_diff t cohen_d p_value"


@R.add("test_paired_t", "SELECT * FROM " + _pt(Q._T1, "exit_r", "orig_r"), T, doubles=_PTC)
def test_paired_t(spark, sf):
    return paired_test(Q.t1(spark, sf), "exit_r", "orig_r")


_SLICE = f"(SELECT * FROM {Q._T1} JOIN {Q.VOL_SQL} USING (id) WHERE regime = 'High Vol')"


@R.add("highvol_confirm", f"WITH hs AS MATERIALIZED {_SLICE} SELECT p.*, c.* FROM {_pt('hs', 'exit_r', 'orig_r')} p, ({_crossing('(SELECT * FROM hs)', 1000)}) c", T, doubles=_PTC + " base " + _PC)
def highvol_confirm(spark, sf):
    """Paired test and resampled profit factor of the tightest trailing exit where volatility was high at entry."""
    x = stored(Q.t1(spark, sf).join(Q.vol_regime(spark, sf).where("regime = 'High Vol'"), "id", "left_semi"))
    return paired_test(x, "exit_r", "orig_r").crossJoin(F.broadcast(crossing(x, 1000)))


_AGAINST = f"(SELECT h.id, h.hybrid_r, g.exit_r AS global_r FROM {Q._HY} h JOIN (WITH sm AS MATERIALIZED {Q._SOME} SELECT id, exit_r FROM sm WHERE strategy = {Q._GLOBAL}) g USING (id))"


@R.add("hybrid_sig", f"SELECT 'baseline' AS against, * FROM {_pt(Q._HY, 'hybrid_r', 'orig_r')} UNION ALL SELECT 'global', * FROM {_pt(_AGAINST, 'hybrid_r', 'global_r')}", T, doubles=_PTC)
def hybrid_sig(spark, sf):
    """The best exit of each cluster against the actual exits, and against the best exit of all."""
    s = Q.some_clustered(spark, sf)
    best = Q.cols(Q.SOME)[Q.overall(s)[0]]
    h = stored(Q.hybrid(spark, sf, [best], s).select("hybrid_r", "orig_r", F.col(best).alias("global_r")))
    return reduce(lambda x, y: x.unionByName(y), [paired_test(h, "hybrid_r", c).select(F.lit(n).alias("against"), "*") for n, c in (("baseline", "orig_r"), ("global", "global_r"))])


_RK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
_WX = f"(SELECT d, abs(d) AS m, {_RK.format('abs(d)')} AS rk FROM (SELECT round(final_r - orig_r, 12) AS d FROM {Q._NS} WHERE final_r IS NOT NULL) WHERE d <> 0)"


_NSF = f"(SELECT * FROM {Q._NS} WHERE final_r IS NOT NULL)"


@R.add("test_paired_t_w", f"SELECT x.*, {_p_z('z')} AS p_wilcoxon, mean_diff, t, df, cohen_d, p_value, label, median_orig, median_final FROM (SELECT n, least(wp, wm) AS w, (least(wp, wm) - n * (n + 1) / 4.0) / sqrt(n * (n + 1.0) * (2.0 * n + 1) / 24 - tie / 48.0) AS z FROM (SELECT count(*)::DOUBLE AS n, sum(rk) FILTER (d > 0) AS wp, sum(rk) FILTER (d < 0) AS wm FROM {_WX}), (SELECT sum(c * c * c - c) AS tie FROM (SELECT count(*)::DOUBLE AS c FROM {_WX} GROUP BY m))) x, (SELECT * EXCLUDE (n) FROM {_pt(_NSF, 'final_r', 'orig_r')}), (SELECT median(orig_r) AS median_orig, median(final_r) AS median_final FROM {_NSF})", T, doubles="w z p_wilcoxon median_orig median_final " + _PTC, longs="n")
def test_paired_t_w(spark, sf):
    """Signed ranks, paired t, effect and medians; n counts the differences that are not zero."""
    x = stored(Q.no_stop(spark, sf).where("final_r is not null").select("id", "final_r", "orig_r"))
    w = H.wilcoxon(x, "final_r", "orig_r", "id").withColumn("p_wilcoxon", S.normal_pvalue("z"))
    m = selection.quantile_table(x, {"median_orig": ("orig_r", 0.5), "median_final": ("final_r", 0.5)})
    return w.crossJoin(F.broadcast(paired_test(x, "final_r", "orig_r").drop("n"))).crossJoin(F.broadcast(m))


_TT = "{0} * sqrt((n - 2) / (1 - {0} * {0}))"


@R.add("test_spearman_trend", f"SELECT n, rho, slope, {_p_t(_TT.format('rho'), 'n - 2')} AS p_rho, {_p_t(_TT.format('c'), 'n - 2')} AS p_slope FROM (SELECT count(*) AS n, corr(a, b) AS rho, regr_slope(r, seq) AS slope, corr(r, seq) AS c FROM (SELECT seq, r, {_RK.format('seq')} AS a, {_RK.format('round(r, 12)')} AS b FROM (SELECT r, row_number() OVER (ORDER BY t0, id) AS seq FROM trades_r)))", T, doubles="rho slope p_rho p_slope", digits=9)
def test_spearman_trend(spark, sf):
    x = H.trend(realized(spark, sf), "r", ["t0", "id"])
    df = (F.col("n") - 2).cast("double")
    t = lambda c: F.col(c) * F.sqrt(df / F.nullif(1 - F.col(c) * F.col(c), F.lit(0.0)))
    return x.select("n", "rho", "slope", S.t_pvalue(t("rho"), df).alias("p_rho"), S.t_pvalue(t("linear"), df).alias("p_slope"))


@R.add("bayes_beta_binom")
def bayes_beta_binom(spark, sf):
    """Posterior mean and 95 % interval of each condition's win rate under a flat prior."""
    d = pattern_depth1(spark, sf).select("cond", "n", F.round(F.col("win_rate") * F.col("n")).alias("wins"))
    a, b = F.col("wins") + 1, F.col("n") - F.col("wins") + 1
    return d.select("cond", "n", (a / (a + b)).alias("mean"), S.beta_ppf(F.lit(0.025), a, b).alias("lo"), S.beta_ppf(F.lit(0.975), a, b).alias("hi"))


_LB = "lgamma(1 + w) + lgamma(1 + n - w) - lgamma(2 + n) - w * ln(p) - (n - w) * ln(1 - p)"
_BF = f"(SELECT cond, exp(least({_LB}, 700)) AS bayes_factor FROM (SELECT cond, n::DOUBLE AS n, round(win_rate * n) AS w, bw / bn::DOUBLE AS p FROM ({_D1}), {_BASE}))"


def bayes(spark, sf):
    base = X.orders_r(spark, sf).agg(F.avg((F.col("r") > 0).cast("int")).alias("p"))
    x = pattern_depth1(spark, sf).crossJoin(F.broadcast(base))
    return x.withColumn("bayes_factor", S.binomial_bayes_factor(F.round(F.col("win_rate") * F.col("n")), F.col("n").cast("double"), F.col("p")))


@R.add("bayes_factor", f"SELECT cond, ln(bayes_factor) AS log_bf FROM {_BF}", OR, doubles="log_bf", digits=5)
def bayes_factor(spark, sf):
    return bayes(spark, sf).select("cond", F.ln("bayes_factor").alias("log_bf"))


_BL = "CASE WHEN bayes_factor < 1 THEN 'supports_null' WHEN bayes_factor < 3 THEN 'anecdotal' WHEN bayes_factor < 10 THEN 'moderate' WHEN bayes_factor < 30 THEN 'strong' WHEN bayes_factor < 100 THEN 'very_strong' ELSE 'extreme' END"


@R.add("bayes_label", f"SELECT cond, {_BL} AS evidence FROM {_BF}", OR)
def bayes_label(spark, sf):
    f = F.col("bayes_factor")
    return bayes(spark, sf).select("cond", F.when(f < 1, "supports_null").when(f < 3, "anecdotal").when(f < 10, "moderate").when(f < 30, "strong").when(f < 100, "very_strong").otherwise("extreme").alias("evidence"))


@R.add("bayes_attach")
def bayes_attach(spark, sf):
    return bayes_beta_binom(spark, sf).join(bayes_label(spark, sf), "cond")


def equity(spark, sf):
    x = O.row_numbers(O.dealt(realized(spark, sf).select("id", "t0", "r"), ["t0", "id"]), ["t0", "id"], "at")
    return O.trailing(x, "at", 20, lambda f: {"smooth": F.when(F.count("r").over(f) >= 10, F.avg("r").over(f))}).select("id", "t0", "r", "smooth")


_EQUITY = "(SELECT t0, CASE WHEN count(r) OVER w >= 10 THEN round(avg(r) OVER w, 9) END AS smooth FROM trades_r WINDOW w AS (ORDER BY t0, id ROWS 19 PRECEDING))"


@R.add("equity_cusum", f"SELECT t.id, c.ts AS t0, c.x AS smooth FROM {cusum_sql(_EQUITY, 't0', 'smooth', 4.5, 2)} c JOIN trades_r t ON t.t0 = c.ts", T, doubles="smooth")
def equity_cusum(spark, sf):
    x = equity(spark, sf).select("id", "t0", F.round("smooth", 9).alias("smooth"))
    return I.cusum_scan(x, "smooth", ["t0", "id"], threshold=4.5, gap_days=2)


_DAILY = "(SELECT d, CASE WHEN count(*) OVER w >= 10 THEN round(avg(m) OVER w, 9) END AS smooth FROM (SELECT date_trunc('day', t0)::TIMESTAMP AS d, avg(r) AS m FROM orders_r GROUP BY 1) WINDOW w AS (ORDER BY d ROWS 19 PRECEDING))"
_CPA = f"(SELECT ts::DATE AS d FROM {cusum_sql(_DAILY, 'd', 'smooth', 4.5, 2)})"
_CPB = f"(SELECT ts::DATE AS d FROM {cusum_sql(f'({_RV})', 'bar_ts', 'realized_vol')})"


def edge_changes(spark, sf):
    """Change points of the smoothed daily mean R of the orders: (d)."""
    m = X.orders_r(spark, sf).groupBy(F.date_trunc("day", "t0").alias("day")).agg(F.avg("r").alias("m"))
    w = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(-19, 0)  # one row a day
    x = m.withColumn("smooth", F.when(F.count("*").over(w) >= 10, F.round(F.avg("m").over(w), 9)))
    return I.cusum(x.select("day", "smooth"), "smooth", [], "day", threshold=4.5, gap_days=2).select(F.to_date("day").alias("d"))


@R.add("cp_tie", f"SELECT a.d, count(b.d) AS n_near, coalesce(string_agg(b.d::VARCHAR, ',' ORDER BY b.d), '') AS near FROM {_CPA} a LEFT JOIN {_CPB} b ON abs(date_diff('day', a.d, b.d)) <= 30 GROUP BY a.d", ("orders_r", "bars_d1"))
def cp_tie(spark, sf):
    """Change points of the edge with those of volatility within 30 days.

    A band join of two date lists: dates fall into 30-day cells, and a date meets its own and both neighbour cells.
    """
    regimes = I.cusum(I.realized_vol(X.bars_d1(spark, sf), []), "realized_vol", []).select(F.to_date("bar_ts").alias("e"))
    cell = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / 30)
    b = regimes.select("e", F.explode(F.array(cell("e") - 1, cell("e"), cell("e") + 1)).alias("c"))
    x = edge_changes(spark, sf).withColumn("c", cell("d")).join(b, "c", "left")
    near = F.array_sort(F.collect_list(F.when(F.abs(F.datediff("d", "e")) <= 30, F.col("e").cast("string"))))
    return x.groupBy("d").agg(near.alias("x")).select("d", F.size("x").cast("long").alias("n_near"), F.concat_ws(",", "x").alias("near"))


# Scores


def scored(spark, sf):
    """All candidates with their six components.  The minimum and maximum of the effect are taken over them."""
    b = binned(spark, sf, stored(X.orders_r(spark, sf)))  # orders are made once for all parts of the score
    x = with_p(spark, sf, b).join(fold_summary(spark, sf, b), "cond", "left")
    x = stored(x.join(perturbation(spark, sf, b).select("cond", "pass_share", F.col("label").alias("stability")), "cond", "left"))
    mc = monte_carlo(spark, sf, [r["cond"] for r in x.select("cond").collect()], b).select("cond", "sign_flip", "p_value", "verdict")
    x = x.join(F.broadcast(mc), "cond", "left")
    share = F.when(F.col("expectancy") > 0, F.col("positive_folds")).otherwise(F.col("folds_with_data") - F.col("positive_folds")) / F.nullif("folds_with_data", F.lit(0))
    clip = lambda c: F.greatest(F.least(c, F.lit(100.0)), F.lit(0.0))
    w = Window.partitionBy(F.lit(0))  # a row a candidate
    e = F.abs("expectancy")
    span = F.max(e).over(w) - F.min(e).over(w)
    tested = F.contains("cond", F.lit("_bin="))
    return x.withColumns({
        "s_sig": clip(F.coalesce(100 * (1 - F.col("p_fdr")), F.lit(0.0))), "s_wf": clip(F.coalesce(100 * share, F.lit(0.0))), "s_effect": F.coalesce(100 * (e - F.min(e).over(w)) / F.nullif(span, F.lit(0.0)), F.lit(50.0)),
        "s_stability": F.when(tested, clip(F.coalesce(100 * F.col("pass_share"), F.lit(0.0)))).otherwise(50.0), "s_mc": clip(F.coalesce(100 * (1 - F.col("sign_flip")), F.lit(0.0))), "s_sample": clip(100.0 * F.col("n") / 100),
    })


WEIGHTS = {"s_sig": 0.25, "s_wf": 0.20, "s_mc": 0.15, "s_effect": 0.15, "s_stability": 0.15, "s_sample": 0.10}


@R.add("score_components")
def score_components(spark, sf):
    return scored(spark, sf).select("cond", *WEIGHTS)


@R.add("score_total")
def score_total(spark, sf):
    return scored(spark, sf).select("cond", reduce(lambda a, b: a + b, [F.col(c) * w for c, w in WEIGHTS.items()]).alias("score"))


def tier():
    """Only what survives resampling and random subsets is confirmed or exploratory."""
    survives = F.col("verdict") == "survives"
    return F.when(F.col("reject_fdr") & survives & (F.col("n") >= 25), "confirmed").when((F.col("p_exp") < 0.05) & survives, "exploratory").otherwise("rejected_or_low_confidence")


@R.add("score_tier_rank")
def score_tier_rank(spark, sf):
    x = scored(spark, sf).withColumn("score", reduce(lambda a, b: a + b, [F.col(c) * w for c, w in WEIGHTS.items()]))
    return x.select("cond", "n", "expectancy", "score", tier().alias("tier"), F.when(F.col("expectancy") > 0, "positive").otherwise("negative").alias("direction"), "verdict", "stability").orderBy("tier", F.desc("score"))


@R.add("pipeline_pattern")
def pipeline_pattern(spark, sf):
    return score_tier_rank(spark, sf).join(bayes_label(spark, sf), "cond", "left").join(regime_breakdown(spark, sf), "cond", "left")


_C2 = f"(SELECT cond, avg(x) AS e FROM (SELECT c.cond, CASE WHEN c.r > 0 THEN c.r ELSE 0 END AS x FROM ({_CONDS}) c) GROUP BY cond HAVING count(*) >= 20)"


@R.add("cross_target", f"SELECT d.cond, d.expectancy, e AS other_expectancy FROM ({_D1}) d JOIN {_C2} USING (cond)", OR, doubles="expectancy other_expectancy", digits=7)
def cross_target(spark, sf):
    b = binned(spark, sf)
    other = P.group_stats(P.patterns(b.withColumn("r2", F.greatest(F.col("r"), F.lit(0.0))), "id", "r2", COLUMNS, 1), 20)
    return pattern_depth1(spark, sf).select("cond", "expectancy").join(other.select("cond", F.col("expectancy").alias("other_expectancy")), "cond")


def _family_sql(source: str, columns: list[str]) -> str:
    """Statistics, test against all rows and Bonferroni p of every condition of one or two of the columns."""
    sub = " UNION ALL ".join(f"SELECT id, r, '{c}' AS c, '{c}=' || {c}::VARCHAR AS cond FROM fx WHERE {c} IS NOT NULL" for c in columns)
    pairs = "SELECT a.id, a.r, a.cond || ' & ' || b.cond AS cond FROM fc a JOIN fc b ON a.id = b.id AND a.c < b.c"
    stats = f"SELECT * FROM ({_stats('SELECT * FROM fc', 20)} UNION ALL {_stats(pairs, 20)})"
    t = "(expectancy - be) / sqrt(sd * sd / n + bs * bs / bn)"
    df = "pow(sd * sd / n + bs * bs / bn, 2) / (pow(sd * sd / n, 2) / (n - 1) + pow(bs * bs / bn, 2) / (bn - 1))"
    return f"(WITH fx AS MATERIALIZED {source}, fc AS MATERIALIZED ({sub}), ft AS MATERIALIZED (SELECT s.*, {t} AS t, {df} AS df FROM ({stats}) s, {_BASE}), fp AS MATERIALIZED (SELECT *, {_p_t('t', 'df')} AS p_value FROM ft) SELECT * EXCLUDE (t, df), least(1, p_value * count(*) OVER ()) AS p_bonferroni, coalesce(p_value * count(*) OVER () < 0.05, false) AS rejected FROM fp)"


def family(spark, sf, rows, columns: list[str]):
    """A small family of conditions: every one of one or two columns, against all rows, with Bonferroni's correction."""
    x = stored(tested(spark, sf, P.group_stats(P.patterns(rows, "id", "r", columns, 2), 20)).withColumn("p_value", S.t_pvalue("t", "df")))
    m = x.count()
    return x.select("cond", "n", "win_rate", "expectancy", "sd", "profit_factor", "p_value", F.least(F.lit(1.0), F.col("p_value") * m).alias("p_bonferroni"), F.coalesce(F.col("p_value") * m < 0.05, F.lit(False)).alias("rejected"))


_FC = _SC + " p_value p_bonferroni"


def _family(name: str, columns: list[str]):
    @R.add(name, f"SELECT * FROM {_family_sql(_BIN, columns)}", OR, doubles=_FC, digits=7)
    def f(spark, sf):
        return family(spark, sf, binned(spark, sf), columns)


_family("shap_guided", ["acctbal_bin", "cents_bin", "prio"])
_family("shap_interaction", ["acctbal_bin", "cents_bin", "weekday"])

#: Levels and five-day changes of the macro series, as known the day before.
MACRO = ["m_a", "m_n", "m_r", "m_a_chg", "m_n_chg", "m_r_chg"]
_MACRO_DAY = "(SELECT date, lag(round(a, 6)) OVER w AS m_a, lag(round(n, 6)) OVER w AS m_n, lag(round(r, 6)) OVER w AS m_r, lag(round(a_chg, 9)) OVER w AS m_a_chg, lag(round(n_chg, 9)) OVER w AS m_n_chg, lag(round(r_chg, 9)) OVER w AS m_r_chg FROM macro JOIN (" + _CH + ") USING (date) WINDOW w AS (ORDER BY date))"
_MACRO_ROWS = f"(SELECT o.id, o.r, m.* FROM orders_r o JOIN {_MACRO_DAY} m ON m.date = o.t0::DATE)"
_MACRO_BIN = "(WITH mr AS MATERIALIZED " + _MACRO_ROWS + " SELECT mr.*, " + ", ".join(f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} <= q.{c}1 THEN 0 WHEN {c} <= q.{c}2 THEN 1 ELSE 2 END AS {c}_bin" for c in MACRO) + " FROM mr, (SELECT " + ", ".join(f"quantile_cont({c}, 1.0/3) AS {c}1, quantile_cont({c}, 2.0/3) AS {c}2" for c in MACRO) + " FROM mr) q)"


@R.add("macro_pattern", f"SELECT * FROM {_family_sql(_MACRO_BIN, [f'{c}_bin' for c in MACRO])}", (*OR, "macro"), doubles=_FC, digits=7)
def macro_pattern(spark, sf):
    """Conditions of macro levels and changes of the day before, in tertiles over the orders."""
    m = X.macro(spark, sf)
    x = I.change(m, list("anr")).select("date", *(F.round(c, 6).alias(f"m_{c}") for c in "anr"), *(F.round(f"{c}_chg", 9).alias(f"m_{c}_chg") for c in "anr"))
    x = I.shifted(x, MACRO, [], "date")  # one row a day
    rows = stored(X.orders_r(spark, sf).withColumn("date", F.to_date("t0")).join(x, "date").select("id", "r", *MACRO))
    return family(spark, sf, P.tertiles(rows, MACRO), [f"{c}_bin" for c in MACRO])


@R.add("entry_check", "SELECT id, weekday = 3 AND cents > lo AND cents <= hi AS matches FROM orders_r, (SELECT quantile_cont(cents, 1.0/3) AS lo, quantile_cont(cents, 2.0/3) AS hi FROM orders_r)", OR)
def entry_check(spark, sf):
    o = X.orders_r(spark, sf)
    q = selection.quantiles(o, {"lo": ("cents", 1 / 3), "hi": ("cents", 2 / 3)})[0]
    return o.select("id", ((F.col("weekday") == 3) & (F.col("cents") > F.lit(q["lo"])) & (F.col("cents") <= F.lit(q["hi"]))).alias("matches"))
