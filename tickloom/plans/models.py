"""Queries over clusters, models, sources and sinks."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.feature import StringIndexer
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import attribution as A
from ..operators import boosting as G
from ..operators import clusters as C
from ..operators import intervals as J
from ..operators import ordered as OS
from ..sources import fixtures as X
from ..sources import readers as D
from ..sources.scratch import fresh_path as scratch
from ..sources.scratch import stored
from . import market as K
from . import research as N
from . import strategies as Q
from .registry import Registry

R = Registry()
T = ("trades_r",)
O = ("orders_r",)


@R.add("src_trades", "SELECT id, side, t0 AS start_utc, r > 0 AS is_win, r AS r_multiple FROM (SELECT id, side, date_trunc('second', t0)::TIMESTAMP AS t0, round(r, 11) AS r FROM trades_r)", T, doubles="r_multiple", digits=11)
def src_trades(spark, sf):
    """The positions written as a CSV log in local time and read back."""
    t = Q.base(spark, sf)[0]
    local = lambda c: F.date_format(F.from_utc_timestamp(c, "America/New_York"), "yyyy/MM/dd HH:mm:ss")
    r = F.round("r", 11)
    number = lambda c: F.col(c).cast("double")
    text, none = F.lit("x, y"), F.lit(None).cast("double")
    log = t.select(
        F.lit("GBPUSD").alias("pair"), "side", local("t0").alias("dateStart"), local("t1").alias("dateEnd"), F.dayofweek("t0").alias("day"), number("amount").alias("amount"), number("amount").alias("amountClosed"), none.alias("uPnL"), r.alias("rPnL"),
        number("entry").alias("entryPrice"), number("stop").alias("initalSL"), none.alias("maxTP"), number("target").alias("idealTP"), number("exit_px").alias("avgClosePrice"), F.lit("closed").alias("status"), text.alias("tags"), r.alias("avgRiskReward"), F.greatest(r, F.lit(0.0)).alias("maxRiskReward"), "id",
    )
    path = scratch(spark, "trades")
    log.write.option("header", True).csv(path)
    return D.read_trades(spark, path).select("id", "side", "start_utc", "is_win", "r_multiple")


@R.add("src_candles", "SELECT * FROM bars_h1", ("bars_h1",))
def src_candles(spark, sf):
    path = scratch(spark, "bars")
    X.bars_h1(spark, sf).withColumnRenamed("bar_ts", "datetime").write.parquet(path)
    return D.read_bars(spark, path).select("instrument", "bar_ts", "open", "high", "low", "close", "volume")


@R.add("src_macro_csv", "SELECT date, a FROM macro", ("macro",), doubles="a", digits=4)
def src_macro_csv(spark, sf):
    path = scratch(spark, "macro")
    X.macro(spark, sf).select("date", F.coalesce(F.col("a").cast("string"), F.lit(".")).alias("value")).write.option("header", True).csv(path)
    return D.read_series_csv(spark, path, "a")


@R.add("src_macro_json", "SELECT date, r FROM macro WHERE r IS NOT NULL", ("macro",), doubles="r", digits=4)
def src_macro_json(spark, sf):
    m = X.macro(spark, sf).groupBy(F.year("date")).agg(F.sort_array(F.collect_list(F.struct(F.unix_timestamp(F.col("date").cast("timestamp")).alias("s"), F.col("r").alias("v")))).alias("x"))
    j = m.select(F.to_json(F.struct(F.col("x.s").alias("timestamp"), F.col("x.v").alias("close")), {"ignoreNullFields": "false"}).alias("j"))
    return D.read_series_json(j, "j", "r")


@R.add("sink_csv", "SELECT side, instrument, count(*) AS n FROM trades GROUP BY ALL", ("trades",))
def sink_csv(spark, sf):
    path = scratch(spark, "counts")
    D.write_csv(X.trades(spark, sf).groupBy("side", "instrument").agg(F.count("*").alias("n"), F.collect_set("amount").alias("nested")), path)
    return spark.read.schema("side string, instrument string, n bigint").option("header", True).csv(path)


@R.add("sink_report")
def sink_report(spark, sf):
    """Metrics, exit quality, trailing exits, target or stop, and the strongest conditions in one text."""
    actual = Q.summarised(Q.base(spark, sf)[0], {"actual": "r"}, "instrument", "exits").drop("exits")
    parts = [("Actual exits", actual), ("Exit quality", K.exit_quality_summary(spark, sf)), ("Trailing exits", Q.trail_summary(spark, sf)), ("Target or stop", Q.tos_kpis(spark, sf)), ("Strongest conditions by year", N.wf_run(spark, sf))]
    return D.report(parts, "Positions and their exits")


@R.add("sink_html")
def sink_html(spark, sf):
    """Target or stop: figures, months and positions in a page of its own."""
    x = stored(Q.tos(spark, sf))
    trades = x.select("id", "orig_r", "exit_r", "status", "tie").orderBy("id")
    return D.html([("Figures", Q.kpis(x)), ("Months", Q.monthly(x, "exit_r")), ("Positions", trades)], "Target or stop")


# Clusters

FEATURES = ["r", "mfe_r", "mae_r", "n_bars", "amount"]
LEVELS = ["click", "error", "purchase", "signup", "view"]
_HOT = ", ".join(f"CASE WHEN instrument = '{v}' THEN 1 ELSE 0 END AS instrument_{v}" for v in LEVELS)


def matrix(spark, sf):
    t = Q.base(spark, sf)[0]
    return C.one_hot(t, "instrument", LEVELS).dropna(subset=["r", "mfe_r", "mae_r"])


@R.add("cluster_matrix", f"SELECT id, r, mfe_r, mae_r, n_bars, amount, {_HOT} FROM trades_r WHERE mfe_r IS NOT NULL AND mae_r IS NOT NULL", T, doubles="r mfe_r mae_r", digits=11, longs=" ".join(f"instrument_{v}" for v in LEVELS))
def cluster_matrix(spark, sf):
    return matrix(spark, sf).select("id", *FEATURES, *(f"instrument_{v}" for v in LEVELS))


@R.add("cluster_streak", "SELECT instrument, length, start FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY length DESC, start) AS k FROM (SELECT instrument, grp, count(*) AS length, min(t0) AS start FROM (SELECT *, sum((r >= 0)::INT) OVER (PARTITION BY instrument ORDER BY t0, id) AS grp FROM trades_r) WHERE r < 0 GROUP BY 1, 2)) WHERE k = 1", T)
def cluster_streak(spark, sf):
    return C.losing_streak(Q.base(spark, sf)[0], "r", ["t0", "id"], ["instrument"])


def _profile(df):
    return df.groupBy("cluster").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 4).alias(f"mean_{c}") for c in FEATURES))


@R.add("cluster_kmeans")
def cluster_kmeans(spark, sf):
    x = matrix(spark, sf)
    c = C.fit(x, FEATURES)
    return _profile(C.assign(x, c)).withColumn("k", F.lit(c.k)).withColumn("silhouette", F.lit(round(c.silhouette, 4)))


@R.add("cluster_fit")
def cluster_fit(spark, sf):
    c = C.fit(matrix(spark, sf), FEATURES)
    return spark.createDataFrame([(c.k, round(c.silhouette, 4), round(float(c.cost), 4))], "k int, silhouette double, cost double")


@R.add("cluster_assign")
def cluster_assign(spark, sf):
    x = matrix(spark, sf)
    return C.assign(x, C.fit(x, FEATURES)).select("id", "cluster")


@R.add("cluster_winners_losers")
def cluster_winners_losers(spark, sf):
    """Winners, the worst tenth of the losers (15 at least) and the longest losing streak (from 15), clustered apart."""
    x = stored(matrix(spark, sf))
    losers = OS.row_numbers(OS.dealt(x.where("r < 0"), ["r", "id"]), ["r", "id"], "_at").drop(OS.PIECE)
    worst = losers.where(F.col("_at") <= max(15, losers.count() // 10)).drop("_at")
    populations = [("winners", x.where("r > 0")), ("worst_losers", worst)]
    top = C.losing_streak(x, "r", ["t0", "id"], ["instrument"]).orderBy(F.desc("length"), "start").first()
    if top and top["length"] >= 15:
        series = x.where((F.col("instrument") == top["instrument"]) & (F.col("t0") >= F.lit(top["start"])))
        numbered = OS.row_numbers(OS.dealt(series, ["t0", "id"]), ["t0", "id"], "_at").drop(OS.PIECE)
        populations.append(("losing_streak", numbered.where(F.col("_at") <= top["length"]).drop("_at")))
    out = [_profile(C.assign(part, C.fit(part, FEATURES))).withColumn("population", F.lit(name)) for name, part in populations if part.count() >= 15]
    return reduce(lambda a, b: a.unionByName(b), out)


_MODES = {"instrument": "instrument", "side": "side", "regime": "regime", "move": "CASE WHEN mom_15 > 0 THEN 'up' WHEN mom_15 < 0 THEN 'down' END"}


@R.add("cluster_profile", f"WITH cp AS MATERIALIZED (SELECT t.*, cluster, regime, m.v AS mom_15 FROM trades_r t JOIN {Q._CL} USING (id) LEFT JOIN {Q.VOL_SQL} USING (id) JOIN ({Q.look('(close - first_value(open) OVER w)::DOUBLE / first_value(open) OVER w', 15)}) m USING (id)) SELECT * FROM (SELECT cluster, count(*) AS n, avg(r) AS mean_r, avg(mfe_r) AS mean_mfe, avg(mae_r) AS mean_mae, avg(risk) AS mean_risk FROM cp GROUP BY cluster)" + "".join(f" LEFT JOIN (SELECT cluster, v AS {n}_mode FROM (SELECT cluster, {e} AS v FROM cp) WHERE v IS NOT NULL GROUP BY cluster, v QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, v) = 1) USING (cluster)" for n, e in _MODES.items()), T, doubles="mean_r mean_mfe mean_mae mean_risk")
def cluster_profile(spark, sf):
    """Size, means and most frequent instrument, side, volatility regime and move of each cluster; of equally frequent ones the first."""
    p, b = Q.base(spark, sf)
    t = stored(J.latest_bar(Q.clustered(p, b), J.lookback(b, 15), ["mom_15"]).join(Q.vol_regime(spark, sf), "id", "left"))
    out = t.groupBy("cluster").agg(F.count("*").alias("n"), *(F.avg(c).alias(n) for c, n in (("r", "mean_r"), ("mfe_r", "mean_mfe"), ("mae_r", "mean_mae"), ("risk", "mean_risk"))))
    for name, expr in _MODES.items():
        c = t.select("cluster", F.expr(expr).alias("v")).where("v IS NOT NULL").groupBy("cluster", "v").agg(F.count("*").alias("c"))
        top = c.withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("c"), "v"))).where("k = 1").select("cluster", F.col("v").alias(f"{name}_mode"))
        out = out.join(F.broadcast(top), "cluster", "left")  # one row a cluster
    return out


@R.add("holdout_cluster")
def holdout_cluster(spark, sf):
    """Clusters and each cluster's best exit from the first three fifths; how that exit does on the rest, against the actual one."""
    t, b = Q.base(spark, sf)
    x = C.one_hot(t, "instrument", LEVELS).dropna(subset=["r", "mfe_r", "mae_r"])
    s = Q.chrono(Q.wide(spark, sf, Q.SOME, ["r", *FEATURES[1:-1]], (x, b)))
    tried = stored(C.assign(s, C.fit(s.where("part = 'train'"), FEATURES)).select("part", "cluster", "orig_r", *Q.cols(Q.SOME).values()))
    pf = M.finite_profit_factor(F.col("v"))
    train = Q.spread(tried.where("part = 'train'"), Q.cols(Q.SOME), ["cluster"]).groupBy("cluster", "strategy").agg(pf.alias("train_pf"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.round("train_pf", 9).desc_nulls_last(), "strategy"))
    best = train.withColumn("k", rank).where("k = 1").drop("k")
    test = tried.where("part = 'test'").join(F.broadcast(best), "cluster").withColumn("v", Q.picked(F.col("strategy")))  # one row a cluster
    return test.groupBy("cluster", "strategy", "train_pf").agg(F.count("*").alias("n"), F.avg("v").alias("expectancy"), pf.alias("test_pf"), F.avg("orig_r").alias("actual_expectancy"), M.finite_profit_factor(F.col("orig_r")).alias("actual_pf"))


# Attributions by tree path; boosted trees as pyspark.ml grows them stand for those of another library (no cap on leaves but the depth)

LABELS = ["prio", "segment", "status", "weekday"]
NUMBERS = ["acctbal", "cents", "month", "day"]
BOOST = {"maxIter": 100, "maxDepth": 3, "stepSize": 0.05, "minInstancesPerNode": 15}
LEAST_TRAIN, LEAST_TEST = 40, 10


def _model_rows(spark, sf):
    """(yr, r, features): categories as numbers by the alphabet, missing numbers as 0."""
    o = X.orders_r(spark, sf).where("r IS NOT NULL").withColumns({"yr": F.year("t0"), "month": F.month("t0"), "day": F.dayofmonth("t0"), "weekday": F.col("weekday").cast("string")})
    o = o.select("yr", "r", *LABELS, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in NUMBERS))
    indexer = StringIndexer(inputCols=LABELS, outputCols=[f"{c}_i" for c in LABELS], stringOrderType="alphabetAsc", handleInvalid="keep").fit(o)
    return indexer.transform(o).select("yr", "r", *(F.col(f"{c}_i").alias(c) for c in LABELS), *NUMBERS), indexer


def importance(spark, sf):
    """(fold, feature, importance): mean absolute attribution over the year of the fold, of trees fitted on all years before it.

    A fold needs 40 rows before it and 10 in it.  The trees of all folds grow side by side: a level of all takes one scan of the rows.
    """
    o, indexer = _model_rows(spark, sf)
    o = stored(o)
    features = [*LABELS, *NUMBERS]
    n = {r["yr"]: r["count"] for r in o.groupBy("yr").count().collect()}
    years = [y for y in sorted(n) if n[y] >= LEAST_TEST and sum(c for z, c in n.items() if z < y) >= LEAST_TRAIN]
    levels = {c: len(v) + 1 for c, v in zip(LABELS, indexer.labelsArray, strict=True)}  # and one for what is missing
    fitted = G.fit(o, "yr", years, "r", features, levels, *(BOOST[c] for c in ("maxIter", "maxDepth", "stepSize", "minInstancesPerNode")))

    def fold(y: int) -> list[tuple]:
        row = A.mean_absolute(o.where(F.col("yr") == y), A.leaves(*fitted[y]), features).first()
        return [(y, c, float(row[c])) for c in features]

    with ThreadPoolExecutor(4) as pool:
        rows = [r for part in pool.map(inheritable_thread_target(spark)(fold), years) for r in part]
    return spark.createDataFrame(rows, "fold int, feature string, importance double")


@R.add("shap_importance")
def shap_importance(spark, sf):
    return importance(spark, sf).select("fold", "feature", F.round("importance", 9).alias("importance"))


def _ranked(df):
    w = Window.partitionBy("fold").orderBy(F.desc("importance"), "feature")
    return df.withColumn("k", F.row_number().over(w))


def stability(df, k: int = 5):
    """Mean share of common features among the top k of each two folds; stable from 0.6; null under two folds."""
    t = _ranked(df).where(F.col("k") <= k).groupBy("fold").agg(F.collect_set("feature").alias("top"))
    a, b = t.select(F.col("fold").alias("x"), F.col("top").alias("p")), t.select(F.col("fold").alias("y"), F.col("top").alias("q"))
    return a.join(b, F.col("x") < F.col("y")).agg(F.avg(F.size(F.array_intersect("p", "q")) / k).alias("overlap")).withColumn("stable", F.col("overlap") >= 0.6)


def selected(df, k: int = 4):
    """The k features of smallest mean rank over the folds."""
    return _ranked(df).groupBy("feature").agg(F.avg("k").alias("mean_rank")).orderBy("mean_rank", "feature").limit(k)


@R.add("shap_stability")
def shap_stability(spark, sf):
    return stability(importance(spark, sf))


@R.add("shap_select")
def shap_select(spark, sf):
    return selected(importance(spark, sf))
