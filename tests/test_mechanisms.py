"""Ordered scans, quantiles, draws and attributions against plain loops."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest

from tickloom.operators import attribution as A
from tickloom.operators import ordered as O
from tickloom.operators import resampling as B
from tickloom.operators import selection as S
from tickloom.operators import testing as H


def _rows(n=700, seed=3):
    rnd = random.Random(seed)
    return [(i, rnd.choice(["a", "a", "a", "b"]), rnd.randint(0, 40), rnd.choice([-1.5, -1.0, 0.0, 0.25, 2.0])) for i in range(n)]


@pytest.fixture(scope="module", params=[1, 7, 60])
def pieces(request, spark):
    df = spark.createDataFrame(_rows(), "id long, g string, t long, v double").repartition(5)
    return lambda order: O.dealt(df, order, request.param)


def _falls(values):
    total, high, deep = 0.0, None, 0.0
    for v in values:
        total += v
        high = total if high is None else max(high, total)
        deep = max(deep, high - total)
    return deep


def test_drawdown_over_pieces(pieces):
    rows = sorted(_rows(), key=lambda r: (r[2], r[0]))
    assert O.drawdown(pieces(["t", "id"]), "v", ["t", "id"]).first()["max_dd"] == pytest.approx(_falls([r[3] for r in rows]))
    got = {r["g"]: r["max_dd"] for r in O.drawdown(pieces(["g", "t", "id"]), "v", ["t", "id"], ["g"]).collect()}
    assert got == {g: pytest.approx(_falls([r[3] for r in rows if r[1] == g])) for g in "ab"}


def test_drawdown_of_one_key_in_many_pieces(spark):
    df = spark.range(500).selectExpr("id", "7 AS t", "CASE WHEN id % 3 = 0 THEN 2.0D ELSE -1.5D END AS v")
    p = O.dealt(df, ["t", "id"], 40)
    assert p.select(O.PIECE).distinct().count() > 20
    assert O.drawdown(p, "v", ["t", "id"]).first()["max_dd"] == pytest.approx(_falls([2.0 if i % 3 == 0 else -1.5 for i in range(500)]))
    assert O.drawdown(O.dealt(df.where("id < 0"), ["t", "id"], 4), "v", ["t", "id"]).first()["max_dd"] is None


def test_numbers_and_ranks(pieces):
    x = O.row_numbers(pieces(["g", "t", "id"]), ["t", "id"], "k", ["g"]).toPandas()
    x = x.sort_values(["g", "t", "id"])
    assert (x["k"].to_numpy() == x.groupby("g").cumcount().to_numpy() + 1).all()
    y = O.mean_ranks(pieces(["v", "id"]), "v", ["v", "id"], "rk").toPandas()
    assert len(y) == 700 and np.allclose(y["rk"], y["v"].rank(method="average"))


def test_last_before_and_suffix_minimum(pieces):
    from pyspark.sql import functions as F

    p = pieces(["t", "id"]).withColumn("w", F.when(F.col("id") % 9 == 0, F.col("id")))
    x = O.last_before(p, "w", ["t", "id"], "seen").toPandas().sort_values(["t", "id"])
    assert x["seen"].fillna(-1).tolist() == x["w"].ffill().shift(1).fillna(-1).tolist()
    y = O.suffix_minimum(p, "v", ["t", "id"], "low").toPandas().sort_values(["t", "id"])
    assert y["low"].tolist() == y["v"][::-1].cummin()[::-1].tolist()


def test_trailing_blocks(pieces):
    from pyspark.sql import functions as F

    x = O.row_numbers(pieces(["t", "id"]), ["t", "id"], "k")
    y = O.trailing(x, "k", 20, lambda w: {"m": F.sum("v").over(w), "c": F.count("v").over(w)}, block=50).toPandas().sort_values("k")
    assert len(y) == 700 and np.allclose(y["m"], y["v"].rolling(20, min_periods=1).sum()) and y["c"].max() == 20


def test_step_up_adjustment(spark):
    rnd = random.Random(5)
    p = [round(rnd.random() ** 3, 2) for _ in range(300)] + [None] * 4
    df = spark.createDataFrame(list(enumerate(p)), "id long, p double")
    got = {r["id"]: r for r in O.benjamini_hochberg(df, "p", "id").collect()}
    have = sorted((v, i) for i, v in enumerate(p) if v is not None)
    adj, low = {}, 1.0
    for k in range(len(have), 0, -1):
        low = min(low, have[k - 1][0] * len(have) / k)
        adj[have[k - 1][1]] = low
    assert len(got) == 304
    for i, v in enumerate(p):
        assert got[i]["p_fdr"] == (None if v is None else pytest.approx(adj[i]))
        assert got[i]["reject_fdr"] == (v is not None and adj[i] <= 0.05)


def test_image_keeps_order():
    x = np.array([-np.inf, -1e300, -2.0, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1.5, 1e300, np.inf])
    im = S.image(x)
    assert (np.diff(im.astype(object)) >= 0).all() and im[4] == im[5]
    assert [S.value(int(v)) for v in im] == x.tolist()


def test_quantiles_equal_percentile(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["x", "y"]), rnd.choice([None, -3.5, 0.0, 7.25, rnd.gauss(0, 1e3), rnd.random()])) for _ in range(3000)]
    df = spark.createDataFrame([*rows, ("z", None)], "g string, v double")
    qs = {f"q{i}": ("v", q) for i, q in enumerate((0.0, 0.01, 1 / 3, 0.5, 2 / 3, 0.95, 1.0))}
    few = S.FEW
    S.FEW = 5  # so that bins are narrowed to the last bit where values repeat
    try:
        got = {r["g"]: r for r in S.quantiles(df, qs, "g")}
    finally:
        S.FEW = few
    for g in "xy":
        v = [b for a, b in rows if a == g and b is not None]
        for n, (_, q) in qs.items():
            assert got[g][n] == pytest.approx(np.quantile(v, q), rel=1e-12, abs=1e-12)
    assert got["z"]["q3"] is None
    assert S.quantiles(df.where("false"), {"m": ("v", 0.5)}) == [{"m": None}]


def test_permuted_drawdown(spark):
    rows = _rows(300)
    df = spark.createDataFrame(rows, "id long, g string, t long, v double").repartition(4)
    got = {(r["g"], r["iter"]): r["max_dd"] for r in B.permuted_drawdown(df, "v", "id", 12, by="g", bucket_rows=20).collect()}
    ids = np.array([r[0] for r in rows])
    h = B.draws(ids, np.arange(12), 42)
    for g, i in itertools.product("ab", range(12)):
        order = sorted((int(h[i, j]), r[3]) for j, r in enumerate(rows) if r[1] == g)
        assert got[g, i] == pytest.approx(_falls([v for _, v in order]))
    whole = {r["iter"]: r["max_dd"] for r in B.permuted_drawdown(df, "v", "id", 3).collect()}
    assert whole == {i: pytest.approx(_falls([v for _, v in sorted((int(h[i, j]), r[3]) for j, r in enumerate(rows))])) for i in range(3)}


def test_draws_without_replacement_have_their_size(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.gauss(0, 1), [c for c in range(3) if rnd.random() < (0.05, 0.3, 0.45)[c]]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v double, m array<int>").repartition(3)
    sizes = {c: sum(c in m for _, _, m in rows) for c in range(3)}
    got = B.subset_sums(df, "id", "v", "m", sizes, 400, 40).toPandas()
    h = B.draws(np.arange(400), np.arange(40), 42)
    assert len(got) == 120 and (got["n"] == got["cond"].map(sizes)).all()
    for r in got.itertuples():
        first = sorted((int(h[r.iter, i]), i) for i, _, m in rows if r.cond not in m)[: sizes[r.cond]]
        assert r.s == pytest.approx(sum(rows[i][1] for _, i in first)) and r.wins == sum(rows[i][1] > 0 for _, i in first)


def test_signed_ranks(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice([0.0, 1.0, 2.0, 3.0]), rnd.choice([0.0, 1.0, 2.5])) for i in range(200)]
    got = H.wilcoxon(spark.createDataFrame(rows, "id long, a double, b double"), "a", "b", "id").first()
    d = pd.Series([a - b for _, a, b in rows])
    d = d[d != 0]
    rk = d.abs().rank()
    w, n = min(rk[d > 0].sum(), rk[d < 0].sum()), len(d)
    tie = sum(c**3 - c for c in d.abs().value_counts())
    assert got["n"] == n and got["w"] == w
    assert got["z"] == pytest.approx((w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48))


def _plain_value(tree, x, known):
    """Expected value of a tree where only the features in ``known`` are given, by rows of training data elsewhere."""
    nodes = {n["id"]: n for n in tree}

    def at(i):
        n = nodes[i]
        if n["leftChild"] < 0:
            return n["prediction"]
        s = n["split"]
        listed = s["leftCategoriesOrThreshold"]
        left = x[s["featureIndex"]] <= listed[0] if s["numCategories"] < 0 else x[s["featureIndex"]] in listed
        if s["featureIndex"] in known:
            return at(n["leftChild"] if left else n["rightChild"])
        a, b = nodes[n["leftChild"]], nodes[n["rightChild"]]
        return (a["rawCount"] * at(a["id"]) + b["rawCount"] * at(b["id"])) / n["rawCount"]

    return at(0)


def test_attributions_equal_subset_enumeration(spark, tmp_path):
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rnd = random.Random(7)
    rows = [(rnd.choice("pqr"), rnd.random(), float(rnd.randint(0, 5))) for _ in range(300)]
    df = spark.createDataFrame([(c, a, b, (c == "q") * a * 3 + b * b - (c == "r") + rnd.random() / 9) for c, a, b in rows], "c string, a double, b double, y double")
    df = StringIndexer(inputCol="c", outputCol="ci", stringOrderType="alphabetAsc").fit(df).transform(df)
    features = ["ci", "a", "b"]
    x = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    m = GBTRegressor(featuresCol="features", labelCol="y", maxIter=5, maxDepth=3, minInstancesPerNode=15, seed=1).fit(x)
    trees = A.node_table(m, str(tmp_path / "trees"))
    assert any(n["split"]["numCategories"] > 0 for t in trees for n in t)
    found = A.leaves(trees, list(m.treeWeights))
    some = m.transform(x).select(*features, "prediction").limit(25).toPandas()
    got = A.shapley(found, some[features].to_numpy(float))
    assert np.allclose(got.sum(axis=1) + A.base_value(found), some["prediction"])
    for row, values in zip(some[features].to_numpy(float)[:6], got, strict=False):
        for i in range(3):
            rest = [j for j in range(3) if j != i]
            want = 0.0
            for k in range(3):
                for s in itertools.combinations(rest, k):
                    w = math.factorial(k) * math.factorial(2 - k) / math.factorial(3)
                    want += w * sum(tw * (_plain_value(t, row, {*s, i}) - _plain_value(t, row, set(s))) for t, tw in zip(trees, m.treeWeights, strict=True))
            assert values[i] == pytest.approx(want)
    mean = A.mean_absolute(df, found, features).first()
    whole = A.attributions(df.withColumn("id", df["b"]), found, features, ["id"]).toPandas()
    assert len(whole) == 300 and all(mean[c] == pytest.approx(whole[c].abs().mean()) for c in features)


def test_draws_from_windows_that_narrow(spark, monkeypatch):
    """Parts of more rows than are read are narrowed, and rows meet a table of edges in place of each condition's window."""
    monkeypatch.setattr(B, "READ", 1)
    monkeypatch.setattr(B, "BLOCK", 150)
    rnd = random.Random(8)
    rows = [(i, rnd.gauss(0, 1), [c for c in range(3) if rnd.random() < (0.02, 0.3, 0.48)[c]]) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, v double, m array<int>").repartition(3)
    sizes = {c: sum(c in m for _, _, m in rows) for c in range(3)}
    h = B.draws(np.arange(900), np.arange(9), 42)
    got = B.subset_sums(df, "id", "v", "m", sizes, 900, 9).toPandas()
    assert len(got) == 27 and (got["n"] == got["cond"].map(sizes)).all() and B._bins(np.array([3, 9]))[0][[2, 3, 8, 9]].tolist() == [0, 1, 1, 2]
    for r in got.itertuples():
        first = sorted((int(h[r.iter, i]), i) for i, _, m in rows if r.cond not in m)[: sizes[r.cond]]
        assert r.s == pytest.approx(sum(rows[i][1] for _, i in first))


def test_boosted_trees_side_by_side(spark, tmp_path):
    """Each fold's trees predict as those that pyspark.ml fits on its rows alone."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    from pyspark.sql import functions as F

    from tickloom.operators import boosting as G

    g = np.random.default_rng(8)
    n = 1500
    rows = [(int(y), "abcd"[k], float(i), float(j), float(np.sin(i / 5) + (k == 2) * j / 9 + e)) for y, k, i, j, e in zip(g.integers(2000, 2004, n), g.integers(0, 4, n), g.integers(0, 29, n), g.integers(0, 12, n), g.normal(0, 0.3, n))]
    df = spark.createDataFrame(rows, "yr int, c string, i double, j double, r double").repartition(3)
    df = StringIndexer(inputCol="c", outputCol="k", stringOrderType="alphabetAsc", handleInvalid="keep").fit(df).transform(df)
    features = ["k", "i", "j"]
    fitted = G.fit(df, "yr", [2002, 2003], "r", features, {"k": 5}, trees=12, depth=3, rate=0.05, least=15)
    for year, (trees, weights) in fitted.items():
        found = A.leaves(trees, weights)
        x = VectorAssembler(inputCols=features, outputCol="features").transform(df)
        m = GBTRegressor(featuresCol="features", labelCol="r", maxIter=12, maxDepth=3, stepSize=0.05, minInstancesPerNode=15, seed=42).fit(x.where(F.col("yr") < year))
        some = m.transform(x).select(*features, "prediction").toPandas()
        assert np.allclose(A.shapley(found, some[features].to_numpy(float)).sum(axis=1) + A.base_value(found), some["prediction"])
    assert G.fit(df, "yr", [], "r", features, {"k": 5}, trees=2, depth=3, rate=0.05, least=15) == {}


def test_cuts_at_even_shares():
    from tickloom.operators import boosting as G

    assert G.midpoints({1.0: 5, 2.0: 1, 4.0: 9}) == [1.5, 3.0]
    many = G.midpoints({float(v): 1 for v in range(3200)})
    assert len(many) == 31 and all(abs(c - 100 * (k + 1)) <= 1 for k, c in enumerate(many))


def test_quantiles_bring_a_row_a_rank_to_the_driver(spark, monkeypatch):
    """Many distinct values, groups and ranks: neither counts nor values of a bin are collected."""
    frame = type(spark.range(1))
    most, plain = [], frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: most.append(len(got := plain(self))) or got)
    df = spark.range(40000).selectExpr("cast(id % 3 as string) AS g", "cast(id * 7919 % 40009 as double) / 7 AS v", "exp(id % 97) AS w")
    got = S.quantiles(df, {f"{c}{k}": (c, k / 8) for c in "vw" for k in range(9)}, "g")
    assert max(most) <= 3 * 2 * 9 * 2
    x = df.toPandas()
    for r in got:
        for c in "vw":
            assert [r[f"{c}{k}"] for k in range(9)] == pytest.approx(np.quantile(x[c][x["g"] == r["g"]], np.arange(9) / 8).tolist(), rel=1e-12)


def test_cusum_of_a_long_series_goes_by_batches(spark):
    """The same alarms as by a fold over the whole series, in batches shorter than a run; too short a series has none."""
    import datetime as dt

    from tickloom.operators import indicators as I

    g = np.random.default_rng(11)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=5 * i), None if i % 17 == 3 else float(round(g.normal(i % 200 > 120), 9))) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, t0 timestamp, smooth double").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for gap in (None, 2, 20):
            got = I.cusum_scan(df, "smooth", ["t0", "id"], gap_days=gap).collect()
            assert len(got) > 3 and {tuple(r) for r in got} == {tuple(r) for r in I.cusum(df, "smooth", [], "t0", gap_days=gap).collect()}
        assert I.cusum_scan(df.where("id < 29"), "smooth", ["t0", "id"], threshold=0.1).count() == 0
        assert I.cusum_scan(df.where("id < 40"), "smooth", ["t0", "id"], threshold=0.1).count() == I.cusum(df.where("id < 40"), "smooth", [], "t0", threshold=0.1).count() > 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
