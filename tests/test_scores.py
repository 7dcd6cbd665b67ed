"""Tiers with their resampling verdict, and folds of the models."""

import numpy as np
from pyspark.sql import functions as F

from tickloom.operators import resampling as B
from tickloom.plans import models, research
from tickloom.sources import fixtures as X


def test_sign_flips(spark):
    g = np.random.default_rng(1)
    values = {"up": g.normal(1, 1, 80), "weak": g.normal(0, 1, 60), "down": g.normal(-0.2, 1, 50)}
    rows = [(i, float(v), c) for c, x in values.items() for i, v in enumerate(x)]
    got = {r["cond"]: r["sign_flip"] for n in (1, 5) for r in B.sign_flips(spark.createDataFrame(rows, "id bigint, target double, cond string").repartition(n), "id", 5000).collect()}
    for c, x in values.items():
        means = x[g.integers(0, len(x), (5000, len(x)))].mean(axis=1)
        assert abs(got[c] - np.mean((means > 0) != (x.mean() > 0))) < 0.03, c


def test_resampled_sums(spark):
    """Against plain loops: weights by key and iteration, groups, nulls, repeated and null keys, an empty table."""
    rows = [(1, "a", 2.0), (2, "a", None), (2, "b", 1.5), (2, "b", 0.5), (None, "b", 4.0), (2**40 + 7, None, -1.0)]
    mask, want = 2**32 - 1, {}

    def mixed(h):
        for shift, factor in ((16, B.MIX[0]), (13, B.MIX[1])):
            h = (h ^ h >> shift) * factor & mask
        return h ^ h >> 16

    for k, g, v in rows:
        k = k or 0
        for i in range(40):
            h = mixed(mixed((k ^ k >> 32) & mask ^ 42) + i * B.STEP & mask)
            want[g, i] = want.get((g, i), 0.0) + sum(h >= t for t in B.DRAWN) * (v or 0.0)
    df = spark.createDataFrame(rows, "id bigint, iter string, v double")
    for n in (1, 4):
        got = B.resampled_sums(df.repartition(n), "id", {"s": F.col("v")}, 40).count()
        assert got == 40
        named = df.withColumnRenamed("iter", "grp").repartition(n)
        assert {(r["grp"], r["iter"]): r["s"] for r in B.resampled_sums(named, "id", {"s": F.col("v")}, 40, by="grp").collect()} == want
    assert B.resampled_sums(df.limit(0), "id", {"s": F.col("v")}, 40).count() == 0


def test_draws_are_poisson_and_chances_hold(spark):
    w = B._weights(np.arange(2000), np.arange(500), 42, None)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.01
    assert abs(B._weights(np.arange(2000), np.arange(500), 42, np.full(2000, 0.3)).mean() - 0.3) < 0.005
    assert abs(np.corrcoef(w[:, :50].T)[np.triu_indices(50, 1)]).max() < 0.25


def test_tier_needs_survival(spark):
    rows = [(True, "survives", 30, 0.001), (True, "fragile", 30, 0.001), (False, "survives", 30, 0.01), (False, "like_random_subset", 30, 0.01), (True, None, 30, 0.001), (True, "survives", 20, 0.2)]
    x = spark.createDataFrame(rows, "reject_fdr boolean, verdict string, n int, p_exp double").coalesce(1)
    low = "rejected_or_low_confidence"
    assert [r[0] for r in x.select(research.tier()).collect()] == ["confirmed", low, "exploratory", low, low, low]


def test_folds_and_their_gates(spark, sf_dir, monkeypatch):
    """Every year with 40 rows before it and 10 in it is a fold; the features are those of the model."""
    monkeypatch.setitem(models.BOOST, "maxIter", 2)
    n = {r["yr"]: r["n"] for r in X.orders_r(spark, sf_dir).groupBy(F.year("t0").alias("yr")).agg(F.count("*").alias("n")).collect()}
    want = {y for y in n if n[y] >= 10 and sum(c for z, c in n.items() if z < y) >= 40}
    got = models.importance(spark, sf_dir).collect()
    assert {r["fold"] for r in got} == want and {r["feature"] for r in got} == {*models.LABELS, *models.NUMBERS}
    top = models.stability(spark.createDataFrame(got)).first()
    assert 0 <= top["overlap"] <= 1 and models.selected(spark.createDataFrame(got)).count() == 4


def test_monte_carlo_of_a_condition(spark, sf_dir):
    """Exact sizes: the p value of a condition equals that of plain draws by the same hashes; small conditions are not drawn for."""
    conds = ["weekday=3", "cents_bin=0 & status=F", "prio=1-URGENT"]
    got = {r["cond"]: r for r in research.monte_carlo(spark, sf_dir, conds).collect()}
    o = research.binned(spark, sf_dir).select("id", "r", *research.COLUMNS).toPandas()
    h = B.draws(o["id"].to_numpy(), np.arange(5000), 42)
    for c in conds:
        mask = np.ones(len(o), bool)
        for k, v in (p.split("=") for p in c.split(" & ")):
            mask &= o[k].astype(float).eq(float(v)).to_numpy() if k in ("weekday", "cents_bin") else o[k].eq(v).to_numpy()
        r, ids, hh = o["r"].to_numpy()[~mask], o["id"].to_numpy()[~mask], h[:, ~mask]
        n, obs, cm = int(mask.sum()), o["r"][mask].mean(), r.mean()
        drawn = np.array([r[np.lexsort((ids, x))[:n]].mean() for x in hh])
        assert got[c]["n"] == n and abs(got[c]["p_value"] - np.mean(np.round(abs(drawn - cm), 12) >= round(abs(obs - cm), 12))) < 1e-9, c


def test_clusters_side_by_side(spark):
    """No dearer than pyspark.ml from the same starting centres; the cheapest of the restarts is kept; ties go to the first centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    from tickloom.operators import clusters as C

    g = np.random.default_rng(3)
    rows = [tuple(float(v) for v in g.normal(c, 0.6, 2)) for c in ((0, 0), (4, 4), (0, 5)) for _ in range(80)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(3)
    fitted = C.fit(df, ["a", "b"])
    assert fitted.k == 3 and fitted.silhouette > 0.8
    marked = C.assign(df, fitted).toPandas()
    assert sorted(marked["cluster"].value_counts()) == [80, 80, 80]
    z = (np.array(rows) - fitted.means) / fitted.scales
    first = [C.starts(z, 3, np.random.default_rng(i)) for i in range(10)]
    x = spark.createDataFrame([tuple(map(float, r)) for r in z], "a double, b double")
    together, costs = C.fit_all(x, first)
    alone = [C.fit_all(x, [f]) for f in first]
    assert np.allclose(costs, [c[0] for _, c in alone]) and all(np.allclose(m, n[0]) for m, (n, _) in zip(together, alone, strict=True))
    ml = min(KMeans(k=3, seed=i, maxIter=50).fit(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(x)).summary.trainingCost for i in range(3))
    assert min(costs) <= ml * (1 + 1e-6)


def test_windows_from_spans(spark):
    """Equal to a look at every bar, for windows shorter and longer than the top span and with gaps."""
    import datetime as dt
    import random

    from tickloom.operators import intervals as J

    rnd = random.Random(4)
    day = dt.datetime(2024, 1, 1)
    bars = [("x", day + dt.timedelta(hours=h), float(rnd.randint(0, 99)), float(rnd.randint(-99, 0)), float(h)) for h in range(300) if rnd.random() < 0.6]
    spans = [(i, "x" if i else "none", day + dt.timedelta(minutes=m), day + dt.timedelta(minutes=m + n)) for i, (m, n) in enumerate((rnd.randint(-900, 18000), rnd.choice([0, 30, 61, 600, 6000, 17000])) for _ in range(120))]
    t = spark.createDataFrame(spans, "id int, instrument string, t0 timestamp, t1 timestamp")
    b = spark.createDataFrame(bars, "instrument string, bar_ts timestamp, high double, low double, close double")
    for levels in (3, 11):
        got = {r["id"]: (r["last"], r["h"], r["l"]) for r in J.window_extremes(t, b, F.col("t0"), F.col("t1"), levels=levels).collect()}
        want = {}
        for i, name, s, e in spans:
            inside = [x for x in bars if x[0] == name and s <= x[1] <= e]
            if inside:
                want[i] = (inside[-1][4], max(x[2] for x in inside), min(x[3] for x in inside))
        assert got == want


def test_reports_carry_their_tables(spark):
    import json
    import re

    from tickloom.sources import readers as D

    a = spark.createDataFrame([(1, "x"), (2, None)], "n int, t string")
    b = spark.createDataFrame([("</script><b>",)], "note string")
    text = D.report([("First", a), ("Second", b)], "Whole").first()["report"]
    assert text == "# Whole\n\n## First\n\n| n | t |\n|---|---|\n| 1 | x |\n| 2 | — |\n\n## Second\n\n| note |\n|---|\n| </script><b> |\n"
    page = D.html([("First", a), ("Second", b)], "A < B").first()["page"]
    data = json.loads(re.search(r'id="data">(.*?)</script>', page, re.S)[1])
    assert data == [{"title": "First", "columns": ["n", "t"], "rows": [{"n": 1, "t": "x"}, {"n": 2}]}, {"title": "Second", "columns": ["note"], "rows": [{"note": "</script><b>"}]}]
    assert "<title>A &lt; B</title>" in page


def test_orders_are_binned_once_for_a_score(spark, sf_dir, monkeypatch):
    """All parts of the score read one table of orders and bins."""
    made, plain = [], research.binned
    monkeypatch.setattr(research, "binned", lambda *a: made.append(1) or plain(*a))
    monkeypatch.setattr(research, "monte_carlo", lambda spark, sf, conds, rows: spark.createDataFrame([(c, 0.0, 1.0, "survives") for c in conds], "cond string, sign_flip double, p_value double, verdict string"))
    assert research.scored(spark, sf_dir).count() > 0 and len(made) == 1


def test_centres_of_all_restarts_in_one_product(spark):
    """Sums equal plain loops, the first of equally near centres takes a row, and silhouettes equal those of pyspark.ml."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    from tickloom.operators import clusters as C

    g = np.random.default_rng(5)
    z = np.concatenate([g.normal(size=(3000, 2)), g.integers(-2, 3, (700, 2)).astype(float), [[1e4, -1e4]]])
    models = [np.array([[-1.0, 0], [1, 0], [0, 0]]), np.array([[1.0, 1], [-1, -1]]), z[:4], np.array([[0.0, 0], [0, 0], [1e9, 1e9]]), z[5:8]]
    x = spark.createDataFrame([tuple(map(float, r)) for r in z], "a double, b double").repartition(3)
    for m, t in zip(models, C.totals(x, models), strict=True):
        near = np.array([((z - c) ** 2).sum(axis=1) for c in m]).argmin(axis=0)
        want = np.array([[*z[near == j].sum(axis=0), (near == j).sum(), (z[near == j] ** 2).sum()] for j in range(len(m))])
        assert (t[:, 2] == want[:, 2]).all() and np.allclose(t, want)
    for m, cost in zip(models, C.advance(x, models)[1], strict=True):
        assert np.isclose(cost, np.array([((z - c) ** 2).sum(axis=1) for c in m]).min(axis=0).sum())
    for m, got in zip(models, C.silhouettes(x, models), strict=True):
        marked = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(x).withColumn("prediction", C.nearest(["a", "b"], np.zeros(2), np.ones(2), m).cast("double"))
        assert abs(got - (ClusteringEvaluator().evaluate(marked) if marked.select("prediction").distinct().count() > 1 else -1.0)) < 1e-9


def test_blocks_count_for_sets_of_conditions():
    """Counts, sums and windows of a block equal plain masks, for more conditions than a word has bits and for rows without any."""
    import pyarrow as pa

    g = np.random.default_rng(7)
    for conds in ([3, 4, 9], list(range(40))):
        member = g.random((500, len(conds))) < 0.1
        met = [[conds[j] for j in np.flatnonzero(r)] for r in member]
        v = g.normal(size=500)
        b = B._Block([pa.RecordBatch.from_arrays([pa.array(np.arange(a, z)), pa.array(v[a:z]), pa.array(met[a:z], pa.list_(pa.int32()))], ["k", "v", "m"]) for a, z in ((0, 200), (200, 500))], conds, 42)
        member, v = member[b.keys], v[b.keys]
        assert (b.values == v).all()
        for it in (0, 5):
            head = b.heads(it)
            assert (head == B.draws(b.keys, np.array([it]), 42)[0] >> 16).all()
            low = g.integers(0, 1 << 16, len(conds))
            low[:2] = low[0], 0
            high = np.minimum(low + 9000, 1 << 16)
            assert (b.every(head, low) == [(head < e).sum() for e in low]).all()
            under = head[:, None] < low
            assert (b.before(head, low, True)[0] == (under & member).sum(axis=0)).all()
            n, wins, total = b.before(head, low, False)
            assert (n == (under & ~member).sum(axis=0)).all() and (wins == (under & ~member & (v > 0)[:, None]).sum(axis=0)).all() and np.allclose(total, ((under & ~member) * v[:, None]).sum(axis=0))
            for inside, of in ((True, member), (False, ~member)):
                want = (head[:, None] >= low) & (head[:, None] < high) & of
                assert set(zip(*(x.tolist() for x in b.within(head, low, high, inside)), strict=True)) == {(j, i) for i, j in zip(*(x.tolist() for x in np.nonzero(want)), strict=True)}


def test_orders_of_a_score_are_made_once(spark, sf_dir, monkeypatch):
    """Bins, base rates and all parts of the score read one written table of orders."""
    made, plain = [], X.orders_r
    monkeypatch.setattr(X, "orders_r", lambda *a: made.append(1) or plain(*a))
    monkeypatch.setattr(research, "monte_carlo", lambda spark, sf, conds, rows: spark.createDataFrame([(c, 0.0, 1.0, "survives") for c in conds], "cond string, sign_flip double, p_value double, verdict string"))
    assert research.scored(spark, sf_dir).count() > 0 and len(made) == 1


def test_first_windows_are_summed_in_their_pass():
    """Sums under windows, rows inside of them and in the parts chosen equal plain masks, in slices of a block with few and with many sets."""
    import pyarrow as pa

    g = np.random.default_rng(9)
    for count, chance in ((3, 0.3), (40, 0.1)):
        conds = list(range(count))
        member = g.random((1500, count)) < chance
        v = g.normal(size=1500)
        whole = B._Block([pa.RecordBatch.from_arrays([pa.array(np.arange(1500)), pa.array(v), pa.array([list(np.flatnonzero(r)) for r in member], pa.list_(pa.int32()))], ["k", "v", "m"])], conds, 42)
        low, step = g.integers(0, 60000, count), g.integers(1, 200, count)
        low[0] = 65000  # a window beyond all heads
        places, part = B._Places(low, step), g.integers(0, B.PARTS, count)
        slices = list(whole.cut(400))
        assert sorted(np.concatenate([b.keys for b in slices])) == list(range(1500)) and len(slices) == 4
        for b in slices:
            m, x = member[b.keys], v[b.keys]
            assert (b.values == x).all()
            head = b.heads(3)
            assert (head == B.draws(b.keys, np.array([3]), 42)[0] >> 16).all()
            stretch, at = b.met(head, places)
            windows = (head[:, None] >= low) & (head[:, None] < places.high)
            assert (at == np.flatnonzero(windows.any(axis=1))).all()
            below = (head[:, None] < low) & ~m
            n, wins, total = b.under(stretch, places)
            assert (n == below.sum(axis=0)).all() and (wins == (below & (x > 0)[:, None]).sum(axis=0)).all() and np.allclose(total, (below * x[:, None]).sum(axis=0))
            pairs = lambda c, r: set(zip(c.tolist(), r.tolist(), strict=True))
            assert pairs(*b.inside(head[at], at, low, places.high)) == pairs(*np.nonzero((windows & m).T))
            lo, hi = np.minimum(low + part * step, 1 << 16), np.minimum(low + (part + 1) * step, 1 << 16)
            chosen = (head[:, None] >= lo) & (head[:, None] < hi)
            few = at[places.chosen(part)[places.part[head[at]]]]
            assert (few == np.flatnonzero(chosen.any(axis=1))).all() and pairs(*b.last(head[few], few, lo, hi)) == pairs(*np.nonzero((chosen & ~m).T))


def test_every_candidate_is_scored(spark, sf_dir, monkeypatch):
    """No candidate of depth one or two is left out of the score."""
    monkeypatch.setattr(research, "monte_carlo", lambda spark, sf, conds, rows: spark.createDataFrame([(c, 0.0, 1.0, "survives") for c in conds], "cond string, sign_flip double, p_value double, verdict string"))
    want = {r["cond"] for r in research.depth2(spark, sf_dir).select("cond").collect()}
    got = [r["cond"] for r in research.scored(spark, sf_dir).select("cond").collect()]
    assert len(got) == len(want) > 30 and set(got) == want


def test_draws_in_blocks_of_iterations(spark, monkeypatch):
    """Many conditions: the same draws and bootstrap sums, whether iterations go in one block or in several."""
    g = np.random.default_rng(4)
    rows = [(i, float(v), np.flatnonzero(g.random(70) < 0.1).tolist()) for i, v in enumerate(g.normal(size=600))]
    df = spark.createDataFrame(rows, "id long, v double, m array<int>").repartition(3)
    sizes = {c: sum(c in m for _, _, m in rows) for c in range(70)}
    monkeypatch.setattr(B, "DRAWS", 70 * 4)
    got = B.subset_sums(df, "id", "v", "m", sizes, 600, 10).toPandas().set_index(["cond", "iter"]).sort_index()
    h, values = B.draws(np.arange(600), np.arange(10), 42), np.array([v for _, v, _ in rows])
    w = B._weights(np.arange(600), np.arange(10), 42, None)
    sums = {(r["cond"], r["iter"]): r["s"] for r in B.condition_sums(df, "id", "v", "m", list(range(70)), 10).collect()}
    assert len(got) == 700 and len(sums) == 700
    for c in range(70):
        inside = np.array([c in m for _, _, m in rows])
        out = np.flatnonzero(~inside)
        for i in range(10):
            first = out[np.lexsort((out, h[i, out]))[: sizes[c]]]
            assert np.isclose(got.loc[(c, i), "s"], values[first].sum()) and got.loc[(c, i), "wins"] == (values[first] > 0).sum() and got.loc[(c, i), "n"] == sizes[c]
            assert np.isclose(sums[c, i], (w[i] * values * inside).sum())
