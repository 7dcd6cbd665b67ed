"""Positions folded over their bars, falls of many columns, and the first share of rows, against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import exits as E
from tickloom.operators import intervals as J
from tickloom.operators import ordered as O

T0 = dt.datetime(2024, 1, 1)
H = dt.timedelta(hours=1)


@pytest.fixture(scope="module")
def market():
    rnd = random.Random(5)
    bars, px = [], 1000
    for h in range(240):
        if rnd.random() < 0.15:
            continue
        o, px = px, px + rnd.randint(-30, 30)
        bars.append(("a", T0 + h * H, o, max(o, px) + rnd.randint(0, 9), min(o, px) - rnd.randint(0, 9), px))
    trades = []
    for i in range(300):
        t, side, risk = T0 + rnd.randint(-50, 260) * H + rnd.choice([0, 1, 1800]) * dt.timedelta(seconds=1), rnd.choice(["buy", "sell"]), rnd.choice([20, 40])
        s = 1 if side == "buy" else -1
        e = 1000 + rnd.randint(-60, 60)
        trades.append((i, rnd.choice(["a", "a", "a", "b", None]), t, t + rnd.randint(0, 30) * H, side, e, risk, e - s * risk, None if i % 17 == 0 else e + s * 2 * risk, 1, 0.5))
    return trades, bars


def _frames(spark, market):
    t = spark.createDataFrame(market[0], "id long, instrument string, t0 timestamp, t1 timestamp, side string, entry long, risk long, stop long, target long, amount long, r double")
    return t, spark.createDataFrame(market[1], "instrument string, bar_ts timestamp, open long, high long, low long, close long")


@pytest.mark.parametrize("part", [1 << 16, 3])
def test_trailing_and_target_by_plain_loop(spark, market, part, monkeypatch):
    monkeypatch.setattr(J, "GROUP_ROWS", part)
    t, b = _frames(spark, market)
    x = E.exits(t, b, {"trail": E.trailing(0.2), "target": E.fixed_target()})
    assert "Window" not in x._jdf.queryExecution().toString()  # pairs of positions and bars are no rows
    got = {r["id"]: (r["c0"], r["a0"], r["c1"], r["a1"]) for r in x.collect()}
    assert len(got) == 300
    for i, inst, t0, t1, side, entry, risk, stop, target, _, _ in market[0]:
        s, peak, found = (1 if side == "buy" else -1), entry, {}
        for g, ts, o, hi, lo, _c in market[1]:
            if g != inst or not t0 <= ts <= t1 + 72 * H:
                continue
            adverse, favour = (lo, hi) if s > 0 else (hi, lo)
            level = stop
            if s * (peak - entry) / risk >= E.ACTIVATION:
                way = peak - 0.2 * (peak - entry)
                level = max(stop, way) if s > 0 else min(stop, way)
            if s * (adverse - level) <= 0:
                found.setdefault("trail", (s * ((min if s > 0 else max)(level, o) - entry) / risk, ts <= t1))
            if target is not None and s * (favour - target) >= 0:
                found.setdefault("target", (s * (target - entry) / risk, ts <= t1))
            elif s * (adverse - stop) <= 0:
                found.setdefault("target", (s * ((min if s > 0 else max)(stop, o) - entry) / risk, ts <= t1))
            peak = max(peak, favour) if s > 0 else min(peak, favour)
        want = [v for n in ("trail", "target") for v in ((found[n][0] if found[n][1] else None, found[n][0]) if n in found else (None, None))]
        assert [None if v is None else round(v, 9) for v in got[i]] == [None if v is None else round(v, 9) for v in want], i


def test_last_bar_before(spark, market):
    t, b = _frames(spark, market)
    got = {r["id"]: r["close"] for r in J.latest_bar(t, b, ["close"]).collect()}
    for i, inst, t0, *_ in market[0]:
        before = [c for g, ts, _o, _h, _l, c in market[1] if g == inst and ts < t0]
        assert got[i] == (before[-1] if before else None)


def test_falls_of_columns_in_one_pass(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.randint(0, 50), rnd.choice("ab"), *(rnd.choice([None, -1.0, -2.0, 0.5, 2.0]) for _ in range(2)), None) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, t int, g string, x double, y double, z double")
    got = {(r["g"], r["label"]): r["max_dd"] for r in O.falls(df, {"x": "x", "y": "y", "z": "z"}, ["t", "id"], "g", pieces=9).collect()}
    want = {}
    for g in "ab":
        for j, c in ((3, "x"), (4, "y")):
            total, high, deep = 0.0, None, 0.0
            for r in sorted((r for r in rows if r[2] == g and r[j] is not None), key=lambda r: (r[1], r[0])):
                total += r[j]
                high = total if high is None else max(high, total)
                deep = max(deep, high - total)
            want[g, c] = pytest.approx(deep)
    assert got == want


@pytest.mark.parametrize("share", [0.0, 0.6, 1.0])
def test_first_share(spark, share):
    df = spark.range(203).selectExpr("id", "CAST(id * 7 % 11 AS INT) AS t").repartition(5)
    got = {r["id"] for r in O.first_share(df, ["t", "id"], share).where("train").collect()}
    order = sorted(range(203), key=lambda i: (i * 7 % 11, i))
    assert got == set(order[: int(share * 203)])


def test_trailing_grid_keeps_every_position(spark, sf_dir):
    from tickloom.plans import catalog

    x = catalog.QUERIES["sim_trailing_grid"](spark, sf_dir)
    assert x.count() == catalog.QUERIES["sim_trailing"](spark, sf_dir).count()


def test_orders_move_no_rows(spark):
    from tickloom.operators import resampling as B

    df = spark.range(400).selectExpr("id", "CAST(id % 7 - 3 AS DOUBLE) AS v")
    x = B.permuted_drawdown(df, "v", "id", 8, bucket_rows=90)
    plan = x._jdf.queryExecution().toString()
    assert "binary" not in plan and "FlatMapGroupsInArrow" not in plan  # states alone are shuffled
    assert sorted(r["max_dd"] for r in x.collect()) == sorted(r["max_dd"] for r in B.permuted_drawdown(df, "v", "id", 8).collect())
