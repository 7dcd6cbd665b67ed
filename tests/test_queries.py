"""Every query of the library against its DuckDB twin on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from tickloom.plans import catalog

SLOW = {"cluster_kmeans", "cluster_fit", "cluster_assign", "cluster_winners_losers", "holdout_cluster", "shap_importance", "shap_stability", "shap_select"}
CORE = ["profile_range", "profile_gaps", "resample_ohlcv", "ind_atr", "ind_adx", "ind_pct_rank_expanding", "macro_daily", "exc_mfe_mae", "exc_time_frac", "feat_momentum", "feat_prev_outcome", "exit_quality",
        "sim_fixed_tp", "sim_partial", "sim_no_stop", "sim_eod", "agg_max_drawdown", "strat_cluster_table", "pattern_depth2", "wf_summary", "boot_mean_ci", "perm_test", "test_paired_t_w", "cp_tie", "cluster_streak", "features_build", "stability_perturb", "test_spearman_trend", "cusum_changepoints", "tail_risk", "hybrid_exit", "macro_pattern", "src_trades", "src_macro_json"]


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v) + 0.0:.6g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()[:10] if v.time() == datetime.time() else v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", CORE if not os.environ.get("TEST_ALL") else [n for n in catalog.ORACLES if n not in SLOW])
def test_twin(spark, sf_dir, con, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    want = con.sql(catalog.ORACLES[name]).df()
    assert sorted(want.columns) == cols
    a = sorted(repr([plain(v) for v in row]) for row in got.select(*cols).collect())
    w = want[cols].astype(object).where(want[cols].notna(), None)
    b = sorted(repr([plain(v.to_pydatetime() if hasattr(v, "to_pydatetime") else v) for v in row]) for row in w.values.tolist())
    assert a == b


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert catalog.FLAGSHIP in catalog.QUERIES
