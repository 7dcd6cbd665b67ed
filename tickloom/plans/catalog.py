"""All named queries of the library."""

from __future__ import annotations

from . import features, market, models, research, strategies

MODULES = (market, features, strategies, research, models)
FLAGSHIP = "sim_fixed_tp"
QUERIES = {name: q for m in MODULES for name, q in m.R.queries.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.R.oracles.items()}
