"""All registered queries of the core."""

from __future__ import annotations

from octolake.plans import analysis, audits, controls, sequences, skew, trajectories

FLAGSHIP = "window_summary"
MODULES = (trajectories, sequences, analysis, controls, audits, skew)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
