"""All queries of the engine by name, with the SQL that they are held against."""

from .plans import audit, basics, daily, desk, kpis, loads, marketing, monitoring, names, o2c, report, targets

MODULES = (daily, marketing, monitoring, o2c, report, names, audit, basics, desk, targets, loads, kpis)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: s for m in MODULES for name, s in m.SQL.items()}
