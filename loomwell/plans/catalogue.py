"""All queries of the library over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from loomwell.plans import aggregates, cohorts, graphs, rankings, scalars, sequences, streams, texts  # noqa: F401
from loomwell.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
