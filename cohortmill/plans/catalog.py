"""All registered queries of the library with their oracle SQL."""

from __future__ import annotations

import importlib

from cohortmill.plans.base import QUERIES, SQL

for _name in ("deid_queries", "voxel_queries", "mesh_queries", "trace_queries", "design_queries", "file_queries"):
    importlib.import_module(f"cohortmill.plans.{_name}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
