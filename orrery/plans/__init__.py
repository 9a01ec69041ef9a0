"""The registered queries of the analytics part, and their DuckDB twins."""

from __future__ import annotations

from . import catalogue, dryrun, evaluation, grounded, measures, planning, protocol, scene, tables, views

FLAGSHIP = "scene_pivots"
QUERIES: dict = {**scene.QUERIES, **tables.QUERIES, **planning.QUERIES, **evaluation.QUERIES, **catalogue.QUERIES, **measures.QUERIES, **protocol.QUERIES, **dryrun.QUERIES, **views.QUERIES, **grounded.QUERIES}
ORACLE: dict = {**scene.ORACLE, **tables.ORACLE, **planning.ORACLE, **evaluation.ORACLE, **catalogue.ORACLE, **measures.ORACLE, **protocol.ORACLE, **dryrun.ORACLE, **views.ORACLE, **grounded.ORACLE}
