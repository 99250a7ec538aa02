"""The queries over the supplied tables and the SQL each is compared with, gathered by family."""

from __future__ import annotations

from lumenframe.plans import detections, evaluation, media, records, signals, titles, vectors

FAMILIES = (media, vectors, titles, evaluation, signals, detections, records)
QUERIES: dict = {name: f for family in FAMILIES for name, f in family.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for family in FAMILIES for name, sql in family.ORACLE_SQL.items()}
