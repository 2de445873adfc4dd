"""Registered queries of the recall engine and their SQL."""

from __future__ import annotations

from evidentia import catalogue, catalogue_gather, catalogue_intake, catalogue_learned, catalogue_more, catalogue_records

_PARTS = (catalogue, catalogue_more, catalogue_intake, catalogue_learned, catalogue_gather, catalogue_records)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}


def flagship(spark, sf_dir):
    """Every question's recall packet."""
    return catalogue_more.gather(spark, sf_dir)
