"""Queries over the catalogue operators, with the SQL that checks each."""

from __future__ import annotations

from quern.plans import catalogue, display, interchange, labels, lexicon, matching, names, requests, resolution, signals  # noqa: F401 (add their queries to the catalogue's)

QUERIES = dict(catalogue.QUERIES)
SQL = dict(catalogue.SQL)
