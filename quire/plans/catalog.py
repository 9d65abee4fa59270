"""Registered queries over the driver's tables and the same in SQL."""

from __future__ import annotations

from . import documents, painting, relational, views

QUERIES = documents.QUERIES | relational.QUERIES | painting.QUERIES | views.QUERIES
ORACLES = documents.ORACLES | relational.ORACLES | painting.ORACLES | views.ORACLES
