"""Queries over the supplied star-schema tables, each next to the SQL that must give the same rows."""
from __future__ import annotations

from . import adoption, extracting, inventory, ledgers, matching, nested, reporting, store, texts

GROUPS = (store, adoption, nested, matching, texts, extracting, ledgers, reporting, inventory)


def all_queries():
    return {name: pair[0] for group in GROUPS for name, pair in group.QUERIES.items()}


def all_sql():
    return {name: pair[1] for group in GROUPS for name, pair in group.QUERIES.items() if pair[1]}
