"""All core queries and their SQL."""

from __future__ import annotations

from marketloom.queries import domain, ladder, relations, research, strategies, studies, training, windows

MODULES = [training, windows, relations, strategies, research, ladder, domain, studies]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def sql() -> dict:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
