"""Registered queries over the test tables, each with equivalent DuckDB SQL."""

from __future__ import annotations

from .plans import effects, exports, gating, nested, procedures, programmes, studies


def merged(*tables: dict) -> dict:
    """One table of all names; a name that comes twice is an error."""
    out: dict = {}
    for table in tables:
        if twice := out.keys() & table.keys():
            raise ValueError(f"registered twice: {', '.join(sorted(twice))}")
        out |= table
    return out


PLANS = (effects, procedures, exports, studies, nested, programmes, gating)
QUERIES: dict = merged(*(p.QUERIES for p in PLANS))
ORACLE: dict[str, str] = merged(*(p.ORACLE for p in PLANS))
