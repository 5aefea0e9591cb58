"""Helpers that tests import by name; conftest modules of other folders cannot hide them."""

from __future__ import annotations


def rows(df, *order):
    """Rows as tuples, sorted by the given columns or by all of them."""
    collected = [tuple(r) for r in df.collect()]
    if order:
        at = [df.columns.index(c) for c in order]
        return sorted(collected, key=lambda r: tuple((r[i] is None, r[i]) for i in at))
    return sorted(collected, key=lambda r: tuple((v is None, str(v)) for v in r))
