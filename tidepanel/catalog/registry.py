"""All registered queries by name."""

from __future__ import annotations

from tidepanel.catalog import association, boosting, datasets, encoding, learning, panels, relations, scalars, storage
from tidepanel.catalog.views import Query

_GROUPS = (storage, scalars, relations, panels, datasets, learning, boosting, encoding, association)


def registry() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for group in _GROUPS:
        twice = found.keys() & group.QUERIES.keys()
        if twice:
            raise ValueError(f"registered twice: {sorted(twice)}")
        found.update(group.QUERIES)
    return found
