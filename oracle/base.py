"""Registry of the DuckDB oracle statements."""

from __future__ import annotations

from .views import with_views

ORACLE: dict[str, str] = {}


def _reg(name: str, body: str, *views: str) -> None:
    """Register ``body`` under ``name`` with the CTEs of ``views`` in front."""
    ORACLE[name] = with_views(body, *views)
