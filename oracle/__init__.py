"""DuckDB oracle statements for the catalog entries (the correctness gate)."""

from . import q_bandit, q_io, q_more, q_ops, q_passk, q_results, q_stream, q_text  # noqa: F401
from .base import ORACLE

__all__ = ["ORACLE"]
