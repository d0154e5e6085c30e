"""Small pattern-and-action programs, planned as DataFrames where their shape allows it."""

from sheaf.script.plan import Script

__all__ = ["Script"]
