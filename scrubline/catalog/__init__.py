"""Registered queries over the given tables, each with the SQL it must equal."""

from . import (q_checks, q_cleaning, q_columns, q_convert, q_missing,  # noqa: F401
               q_pii, q_profile, q_quality, q_rows, q_sources)
from .registry import ORACLES, QUERIES  # noqa: F401
