"""The cleaning steps.  Importing the package fills the step registry."""

from . import categories, columns, convert, missing, rows  # noqa: F401
from .base import TOOLS, Change, apply_step, plan_step  # noqa: F401
