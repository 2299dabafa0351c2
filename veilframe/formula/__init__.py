"""The formula language: syntax, gate, and compilation to Catalyst."""

from . import arrays, functions  # noqa: F401  (they register the language's functions)
from .compile import FUNCTIONS, Workbook
from .gate import ALLOWED, Context, check, combined
from .syntax import FormulaError, parse

__all__ = ["ALLOWED", "FUNCTIONS", "Context", "FormulaError", "Workbook", "check", "combined", "parse"]
