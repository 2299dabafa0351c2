"""An expression that is computed once and used several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value); inside functions of arrays equal parts of an expression aren't shared otherwise."""
    return F.element_at(F.transform(F.array(value), of), 1)
