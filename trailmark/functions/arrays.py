"""Helpers for array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once.

    Inside a lambda a plain column expression may be substituted and computed again for every
    element; a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)
