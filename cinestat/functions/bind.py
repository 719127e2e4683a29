"""Evaluate an expression once per row and use it many times.

Catalyst inlines a column that a lambda mentions once, so a per-row constant inside
``transform`` would be recomputed for every element.  Binding it as the element of a
one-entry array keeps it a lambda variable, which is evaluated exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), 0)
