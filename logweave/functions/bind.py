"""Binding of intermediate values in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once, however often ``body`` mentions it.

    An expression that is mentioned twice is there twice in the plan, and again for each expression around it that is
    mentioned twice; a lambda's variable isn't.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
