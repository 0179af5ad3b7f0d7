"""Column expressions: keys, numbers, buckets and scalar arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    Catalyst does not share subexpressions across conditional branches; a lambda
    variable does.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
