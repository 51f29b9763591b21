"""Column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once. A projection would be folded into every use of its columns."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
