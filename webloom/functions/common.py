"""Small Column helpers shared by the function modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times in ``body(v)``.

    Catalyst does not share a sub-expression referenced twice inside one expression tree, so a
    deep expression that reuses an intermediate would otherwise be copied (and evaluated) per use.
    Binding it as a lambda variable evaluates it once per row and keeps the tree linear."""
    return F.get(F.transform(F.array(value), body), 0)
