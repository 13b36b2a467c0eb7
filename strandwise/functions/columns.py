"""Column helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def fixed_map(table: Mapping[str, object]) -> Column:
    """A fixed table as one literal map of strings (not one literal per entry)."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in table.items())), F.lit("\x02"), F.lit("\x01"))


def fixed_list(values: Sequence[str]) -> Column:
    """A fixed list as one literal array of strings."""
    return F.split(F.lit("\x02".join(values)), "\x02")


def yes(condition: Column) -> Column:
    """A condition whose unknown counts as false, so that its negation keeps the row."""
    return F.coalesce(condition, F.lit(False))


def known(c: Column, condition: Column) -> Column:
    """A condition on one column, known wherever that is not null, as two-valued as with
    ``yes``. Scans take this form, and its negation, as a pushed filter; they take no ``coalesce``."""
    return c.isNotNull() & condition


def known_equal(c: Column, value: Any) -> Column:
    return F.lit(False) if value is None else known(c, c == F.lit(value))


def one_of(c: Column, values: Iterable) -> Column:
    values = [v for v in values if v is not None]
    return known(c, c.isin(values)) if values else F.lit(False)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def money(c: str | Column) -> Column:
    """Exact decimals, so that sums do not depend on the order of rows."""
    return col(c).cast("decimal(18,2)")


def lookup(value: Column, pairs: dict, default: Column | None = None) -> Column:
    """A small fixed map as a ``when`` chain."""
    out = None
    for k, v in pairs.items():
        out = F.when(value == k, F.lit(v)) if out is None else out.when(value == k, F.lit(v))
    return out.otherwise(default if default is not None else F.lit(None))
