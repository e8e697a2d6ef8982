"""Small building blocks shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value: Column | str) -> Column:
    """A column from a name or a column."""
    return value if isinstance(value, Column) else F.col(value)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def text_or_blank(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def lookup(value: Column, table: dict[str, str], default: Column) -> Column:
    """Fixed code table applied to a column."""
    pairs = [F.lit(part) for pair in table.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), default)


def any_of(conditions: Sequence[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result | condition
    return result


def all_of(conditions: Sequence[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result & condition
    return result


def contains_ci(value: Column, needle: str) -> Column:
    """Case-insensitive literal containment; wildcards in ``needle`` have no meaning."""
    return F.lower(value).contains(needle.lower())
