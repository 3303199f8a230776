"""Paths and strings as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def join_path(root: Column, relative: Column) -> Column:
    """root / relative; an absolute second part replaces the first. Nothing is normalised."""
    return F.when(relative.startswith("/"), relative).otherwise(F.concat(F.regexp_replace(root, "/$", ""), F.lit("/"), relative))


def last_part(path: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def pad_right(text: Column, width: int) -> Column:
    """Left-aligned in `width`; longer text stays whole (rpad would cut it)."""
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, " "))


def digits_after(name: Column, prefix: str) -> Column:
    """The number of ASCII digits that is all that follows a literal prefix, else null."""
    rest = F.when(name.startswith(prefix), F.substring(name, len(prefix) + 1, 1 << 30))
    return F.when(rest.rlike("^[0-9]+$"), rest).try_cast("bigint")


def present_or(values: Column, key: Column | str, default: Column) -> Column:
    """The value of a key of a map where the key is present, even if null; the default only where it's absent."""
    key = F.lit(key) if isinstance(key, str) else key
    return F.when(F.coalesce(F.map_contains_key(values, key), F.lit(False)), F.try_element_at(values, key)).otherwise(default)


def falsy_or(value: Column, default: Column) -> Column:
    """`value or default` of a number: null and 0 give the default."""
    return F.when(value.isNull() | (value == 0), default).otherwise(value)
