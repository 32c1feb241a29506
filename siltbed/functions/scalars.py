"""Scalar helpers as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def preview(text: Column, n: int = 100) -> Column:
    return F.concat(F.left(text, F.lit(n)), F.lit("..."))


def split_list(text: Column) -> Column:
    """The trimmed, non-empty parts of a comma-separated list."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def file_extension(name: Column) -> Column:
    """What follows the last dot, in lower case; a name without a dot whole."""
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def file_size(size: Column) -> Column:
    """A size with a 1024-based unit and at most two decimals; null from one TiB on, where units end."""
    unit = F.floor(F.log(1024.0, size.cast("double")) + 1e-12).cast("int")
    shown = F.regexp_replace(F.round(size / F.pow(F.lit(1024.0), unit), 2).cast("string"), r"\.0$", "")
    names = F.array(*[F.lit(u) for u in ("Bytes", "KB", "MB", "GB")])
    return F.when(size == 0, F.lit("0 Bytes")).otherwise(F.concat(shown, F.lit(" "), F.get(names, unit)))


def currency(amount: Column, sign: str = "£") -> Column:
    """An amount with thousands separators and at most three decimals, without trailing zeros."""
    return F.concat(F.lit(sign), F.regexp_replace(F.format_number(amount, 3), r"\.?0+$", ""))


def is_name(text: Column) -> Column:
    """Letters, digits and underscores alone; no trailing line end."""
    return text.rlike(r"^[a-zA-Z0-9_]+\z")


def present(text: Column, trim: bool = True) -> Column:
    """A required value: not null and not empty, after trimming unless told otherwise."""
    return text.isNotNull() & ((F.trim(text) if trim else text) != "")


def filled(values: Column) -> Column:
    """A required list: not null and not empty."""
    return F.coalesce(F.size(values) > 0, F.lit(False))


def one_of(text: Column, values: Sequence[str]) -> Column:
    return text.isin(*values)


def at_least_one(*texts: Column) -> Column:
    """Whether any of several values is present."""
    return reduce(lambda a, b: a | b, (present(t) for t in texts))


def errors(rules: Mapping[str, Column]) -> Column:
    """The messages of the rules that do not hold (a null rule does not), joined by '; '."""
    failing = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for message, ok in rules.items()]
    return F.array_join(F.array_compact(F.array(*failing)), "; ")


def toggle(selection: Column, value: Column) -> Column:
    """selection without value if it holds it, else with it at the end."""
    return F.when(F.array_contains(selection, value), F.array_remove(selection, value)).otherwise(F.array_append(selection, value))


def by_position(values: Sequence[str], at: Column, default: str) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(v) for v in values]), at), F.lit(default))


def day_slots(day: Column) -> Column:
    """The half-hours of a day that can be booked: from 8:30 to 11:00 and from 13:00 to 16:30."""
    at = lambda hour: F.to_timestamp_ntz(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(f" {hour}:00")))
    span = lambda a, b: F.sequence(at(a), at(b), F.expr("interval 30 minutes"))
    return F.concat(span("08:30", "11:00"), span("13:00", "16:30"))
