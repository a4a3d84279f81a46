"""Absolute paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The longest name, in bytes.
MOST_NAME = 255


def parts(path: Column) -> Column:
    """The names of an absolute path, without empty ones."""
    return F.filter(F.split(path, "/"), lambda p: p != "")


def invalid(path: Column) -> Column:
    """Why a path is not valid, or null."""
    any_part = lambda f: F.exists(parts(path), f)
    return (
        F.when(~path.startswith("/"), "relative")
        .when(any_part(lambda p: p.isin(".", "..")), "dots")
        .when(any_part(lambda p: F.octet_length(p) > MOST_NAME), "too_long")
        .when(path.contains("\x00"), "nul")
    )


def valid_name(name: Column) -> Column:
    return F.octet_length(name).between(1, MOST_NAME) & ~name.contains("/") & ~name.contains("\x00")


def joined(names: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(names, "/"))


def parent(path: Column) -> Column:
    p = parts(path)
    return joined(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))))


def leaf(path: Column) -> Column:
    return F.try_element_at(parts(path), F.lit(-1))


def prefixes(path: Column) -> Column:
    """The directories above a path, outermost first, without the root."""
    p = parts(path)
    at = F.when(F.size(p) > 1, F.sequence(F.lit(1), F.size(p) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: joined(F.slice(p, F.lit(1), i)))
