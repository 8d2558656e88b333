"""Working on sets of columns: ranges, renames, ordering, type splits."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T


def columns_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` in table order, both ends included."""
    names = df.columns
    i, j = names.index(first), names.index(last)
    if j < i:
        raise ValueError(f"{last!r} comes before {first!r}")
    return names[i : j + 1]


def keep_between(df: DataFrame, first: str, last: str, also: Sequence[str] = ()) -> DataFrame:
    span = columns_between(df, first, last)
    return df.select(*[c for c in also if c not in span], *span)


def drop_between(df: DataFrame, first: str, last: str) -> DataFrame:
    return df.drop(*columns_between(df, first, last))


def drop_prefix(df: DataFrame, *prefixes: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefixes)])


def keep_prefix(df: DataFrame, *prefixes: str, also: Sequence[str] = ()) -> DataFrame:
    return df.select(*also, *[c for c in df.columns if c.startswith(prefixes) and c not in also])


def front(df: DataFrame, *names: str) -> DataFrame:
    """Move some columns to the front and leave the others in place."""
    return df.select(*names, *[c for c in df.columns if c not in names])


def sorted_columns(df: DataFrame, *key: str) -> DataFrame:
    return df.select(*key, *sorted(c for c in df.columns if c not in key))


def safe_name(name: str) -> str:
    """Lower-case name of letters, digits and underscores."""
    cleaned = re.sub(r"[^0-9A-Za-z]+", "_", name.strip()).strip("_").lower()
    if not cleaned:
        return "x"
    return f"x{cleaned}" if cleaned[0].isdigit() else cleaned


def safe_names(df: DataFrame) -> DataFrame:
    """All columns renamed with :func:`safe_name`; clashes get a numeric suffix."""
    seen: dict[str, int] = {}
    out = []
    for name in df.columns:
        base = safe_name(name)
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return df.toDF(*out)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def rename_pattern(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Apply every ``(regex, replacement)`` to every column name, in order."""
    names = df.columns
    for pattern, replacement in rules:
        names = [re.sub(pattern, replacement, n) for n in names]
    return df.toDF(*names)


def map_columns(df: DataFrame, names: Iterable[str], fn: Callable[[str], Column]) -> DataFrame:
    """Replace each named column by ``fn(name)``."""
    return df.withColumns({n: fn(n) for n in names})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def other_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]
