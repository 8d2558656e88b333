"""Text, number and category cleaning, all as built-in column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal number; keeps try_cast from accepting '1d', '1f', 'NaN' or 'Infinity'.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

# Tokens a reviewer types for "not available" and "not known".
NULL_TOKENS = ("na", "nk")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Column | str) -> Column:
    """Text to double; anything that is not a plain number becomes null."""
    text = col(c).cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def not_nan(c: Column | str) -> Column:
    """NaN to null, so that comparisons with it are unknown rather than 'greatest'."""
    return F.when(~F.isnan(col(c)), col(c))


def lower_trim(c: Column | str) -> Column:
    return F.lower(F.trim(col(c)))


def empty_to_null(c: Column | str) -> Column:
    return F.when(col(c) != "", col(c))


def null_tokens(c: Column | str, tokens: Iterable[str] = NULL_TOKENS) -> Column:
    """Lower-cased, trimmed text with the null tokens removed."""
    cleaned = lower_trim(c)
    return F.when(~cleaned.isin(*tokens), cleaned)


def yes_no(c: Column | str) -> Column:
    """'yes'/'no' to boolean, anything else to null."""
    return F.when(col(c) == "yes", F.lit(True)).when(col(c) == "no", F.lit(False))


def to_boolean(c: Column | str) -> Column:
    return col(c).try_cast("boolean")


def present(c: Column | str) -> Column:
    return col(c).isNotNull()


def default_to(c: Column | str, value) -> Column:
    return F.coalesce(col(c), F.lit(value))


def category(c: Column | str, levels: Sequence[str]) -> Column:
    """Value if it is one of the closed set of levels, else null."""
    return F.when(col(c).isin(*levels), col(c))


def relabel(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Exact value relabelling; other values pass through."""
    out = col(c)
    for old, new in mapping.items():
        out = F.when(col(c) == old, F.lit(new)).otherwise(out)
    return out


def canonical(c: Column | str, rules: Sequence[tuple[str, str]], default: Column | str | None = None) -> Column:
    """Map text to a canonical name by ordered ``(regex, name)`` rules, first match wins.

    Unmatched text passes through unless ``default`` is given.
    """
    source = col(c)
    fallback = source if default is None else (F.lit(default) if isinstance(default, str) else default)
    if not rules:
        return fallback
    chain = None
    for pattern, name in rules:
        test = source.rlike(pattern)
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    return chain.otherwise(fallback)


def mentions(c: Column | str, phrases: Sequence[str]) -> Column:
    """Does the text contain any of the phrases (taken as regular expressions)?"""
    return col(c).rlike("|".join(phrases))


def labelled(flag: Column | str, yes: str, no: str) -> Column:
    """Boolean to a two-level label; an unknown flag stays unknown."""
    return F.when(col(flag), F.lit(yes)).when(~col(flag), F.lit(no))


def delirium_positive(c: Column | str) -> Column:
    """Screen result to boolean: 'Positive' is true, 'Unable to assess' is unknown."""
    return F.when(col(c) != "Unable to assess", col(c) == "Positive")


def ratio(num: Column | str, den: Column | str) -> Column:
    """Quotient; null where the denominator is zero."""
    return F.try_divide(col(num), col(den))
