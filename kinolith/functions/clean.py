"""Column functions on dirty keys, times and texts; all stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Whitespace, separators, control and format characters (byte order mark, zero width space).
INVISIBLE = r"[\s\p{Z}\p{C}]"

#: Words that stand for "no reference", chosen here; a parameter of the data.
NOTHING = ("", "-", "--", "?", "n/a", "na", "nan", "nil", "none", "null", "nothing", "undefined", "missing", "void")


def strip_invisible(c: Column) -> Column:
    """Remove invisible characters around a text."""
    return F.regexp_replace(c, f"^{INVISIBLE}+|{INVISIBLE}+$", "")


def key_of(c: Column, folders: bool = False) -> Column:
    """Canonical form of a record key, null where it means "nothing".

    Letter case, hyphens and surrounding space do not count, nor, with ``folders``, what
    stands before the last slash.
    """
    text = F.lower(strip_invisible(c))
    if folders:
        text = F.regexp_replace(text, r"^.*[/\\]", "")
    bare = F.regexp_replace(text, "-", "")
    return F.when(text.isin(*NOTHING) | (bare == ""), None).otherwise(bare)


def epoch_micros(c: Column) -> Column:
    """Epoch times given in s, ms, us or ns as whole microseconds; NaN and infinite become null."""
    size = F.abs(c)
    scaled = (
        F.when(size >= 1e17, c / 1e3).when(size >= 1e14, c).when(size >= 1e11, c * 1e3).otherwise(c * 1e6)
    )
    return F.when(~F.isnan(c) & (size < 9e18), F.round(scaled).cast("bigint"))


def month_of(micros: Column) -> Column:
    """Calendar month (UTC) of an epoch time in microseconds, as yyyy-MM."""
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM")
