"""Names: recordings and species codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """NULL for strings that hold blanks only."""
    return F.when(F.trim(c) != "", c)


# each name is read by one pattern that starts at the last separator with something behind it
_FOLDERS, _END = r"(?s)^(?:.*[/\\](?=[^/\\]))?", r"[/\\]*$"


def basename(c: Column) -> Column:
    """The part after the last slash or backslash; trailing separators don't count."""
    return F.regexp_extract(c, _FOLDERS + r"([^/\\]*)" + _END, 1)


def stem(c: Column) -> Column:
    """File name without directories and last extension (``.wav`` and ``x.`` keep their dot)."""
    return F.regexp_extract(c, _FOLDERS + r"([^/\\]*?)(?:(?<=[^/\\])\.[^./\\]+)?" + _END, 1)


def recording(filename: Column, file_path: Column) -> Column:
    """Lower-case stem of the first of both names that isn't blank, else NULL."""
    return F.lower(stem(F.coalesce(blank_to_null(filename), blank_to_null(file_path))))


def species_code(c: Column) -> Column:
    """Code in lower case without surrounding blanks; blank codes are NULL."""
    return blank_to_null(F.lower(F.trim(c)))


def finite(c: Column) -> Column:
    """The value if it's neither NULL, NaN nor infinite, else NULL."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)
