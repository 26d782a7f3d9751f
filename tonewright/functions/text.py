"""Names, numbers and colours as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonewright.functions.naming import basename


def clean_text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def scientific_name(full_name: Column) -> Column:
    """The part before the first underscore, or the whole name."""
    return F.element_at(F.split(full_name, "_", 2), 1)


def common_name(full_name: Column, code: Column) -> Column:
    """The part after the first underscore, or the code."""
    return F.when(F.contains(full_name, F.lit("_")), F.element_at(F.split(full_name, "_", 2), -1)).otherwise(code)


def recording_number(filename: Column) -> Column:
    """Catalogue number in a file name (``XC`` and digits, no letter or digit before), else ''."""
    return F.regexp_extract(filename, r"(?i)(?:^|[^A-Za-z0-9])XC[_-]?(\d+)", 1)


def sound_file(filename: Column, file_path: Column, audio: Column) -> Column:
    """The first name that isn't empty, else ''."""
    some = lambda c: F.when(c != "", c)
    return F.coalesce(some(filename), some(basename(file_path)), some(basename(audio)), F.lit(""))


def fixed(c: Column, digits: int) -> Column:
    """The number with a fixed number of decimals, without grouping, rounded from its binary value."""
    return F.call_function("format_number", c.cast("double"), F.lit("0." + "0" * digits if digits else "0"))


def rounded(c: Column, digits: int = 3) -> Column:
    return fixed(c, digits).cast("double")


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    """``#rrggbb``, white where a part is missing."""
    two = lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")
    return F.coalesce(F.concat(F.lit("#"), two(r), two(g), two(b)), F.lit("#FFFFFF"))


def no_nan(c: Column) -> Column:
    """NaN becomes 0, the infinities the largest doubles."""
    big = 1.7976931348623157e308
    return F.when(F.isnan(c), 0.0).when(c == F.lit(float("inf")), big).when(c == F.lit(float("-inf")), -big).otherwise(c)
