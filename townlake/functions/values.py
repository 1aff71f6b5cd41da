"""Guarded conversions and shares that tell missing from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column, digits: int = 3) -> Column:
    """part / whole, rounded; a missing part is 0, no or zero whole gives null."""
    return F.round(F.coalesce(part, F.lit(0)).cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), digits)


def given(text: Column, *withheld: str) -> Column:
    """The trimmed text; null if it is empty or one of the words that stand for no data."""
    bare = F.trim(text)
    return F.when((bare == "") | F.lower(bare).isin(*withheld) if withheld else bare == "", None).otherwise(bare)


def whole_number(text: Column) -> Column:
    """A number of digits only, else null; 1e3 or 5.0 are not taken."""
    return F.when(text.rlike(r"^[0-9]{1,18}$"), text.cast("long"))


def decimal_comma(text: Column) -> Column:
    """A number with a decimal comma or point, else null."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")


def counted(value: Column) -> Column:
    """A count in which -1 stands for withheld."""
    return F.when(value >= 0, value)


def rounded_metres(distance: Column) -> Column:
    return F.round(distance).cast("long")
