"""Cell comparison of two table revisions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell_text(value: Column) -> Column:
    """A cell as compared text: commas and blanks do not count."""
    return F.translate(value.cast("string"), ", ", "")


def cells_equal(old: Column, new: Column, tolerance: float) -> Column:
    """Both missing, or numbers within the tolerance, or the same text once commas and blanks are gone.

    NaN counts as missing, so two NaN cells are equal and NaN against a value is not.
    """
    a, b = old.cast("string"), new.cast("string")
    a, b = F.when(F.lower(F.trim(a)) != "nan", a), F.when(F.lower(F.trim(b)) != "nan", b)
    x, y = a.try_cast("double"), b.try_cast("double")
    return (
        F.when(a.isNull() & b.isNull(), True)
        .when(a.isNull() | b.isNull(), False)
        .when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= tolerance)
        .otherwise(cell_text(a) == cell_text(b))
    )


def numbers_equal(old: Column, new: Column, tolerance: float) -> Column:
    """The same for columns that are numeric by type, without the round trip through text."""
    a, b = F.nullif(old.cast("double"), F.lit(float("nan"))), F.nullif(new.cast("double"), F.lit(float("nan")))
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(F.abs(a - b) <= tolerance)
