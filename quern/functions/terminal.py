"""Bars and sparklines as text, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells by eighths, rising from below and growing from the left.
RISING, GROWING = " ▁▂▃▄▅▆▇█", " ▏▎▍▌▋▊▉█"
_FULL = "█"


def _cell(cells: str, share: Column) -> Column:
    """The cell for a share of 1; halves of an eighth go to the even one."""
    eighths = F.least(F.bround(share * 8, 0).cast("int"), F.lit(8))
    return F.substring(F.lit(cells), eighths + 1, F.lit(1))


def sparkline(values: Column, width: int) -> Column:
    """The last ``width`` of an array of counts, each a cell as high as its share of the greatest of them."""
    if width < 1:
        return F.lit("")
    shown = F.slice(values, F.greatest(F.size(values) - (width - 1), F.lit(1)), F.lit(width))
    top = F.greatest(F.array_max(shown), F.lit(1))
    return F.array_join(F.transform(shown, lambda v: _cell(RISING, v / top)), "")


def bar(value: Column, top: Column, width: int) -> Column:
    """A bar whose length is the value's share of ``top``, in eighths of a cell."""
    if width < 1:
        return F.lit("")
    length = value / top * width
    whole = F.floor(length).cast("int")
    last = F.when(whole < width, _cell(GROWING, length - whole)).otherwise("")
    return F.when(top <= 0, "").otherwise(F.concat(F.repeat(F.lit(_FULL), whole), last))
