"""Compute a row's expensive columns once.

A filter on a column computed in a projection is pushed below that
projection with the column's expression substituted, so an expensive
expression (a JSON parse, a rating parser with regexes) runs again for each
filter term.  Producing the row through a one-row `inline` makes it the
output of a Generate node, which filters are not pushed into: the
expression runs once and later filters read the column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def computed_once(*cols: Column) -> Column:
    """Generator yielding one row with the given (aliased) columns."""
    return F.inline(F.array(F.struct(*cols)))
