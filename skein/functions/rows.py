"""Helpers on whole rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, **made: Column) -> DataFrame:
    """rows with columns that are computed once: unfolded from an array of one, so that the optimizer
    does not copy them into each use."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in made.items())))))
