"""Columns in steps: what a later step uses many times is worked out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns, each computed once a row: the optimiser does not copy them into what uses them.

    Nested conditions that are used many times would otherwise multiply the plan.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
