"""Keep the input's columns apart from an operator's own, whatever they are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IN = "_in"


def columns(df: DataFrame) -> list[Column]:
    """All columns by name, also names with dots or backticks."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def packed(df: DataFrame, *more: Column) -> DataFrame:
    """One struct ``_in`` with all columns of ``df``, beside ``more``: names of the input cannot clash with later ones."""
    return df.select(F.struct(*columns(df)).alias(IN), *more)


def unpacked(df: DataFrame, *more: Column) -> DataFrame:
    return df.select(f"{IN}.*", *more)
