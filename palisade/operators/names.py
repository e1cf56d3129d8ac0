"""Helper columns that no column of the rows can clash with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fresh(name: str, *frames: DataFrame) -> str:
    """`name`, with underscores in front until no frame has a column of that name."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ranked(rows: DataFrame, keys: list[str], order: list, rank: str) -> DataFrame:
    """Adds `rank`, the place from 1 within the rows of equal keys; nulls are a key like any other."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_per(rows: DataFrame, keys: list[str], order: list[str | Column], k: int = 1) -> DataFrame:
    """The first k rows of each key in the order; columns of any name are kept, an empty table gives none."""
    place = fresh("place", rows)
    return ranked(rows, keys, order, place).filter(F.col(place) <= k).drop(place)
