"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dround(x: Column, scale: int) -> Column:
    """x rounded half up (away from zero) to scale decimal places."""
    if scale < 0:
        raise ValueError("the scale must be a positive integer or zero")
    return F.round(x, scale)


def block_of(row_id: Column, rows: Column | int, sub_rows: int) -> Column:
    """The block of a row: sub_rows each, from 1, a shorter rest joined to the last block."""
    last = F.greatest(F.floor(F.lit(rows) / sub_rows) - 1, F.lit(0))
    return (F.least(F.floor(row_id / sub_rows), last) + 1).cast("int")


def outer_key(index: Column, height: int) -> tuple[Column, Column]:
    """(block, place in it) of an index for blocks of so many rows."""
    return F.floor(index / height).cast("int"), (index % height).cast("int")


def parse_row(line: Column) -> Column:
    """array<double> of a line whose numbers are separated by one space; blanks at its end are dropped."""
    return F.transform(F.split(F.rtrim(line), " "), lambda x: x.cast("double"))
