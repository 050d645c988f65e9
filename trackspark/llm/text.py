"""Column helpers that the operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    return F.translate(column, UPPER, LOWER)


def crc_fold(column: Column, folds: int) -> Column:
    """``crc32`` of the value as text, modulo ``folds``; null for null."""
    return F.crc32(column.cast("string")) % folds


def packed(df: DataFrame, name: str = "row") -> DataFrame:
    """Every column inside one struct, so that no working column can clash with one of the input."""
    return df.select(F.struct(*[df[f"`{c}`"].alias(c) for c in df.columns]).alias(name))


def has(df: DataFrame, column: str, kind: str) -> Column:
    """The column, or typed nulls if the table lacks it."""
    return F.col(column) if column in df.columns else F.lit(None).cast(kind)
