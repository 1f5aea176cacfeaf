"""LIKE with ASCII-only case folding, no escape character, wildcards % and _ live."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def fold(c: Column) -> Column:
    """ASCII lower case; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def fold_text(s: str) -> str:
    return s.translate(str.maketrans(UPPER, LOWER))


def like(c: Column, pattern: str) -> Column:
    """SQL LIKE under these rules; backslashes stand for themselves."""
    return fold(c).like(fold_text(pattern).replace("\\", "\\\\"))


def contains(c: Column, text: str) -> Column:
    return like(c, f"%{text}%")


def starts(c: Column, text: str) -> Column:
    return like(c, f"{text}%")
