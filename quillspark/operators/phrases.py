"""Phrase mining: what a phrase is worth, and which tokens are weak at its ends. ``windows`` has the rest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import weak_boundary

__all__ = ["quality", "weak_boundary"]


def quality(c: Column, n: Column) -> Column:
    return F.log(c + 1.0) * n
