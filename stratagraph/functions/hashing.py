"""The content hash. Hashes of members and of dependency lists are in ``operators/merkle.py``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable(text: Column) -> Column:
    return F.sha2(text, 256)
