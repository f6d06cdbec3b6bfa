"""Column functions on records: the tagged union of put and delete as (value, deleted)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def live_value(value: str | Column = "value", deleted: str | Column = "deleted") -> Column:
    """The value of a put, null for a delete."""
    value, deleted = (F.col(x) if isinstance(x, str) else x for x in (value, deleted))
    return F.when(~deleted, value)


def content_hash(data: str | Column) -> Column:
    return F.sha2(data, 256)
