"""Shared folders, row keys and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.sources.shared import spread, written  # noqa: F401


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate from file sizes, or a count of the bytes where it has none; for the number of partitions only, never for results."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 56:
        return size
    wide = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    return df.select(F.sum(sum(wide, F.lit(16 * len(df.columns))).cast("bigint"))).first()[0] or 0


def parts(df: DataFrame, mb: float, least: int = 1, most: int = 1 << 24, inflate: float = 1.0) -> int:
    """How many partitions of about ``mb`` MB the rows fill; above ``most`` of them (33 TB for partitions of 2 MB) they grow."""
    return int(min(most, max(least, -(-estimated_bytes(df) * inflate // (mb * 1e6)))))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Tells rows apart by text where ids repeat or are null; rows equal in both share it."""
    return F.xxhash64(F.col(text), F.col(doc_id))


def text_or_empty(df: DataFrame, name: str = "text") -> Column:
    return F.coalesce(df[name].cast("string"), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, made from the given ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
