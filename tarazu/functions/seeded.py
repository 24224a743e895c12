"""Seeded choices that any engine can repeat: numbers made of MD5 prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def h32(*parts) -> Column:
    """A number from 0 to 2^32 - 1: the first 8 hex digits of MD5 of the parts joined by ':'. Null parts count as empty."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def unit(*parts) -> Column:
    """A number from 0 up to but not including 1."""
    return h32(*parts) / F.lit(4294967296.0)
