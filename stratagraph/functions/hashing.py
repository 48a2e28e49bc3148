"""Reproducible draws: uniforms and normals from MD5, the same in any partitioning and in other SQL engines."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(*parts) -> Column:
    """md5 of the parts joined by colons."""
    return F.md5(F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]).cast("binary"))


def uniform(*parts) -> Column:
    """A number in [0, 1) from 48 bits of the key."""
    return F.conv(F.substring(key(*parts), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def normal(*parts) -> Column:
    """A standard normal number, by Box and Muller."""
    u, v = uniform(*parts, "u"), uniform(*parts, "v")
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(2 * pi) * v)


def sql_uniform(parts: str) -> str:
    """The same in DuckDB; parts is SQL text of a string."""
    return f"(('0x' || substr(md5({parts}), 1, 12))::BIGINT / 281474976710656.0)"
