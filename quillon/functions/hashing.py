"""Deterministic pseudo-random numbers from md5: the same on every engine, whatever the partitions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(*parts) -> Column:
    """An integer below 2**32 from the text of the parts (columns or literals), joined by |."""
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(*parts) -> Column:
    """A double in [0, 1)."""
    return hash32(*parts) / F.lit(float(1 << 32))
