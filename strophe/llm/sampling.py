"""A bounded sample of a table for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def smallest(df: DataFrame, key: str, n: int) -> list[Row]:
    """At most ``n`` rows, those whose keys have the smallest hashes.

    A hash bound set from the number of rows lets only about 1.3 n rows leave the scan, however many
    partitions there are (each would send n rows otherwise); the hash is of the key, so a text
    that many rows share isn't drawn more often than they are."""
    h = F.shiftrightunsigned(F.xxhash64(key), 1)
    total = df.count()
    if total > 2 * n:
        df = df.filter(h < int(2**63 * min(1.0, (1.3 * n + 200) / total)))
    return df.orderBy(h, key).limit(n).collect()
