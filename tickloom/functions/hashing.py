"""Deterministic choice: numbers from a hash of a seed and keys, never from a random generator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pick(seed: int | str, *keys: Column | str) -> Column:
    """A number below 2**32: the first eight hexadecimal digits of the MD5 of seed and keys, joined by bars."""
    text = F.concat_ws("|", F.lit(str(seed)), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def pick_sql(seed: int | str, *keys: str) -> str:
    """The same in SQL."""
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'({k})::VARCHAR' for k in keys)})), 1, 8))::BIGINT"
