"""Stateless, partition-independent uniform numbers.

``u(seed, k1, k2, ...)`` = first 8 hex digits of md5("seed|k1|k2|...") read in
base 16, divided by 2**32. The same value is produced by ``u_sql`` in DuckDB,
so sampling and masking operators have exact SQL oracles. Keys must be
integers or strings (their text form is the same in both engines).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _as_col(k) -> Column:
    if isinstance(k, Column):
        return k.cast("string")
    return F.col(k).cast("string")


def u(seed, *keys) -> Column:
    """Hash-uniform in [0, 1) of a seed and key columns (names or Columns)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[_as_col(k) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(TWO_POW_32)


def u_sql(seed, *keys: str) -> str:
    """DuckDB twin of :func:`u`; ``keys`` are SQL expressions."""
    parts = ", ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return (f"(CAST(CAST(('0x' || substr(md5(concat_ws('|', {parts})), 1, 8)) AS UBIGINT) AS DOUBLE)"
            f" / {TWO_POW_32})")
