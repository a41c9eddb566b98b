"""Deterministic randomness: every random choice is a hash of a seed and a row key.

`rand()` depends on how rows are partitioned; a hash does not, so a lost executor
recomputes exactly the same sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _part(value) -> Column:
    return value.cast("string") if isinstance(value, Column) else F.lit(str(value))


def hash_hex(*parts) -> Column:
    """md5 of the parts joined by '|' (32 lower-case hex digits, uniform)."""
    return F.md5(F.concat_ws("|", *[_part(p) for p in parts]))


def hex_uniform(hex_: Column, at: int = 1) -> Column:
    """Uniform double in [0, 1) from the eight hex digits starting at `at`."""
    return F.conv(F.substring(hex_, at, 8), 16, 10).cast("bigint") / F.lit(float(2**32))


def hash_uniform(*parts) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of the hash."""
    return hex_uniform(hash_hex(*parts))


def hash_slot(n: Column, *parts) -> Column:
    """Uniform integer in 1..n from the first 60 bits of the hash."""
    head = F.conv(F.substring(hash_hex(*parts), 1, 15), 16, 10).cast("bigint")
    return head % n + F.lit(1)


def hex_normal(hex_: Column, first: int, second: int) -> Column:
    """Standard normal draw: Box-Muller on two groups of eight hex digits."""
    u, v = hex_uniform(hex_, first), hex_uniform(hex_, second)
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2.0 * F.pi() * v)


def row_key(source: str, key: str, *tables: DataFrame) -> list[str]:
    """Columns that identify a row: keys are unique within a source; tables without sources have one."""
    return [source, key] if all(source in t.columns for t in tables) else [key]
