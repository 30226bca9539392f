"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the deterministic initial features: value q of entity id is
# (pmod(id * ID_STEP + q * FEATURE_STEP + seed, MODULUS) + 1) / (MODULUS + 1).
ID_STEP = 7919
FEATURE_STEP = 104729
MODULUS = 10007


def block_of(id_col, num_blocks) -> Column:
    """Block an id belongs to; never negative."""
    return F.pmod(F.col(id_col) if isinstance(id_col, str) else id_col, F.lit(num_blocks))


def pseudo_random(id_col: Column, feature: int, seed: int = 0) -> Column:
    """A value in (0, 1) that depends on the id only, not on partitioning."""
    mixed = id_col.cast("bigint") * F.lit(ID_STEP) + F.lit(feature * FEATURE_STEP + seed)
    return (F.pmod(mixed, F.lit(MODULUS)) + F.lit(1)) / F.lit(MODULUS + 1.0)


def features_to_columns(features: str, rank: int, prefix: str) -> list[Column]:
    """Unpack a feature array into one column per feature."""
    return [F.expr(f"{features}[{q}] as {prefix}{q}") for q in range(rank)]


def dot_columns(left_prefix: str, right_prefix: str, rank: int) -> Column:
    """Inner product of two unpacked vectors, added up in feature order."""
    return F.expr(" + ".join(f"{left_prefix}{q} * {right_prefix}{q}" for q in range(rank)))


def rounded(col, digits: int = 6) -> Column:
    """Round for comparison; adding 0.0 turns a negative zero into zero."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits) + F.lit(0.0)
