"""Joins whose broadcasts are sized before they are made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sets of keys up to this number are broadcast, larger ones joined by shuffle in ``SALTS`` parts a key.
FEW_KEYS, SALTS = 20_000, 16


def having(rows: DataFrame, keys: DataFrame, on: list[str], by: str) -> DataFrame:
    """The rows whose key is in ``keys`` (distinct): by broadcast where they are few, counted first, else by a shuffle in which ``by`` spreads each key over ``SALTS`` tasks."""
    if keys.count() <= FEW_KEYS:
        return rows.join(F.broadcast(keys), on, "left_semi")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return salted.join(keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "salt"], "left_semi").drop("salt")
