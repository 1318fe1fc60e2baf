"""Joins that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread_join(facts: DataFrame, dim: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join ``facts`` with ``dim`` (at most one row per key) on ``keys``.

    One equi-join at every size: whether ``dim`` is broadcast is left to its
    size in bytes, and adaptive execution splits the partition of a hot or null
    key of ``facts``, repeating only that key's single ``dim`` row.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    return facts.join(dim, keys, how)
