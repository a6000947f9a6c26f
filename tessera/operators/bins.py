"""Dense bins from sparse ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filled(bins: DataFrame, keys: Sequence[str], index: str, low: int, high: int, values: Sequence[str]) -> DataFrame:
    """(keys, index, values) for every index of ``low``..``high``, 0 where ``bins`` has none.

    Each key's few bins become one map that is read back by index, so the data behind ``bins`` is
    scanned once and nothing is joined."""
    per = bins.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(index), F.struct(*values)))).alias("_bins"))
    every = per.select(*keys, "_bins", F.explode(F.sequence(F.lit(low), F.lit(high))).alias(index)).withColumn("_one", F.try_element_at("_bins", F.col(index)))
    return every.select(*keys, index, *(F.coalesce(F.col(f"_one.{v}"), F.lit(0)).alias(v) for v in values))
