"""Keyed overlay merge: later layers replace earlier ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_layers(layers: list[DataFrame], key: str, place: str) -> DataFrame:
    """One row for each key, from the last layer that has it and there from the last place; empty keys are dropped.

    max over a struct: a partial aggregate, so repeated keys meet before the shuffle."""
    rest = [c for c in layers[0].columns if c != key]
    named = [df.withColumn("_layer", F.lit(i)) for i, df in enumerate(layers)]
    rows = reduce(DataFrame.unionByName, named).where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    top = rows.groupBy(key).agg(F.max(F.struct("_layer", F.col(place).alias("_place"), *rest)).alias("t"))
    return top.select(key, *[F.col(f"t.{c}").alias(c) for c in rest])
