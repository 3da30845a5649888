"""Deterministic winners: best first, ties by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(scored: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each value of by, with their rank."""
    w = Window.partitionBy(by).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best(scored: DataFrame, by: str, score: str, place: str, least: float | None = None) -> DataFrame:
    """One row for each value of by: highest score, then least place; none under least. A partial aggregate, no sort."""
    rest = [c for c in scored.columns if c not in (by, score, place)]
    top = scored.groupBy(by).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(place)).alias("p"), *rest)).alias("t"))
    out = top.select(by, (-F.col("t.p")).alias(place), F.col("t.s").alias(score), *[F.col(f"t.{c}").alias(c) for c in rest])
    return out if least is None else out.where(F.col(score) >= least)


def cascade(cands: DataFrame, by: str, stages: list[tuple[Column, Column]]) -> DataFrame:
    """Each stage (applies, keep) narrows the candidates of a question, unless it would leave none.

    All windows share one partitioning, so the whole cascade is one exchange."""
    w = Window.partitionBy(by)
    for applies, keep in stages:
        marked = cands.withColumns({"_a": applies, "_k": keep})
        marked = marked.withColumn("_any", F.max("_k").over(w))
        cands = marked.where(~(F.col("_a") & F.col("_any")) | F.col("_k")).drop("_a", "_k", "_any")
    return cands


def preferred_first(ranked: DataFrame, by: str, preferred: Column, *order: Column) -> DataFrame:
    """Ranks again: preferred rows before others, each part in its order. Adds rank."""
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.coalesce(preferred, F.lit(False))), *order)))


def tiered(scored: DataFrame, by: str, tier: str, score: str, place: str) -> DataFrame:
    """The best row of the first tier that has any."""
    return top_k(scored, by, 1, F.asc(tier), F.desc(score), F.asc(place)).drop("rank")
