"""What operators on vectors share: which rows take part, vectors as bytes, and best rows of blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import small

#: Rows of two blocks that meet in one task at most.
BLOCK = 2048


def usable(df: DataFrame, id_col: str, vec_col: str, *more: str) -> DataFrame:
    """(id, v, and more) of the rows that take part: id and vector not null, all components finite, and as many of them
    as most such rows have (of equal counts the larger). Of rows with one id one counts, that of the least columns."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), *more)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size("v") > 0))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.where(F.size("v") == (sizes["d"] if sizes else 0))
    again = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    if again.isEmpty():
        return rows
    again = small(again)
    one = rows.join(again, "id", "left_semi").groupBy("id").agg(F.min(F.struct(*more, "v")).alias("t")).select("id", "t.v", *[F.col(f"t.{c}").alias(c) for c in more])
    return rows.join(again, "id", "left_anti").unionByName(one)


def sample(rows: DataFrame, n: int, most: int) -> DataFrame:
    """About most of n rows, chosen by the digest of their id; never over twice as many."""
    share = min(1.0, most / max(n, 1))
    return rows.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * most)


def packed(vectors: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in vectors]


def unpacked(column: pd.Series, kind=np.float64) -> np.ndarray:
    """The vectors of a column of bytes, one a row."""
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def best_of_rows(scores: np.ndarray, k: int, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest finite scores, with all within slack of the last of them."""
    k = min(k, scores.shape[1])
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return np.nonzero((scores >= (least - slack)[:, None]) & np.isfinite(scores))


def ranked(row: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's first k by score, then by smaller id."""
    order = np.lexsort((ident, -score, row))
    rows = row[order]
    first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
    return order[np.arange(len(rows)) - start < k]
