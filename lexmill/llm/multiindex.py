"""Approximate nearest neighbours by an inverted multi-index: two halves, two codebooks, pairs of centroids by summed distance."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import Workspace, fits, ship, table
from lexmill.llm.vectors import BLOCK, best_of_rows, packed, ranked, sample, unpacked, usable

#: Rows that codebooks are fitted on, and queries that tell how far to go.
TRAIN_ROWS, TRIAL_QUERIES = 16_384, 128
#: Rows a cell should hold, and centroids of a half at most: a cell for each pair of them.
CELL_ROWS, MOST_CENTROIDS = 256, 512
#: Recall at which the trial queries set the number of candidates, and candidates at least.
RECALL, LEAST_CANDIDATES = 0.97, 1024


def unit(v: np.ndarray) -> np.ndarray:
    """Vectors of length one. A power of two is taken out first, so that squares neither overflow nor vanish."""
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows that stand side by side; each is summed by itself, so equal vectors get equal scores."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centroids."""
    return np.maximum(0.0, (x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1))


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centroids by Lloyd's rounds from spread-out rows; a centroid without rows moves to the row farthest from its own."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    rng = np.random.default_rng(0)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        d = distances(x, c)
        own = d.argmin(axis=1)
        sums, n = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, x)
        far = np.argsort(-d[np.arange(len(x)), own], kind="stable")
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[far[: len(c)]])
    return c


def traversed(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, want: int) -> Iterator[tuple[int, int]]:
    """Pairs of centroids by summed distance until their cells hold want rows: a heap with the next pair of each row."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap, got = [(s1[0] + s2[0], 0, 0)], 0
    while heap and got < want:
        _, i, j = heapq.heappop(heap)
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
        if j + 1 < len(s2):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        cell = int(o1[i]), int(o2[j])
        if sizes[cell]:
            got += int(sizes[cell])
            yield cell


@dataclass
class MultiIndex:
    """entries: cell, id, v (bytes) of all rows; sizes: rows by cell; block and parts: where a cell's rows meet queries.

    Cells of one row of the table of pairs share a block while they are small; a cell of many rows is a block of several
    parts. All but entries is bounded by the number of centroids."""

    codebooks: tuple[np.ndarray, np.ndarray]
    entries: DataFrame
    sizes: np.ndarray
    block: np.ndarray
    parts: np.ndarray
    rows: int
    dim: int

    def halves(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, h = unit(v), self.dim // 2
        return distances(u[:, :h], self.codebooks[0]), distances(u[:, h:], self.codebooks[1])


def _blocks(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    block, parts, k = np.zeros(sizes.shape, np.int64), np.ones(sizes.shape, np.int64), -1
    for i in range(sizes.shape[0]):
        k, held = k + 1, 0
        for j in range(sizes.shape[1]):
            if held and held + sizes[i, j] > most:
                k, held = k + 1, 0
            held += int(sizes[i, j])
            block[i, j] = k
            parts[i, j] = -(-int(sizes[i, j]) // most) or 1
    return block, parts


def build(vectors: DataFrame, work: Workspace, id_col: str = "vec_id", vec_col: str = "embedding") -> MultiIndex | None:
    """The index of all rows of vectors that take part; None if there are none.

    Codebooks are fitted on TRAIN_ROWS rows or so, chosen by id. Every row is then assigned to its cell in one pass."""
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, id_col, vec_col).where(F.exists("v", lambda x: x != 0))
    n = rows.count()
    if not n:
        return None
    chosen = np.stack([np.asarray(r["v"]) for r in sample(rows, n, TRAIN_ROWS).select("v").collect()] or [np.asarray(rows.first()["v"])])
    dim = chosen.shape[1]
    k = int(min(MOST_CENTROIDS, max(2, round((n / CELL_ROWS) ** 0.5))))
    u = unit(chosen)
    books = codebook(u[:, : dim // 2], k), codebook(u[:, dim // 2 :], k)
    index = MultiIndex(books, rows, np.zeros((len(books[0]), len(books[1])), np.int64), None, None, n, dim)
    wide = len(books[1])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["v"].tolist())
                d1, d2 = index_halves(v)
                yield pd.DataFrame({"cell": d1.argmin(axis=1) * wide + d2.argmin(axis=1), "id": pdf["id"], "v": packed(v)})

    index_halves = _halves(books, dim)
    index.entries = work.write(rows.mapInPandas(assign, "cell long, id long, v binary"), "entries")
    for cell, m in index.entries.groupBy("cell").agg(F.count("*")).collect():  # MOST_CENTROIDS squared at most
        index.sizes[cell // wide, cell % wide] = m
    index.block, index.parts = _blocks(index.sizes, BLOCK)
    return index


def _halves(books: tuple[np.ndarray, np.ndarray], dim: int):
    def both(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = unit(v)
        return distances(u[:, : dim // 2], books[0]), distances(u[:, dim // 2 :], books[1])

    return both


def _near(qid: np.ndarray, q: np.ndarray, eid: np.ndarray, e: np.ndarray, seen: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, entry's place, cosine) of the k best entries of each query, itself left out; seen: which pairs count."""
    about = unit(q) @ unit(e).T
    about[qid[:, None] == eid[None, :]] = -np.inf
    if seen is not None:
        about[~seen] = -np.inf
    row, col = best_of_rows(about, k, 1e-9)
    score = cosines(q[row], e[col]) if len(row) else np.zeros(0)
    top = ranked(row, score, eid[col], k)
    return row[top], col[top], score[top]


def exact(index: MultiIndex, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """(q, id, score, cell) of the k nearest of all entries, for a bounded number of queries that every task gets."""
    qid, q = queries["id"].to_numpy(), np.stack(queries["v"].tolist())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), BLOCK):
                part = pdf.iloc[lo : lo + BLOCK]
                row, col, score = _near(qid, q, part["id"].to_numpy(), unpacked(part["v"]), None, k)
                yield pd.DataFrame({"q": qid[row], "id": part["id"].to_numpy()[col], "score": score, "cell": part["cell"].to_numpy()[col]})

    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    found = index.entries.mapInPandas(run, "q long, id long, score double, cell long")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r").toPandas()


def enough(index: MultiIndex, queries: DataFrame, n: int, k: int, recall: float = RECALL) -> int:
    """How many rows a query's cells must hold for a recall of recall: TRIAL_QUERIES queries or so, chosen by id, are held
    against all rows, and it is counted how far the traversal has to go until it meets their neighbours' cells."""
    trial = sample(queries, n, TRIAL_QUERIES).toPandas()
    if trial.empty:
        return LEAST_CANDIDATES
    true = exact(index, trial, k)
    d1, d2 = _halves(index.codebooks, index.dim)(np.stack(trial["v"].tolist()))
    wide, needed = len(index.codebooks[1]), []
    for i, q in enumerate(trial["id"]):
        sought = true.loc[true["q"] == q, "cell"].tolist()
        got = 0
        at = {}
        for a, b in traversed(d1[i], d2[i], index.sizes, index.rows + 1):
            got += int(index.sizes[a, b])
            at[a * wide + b] = got
        needed += [at[c] for c in sought]
    return max(LEAST_CANDIDATES, int(np.quantile(needed, recall, method="higher"))) if needed else LEAST_CANDIDATES


def search(index: MultiIndex, queries: DataFrame, k: int = 5, candidates: int | None = None, work: Workspace | None = None) -> DataFrame:
    """(query, rank, id, score): for each of queries (id, v: rows that took part) the k nearest entries found, nearest first, ties to
    the smaller id, itself left out. All entries, if fewer.

    A query visits cells by summed distance of their centroids until they hold candidates rows (None: as many as the
    trial queries ask for), and every row of them is scored exactly. Queries go to the blocks of their cells, at most BLOCK
    rows and BLOCK queries at a time: blocks of many rows are parts, and rows of blocks of many queries are sent once for
    each part of these."""
    spark = queries.sparkSession
    ship(spark)
    work = work or Workspace(spark, "multiindex")
    queries = work.write(queries.select("id", "v"), "queries")
    n = queries.count()
    want = candidates or enough(index, queries, n, k)
    halves, wide, sizes, block, parts = _halves(index.codebooks, index.dim), len(index.codebooks[1]), index.sizes, index.block, index.parts

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                v = np.stack(part["v"].tolist())
                d1, d2 = halves(v)
                out = []
                for i, (q, body) in enumerate(zip(part["id"], packed(v), strict=True)):
                    cells: dict[tuple[int, int], list[int]] = {}
                    for a, b in traversed(d1[i], d2[i], sizes, want):
                        for p in range(parts[a, b]):
                            cells.setdefault((int(block[a, b]), p), []).append(a * wide + b)
                    out += [(b, p, q, body, c) for (b, p), c in cells.items()]
                yield pd.DataFrame(out, columns=["block", "part", "q", "qv", "cells"])

    visits = work.write(queries.mapInPandas(visit, "block long, part int, q long, qv binary, cells array<long>"), "visits")
    crowds = visits.groupBy("block", "part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("crowds"))
    crowds = F.broadcast(crowds) if fits(crowds) else crowds  # a row for each block
    asked = visits.join(crowds, ["block", "part"]).withColumn("crowd", F.pmod(F.xxhash64("q"), "crowds").cast("int")).drop("crowds")
    flat_block, flat_parts = block.ravel(), parts.ravel()

    @F.pandas_udf("struct<block:long,parts:int>")
    def placed(cell: pd.Series) -> pd.DataFrame:
        c = cell.to_numpy()
        return pd.DataFrame({"block": flat_block[c], "parts": flat_parts[c]})

    held = index.entries.withColumn("p", placed("cell")).select("cell", "id", "v", "p.block", F.pmod(F.xxhash64("id"), F.col("p.parts")).cast("int").alias("part"))
    held = held.join(crowds, ["block", "part"]).withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1))).drop("crowds")

    def meet(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame({"query": [], "id": [], "score": []})
        cells, own = np.unique(held["cell"].to_numpy(), return_inverse=True)
        seen = np.zeros((len(asked), len(cells)), bool)
        for i, c in enumerate(asked["cells"]):
            at = np.searchsorted(cells, np.asarray(c))
            ok = at < len(cells)
            at, c = at[ok], np.asarray(c)[ok]
            seen[i, at[cells[at] == c]] = True
        qid, eid = asked["q"].to_numpy(), held["id"].to_numpy()
        row, col, score = _near(qid, unpacked(asked["qv"]), eid, unpacked(held["v"]), seen[:, own], k)
        return pd.DataFrame({"query": qid[row], "id": eid[col], "score": score})

    key = ["block", "part", "crowd"]
    found = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(meet, "query long, id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "rank", "id", "score")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, candidates: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query, rank, id, score): the k nearest rows by cosine of each row whose id is divisible by every, among all others.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without id and rows of another length
    than most. Rows of one id count once (the least vector). Other columns are not read; an empty table gives no rows."""
    work = Workspace(vectors.sparkSession, "multiindex")
    index = build(vectors, work, id_col, vec_col)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query long, rank int, id long, score double")
    asked = index.entries.where(F.col("id") % every == 0).select("id", "v").mapInPandas(_opened, "id long, v array<double>")
    return search(index, asked, k, candidates, work)


def _opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(v=list(unpacked(pdf["v"])) if len(pdf) else [])


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
