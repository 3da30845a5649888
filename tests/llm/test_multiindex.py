"""The inverted multi-index against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from lexmill.llm import multiindex as M
from lexmill.llm import vectors as V
from lexmill.llm.common import Workspace

KIND = "vec_id long, embedding array<double>"


def brute(rows, every, k):
    x = {i: np.asarray(v, float) for i, v in rows}
    out = []
    for q in x:
        if q % every == 0:
            s = sorted((-float(M.cosines(x[q][None], x[i][None])[0]), i) for i in x if i != q)[:k]
            out += [(q, r + 1, i, -c) for r, (c, i) in enumerate(s)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("query", "rank", "id", "score").collect())


def test_traversal_goes_by_summed_distance():
    rng = np.random.default_rng(1)
    d1, d2, sizes = rng.random(9), rng.random(7), rng.integers(0, 5, (9, 7))
    cells = list(M.traversed(d1, d2, sizes, 10**9))
    assert sorted(cells) == sorted(zip(*map(list, np.nonzero(sizes)), strict=True))
    sums = [d1[i] + d2[j] for i, j in cells]
    assert sums == sorted(sums)
    some = list(M.traversed(d1, d2, sizes, 20))
    assert some == cells[: len(some)] and sum(sizes[c] for c in some[:-1]) < 20 <= sum(sizes[c] for c in some)


def test_all_candidates_when_few(spark, monkeypatch):
    """Ties, copies, hot cells, blocks of one row: exact while a query's cells hold everything."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6)) for i in range(300)] + [(i, np.array([1.0, 2, 3, 4, 5, 6])) for i in range(300, 420)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], KIND)
    want = brute(rows, 20, 5)
    for block in (2048, 16):
        monkeypatch.setattr(M, "BLOCK", block)
        assert found(M.nearest(df, 20, 5, 1000)) == want
    assert found(M.nearest(df.limit(3), 1, 5)) == brute(rows[:3], 1, 5)


def test_odd_rows(spark):
    bad = [(100, None), (101, [0.0, 0.0]), (102, [None, 1.0]), (103, [math.nan, 1.0]), (104, [math.inf, 1.0]), (105, [1.0, 2.0, 3.0]), (106, []), (None, [1.0, 1.0])]
    good = [(0, [1.0, 0.0]), (1, [1e200, 1e200]), (2, [1e-300, 0.0]), (3, [-1.0, 0.0]), (50, [1.0, 1e-3]), (4, [1.0, 0.0])]
    df = spark.createDataFrame(bad + good + [(4, [1.0, 0.0]), (4, [5.0, 0.0]), (0, [1.0, 0.0])], KIND).withColumns({c: F.lit("x") for c in ("id", "v", "cell", "query", "d", "n")})
    out = found(M.nearest(df))
    assert out == brute(good, 50, 5)
    assert [r[2] for r in out if r[0] == 0] == [2, 4, 50, 1, 3]
    assert M.nearest(df.limit(0)).count() == 0 and M.nearest(df.where("vec_id > 99")).count() == 0
    one = spark.createDataFrame([(0, [2.0]), (1, [3.0]), (2, [-1.0])], KIND)
    assert [(r[2], r[3]) for r in found(M.nearest(one))] == [(1, 1.0), (2, -1.0)]


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = M.build(df, Workspace(spark, "test"))
    assert index.sizes.sum() == df.count() and len(index.codebooks[0]) > 2
    rows = [(r["vec_id"], np.asarray(r["embedding"], float)) for r in df.collect()]
    x, ids = M.unit(np.stack([v for _, v in rows])), np.array([i for i, _ in rows])
    asked = V.usable(df, "vec_id", "embedding").where("id % 10 = 0")
    limit = M.enough(index, asked, 200, 5, 0.95)
    assert limit < len(rows)  # the index is put to work
    got = {}
    for r in M.search(index, asked, 5, limit).collect():
        got.setdefault(r["query"], set()).add(r["id"])
    hits = 0
    for q, near in got.items():
        s = x @ x[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -9
        hits += len(near & set(ids[np.lexsort((ids, -s))[:5]].tolist()))
    assert len(got) == 200 and hits >= 0.9 * 1000
