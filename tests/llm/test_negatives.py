"""Hard negatives against all pairs."""

import math
import random

from pyspark.sql import functions as F

from lexmill.llm import negatives as N

KIND = "vec_id long, embedding array<long>, label int"


def brute(rows, every=50, p=5, n=3):
    out = []
    for a, va, la in rows:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v, strict=True)), i, la == lb) for i, v, lb in rows if i != a)
        for s, i, same in [x for x in scored if x[2]][:p]:
            fit = [(t, j) for t, j, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s][:n]
            out += [(a, i, r + 1, j, -s, -t) for r, (t, j) in enumerate(fit)]
    return sorted(out)


def mined(df, *args):
    return sorted(tuple(r) for r in N.mine(df, *args).select("anchor", "positive", "rank", "negative", "positive_score", "negative_score").collect())


def test_all_pairs(spark, monkeypatch):
    """Many small cells, groups and parts; a third of all rows are copies of one vector, under two labels."""
    rng = random.Random(3)
    near = lambda c: [x + rng.randrange(-40, 41) for x in c]
    centres = [[rng.randrange(-200, 201) for _ in range(5)] for _ in range(6)]
    rows = [(i, near(centres[i % 6]), rng.randrange(3)) for i in range(400)] + [(i, [50, 60, 70, 80, 90], i % 2) for i in range(400, 600)]
    rows += [(i, [0] * 5, 1) for i in range(600, 604)]
    df = spark.createDataFrame(rows, KIND)
    want = brute(rows, 10)
    assert len(want) > 300 and mined(df, 10) == want
    for name, value in (("CELL_ROWS", 20), ("GROUP_ANCHORS", 7), ("BLOCK", 64)):
        monkeypatch.setattr(N, name, value)
    assert mined(df, 10) == want


def test_odd_rows(spark):
    good = [(0, [3, 4], 1), (1, [3, 5], 1), (2, [2, 1], 2), (3, [3, 3], 2), (50, [-3, -4], 1), (4, [0, 0], 1), (5, [1, 0], 3)]
    bad = [(60, None, 1), (61, [1, None], 1), (62, [1, 2, 3], 1), (63, [5, 5], None), (None, [5, 5], 1), (64, [1 << 40, 1], 2), (65, [], 1)]
    df = spark.createDataFrame(good + bad + [(3, [3, 3], 2), (3, [9, 9], 2), (3, [9, 9], 3)], KIND).withColumns({c: F.lit("x") for c in ("id", "v", "g", "pivot", "window", "score", "n")})
    assert mined(df) == brute(good) == [(0, 1, 1, 3, 29, 21)]
    assert mined(df.limit(0)) == [] and mined(df.where("vec_id >= 60")) == []


def test_large_products_stay_exact(spark):
    big = (1 << 28) + 1
    rows = [(0, [big, 3], 1), (1, [big, 2], 1), (2, [big - 40_000_000, 1], 2), (3, [big - 40_000_000, 2], 2), (4, [big - 40_000_000, 2], 2), (5, [big >> 3, 1], 2)]
    assert mined(spark.createDataFrame(rows, KIND)) == brute(rows)


def test_components_of_the_query(spark, tmp_path):
    rows = [(0, [0.5, math.nan], 1), (50, [0.5, 0.25], 1), (7, [0.5, 0.3], 0), (8, [0.3, 0.25], 2), (9, [0.25, -0.001], None), (100, [0.51, math.inf], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute([(50, [128, 64], 1), (7, [128, 76], 1), (8, [76, 64], 2)])
    assert sorted(tuple(r) for r in N.op12_hard_negatives(spark, str(tmp_path)).collect()) == want == [(50, 7, 1, 8, 21248, 13824)]
