"""Pruned searches against all pairs, words of most documents, names without all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import joins, names, scoring, topk


def docs_and_questions(spark, n=300, seed=1, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    draw = lambda m: [vocabulary[min(int(rng.expovariate(0.12)), words - 1)] for _ in range(m)]
    docs = [(i, draw(rng.randrange(0, 40))) for i in range(n)] + [(n + i, ["w1", "w2", "w9"]) for i in range(20)]
    asked = [(i, draw(rng.randrange(0, 9))) for i in range(25)] + [(25, ["none"]), (26, ["w0"])]
    row = lambda k: f"{k} long, toks array<string>"
    return spark.createDataFrame(docs, row("d")), spark.createDataFrame(asked, row("q"))


def best(df, k):
    """The k best of each question by rounded score, then id."""
    by = {}
    for r in df.collect():
        by.setdefault(r["q"], []).append((-round(r["score"], 6), r["d"]))
    return {q: sorted(x)[:k] for q, x in by.items()}


@pytest.mark.parametrize("k", [1, 7])
def test_best_of_all_pairs(spark, k, monkeypatch):
    docs, asked = docs_and_questions(spark)
    every, few = scoring.bm25(asked, docs, "q", "d"), scoring.bm25_best(asked, docs, "q", "d", k)
    assert best(few, k) == best(every, k) and few.count() < every.count()
    assert best(scoring.overlap_best(asked, docs, "q", "d", k), k) == best(scoring.overlap(asked, docs, "q", "d"), k)
    some = scoring.overlap(asked, docs, "q", "d").where("score >= 0.5")
    assert best(scoring.overlap_best(asked, docs, "q", "d", k, 0.5), k) == best(some, k)
    monkeypatch.setattr(topk, "SAMPLE", 0.0)  # thresholds from rare words alone
    assert best(scoring.bm25_best(asked, docs, "q", "d", k), k) == best(every, k)


def test_negative_weights_and_small_collections(spark):
    """Words of nearly all documents weigh less than nothing where most words are such."""
    docs = spark.createDataFrame([(i, ["a", "b"] + (["c"] if i < 6 else []) + ["a"] * (i % 3)) for i in range(8)], "d long, toks array<string>")
    asked = spark.createDataFrame([(1, ["a", "c", "b"]), (2, ["c"]), (3, [])], "q long, toks array<string>")
    every = scoring.bm25(asked, docs, "q", "d")
    assert every.agg(F.min("score")).first()[0] < 0
    for k in (1, 3, 20):
        assert best(scoring.bm25_best(asked, docs, "q", "d", k), k) == best(every, k)
    assert scoring.bm25_best(asked, docs.limit(0), "q", "d", 3).count() == 0 and scoring.bm25_best(asked.limit(0), docs, "q", "d", 3).count() == 0


def test_words_of_most_documents_beyond_broadcast(spark, monkeypatch):
    """One word in nine of ten documents, no side broadcast: its rows are dealt, and results stay."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, (["hot"] if i % 10 else []) + [f"w{rng.randrange(300)}" for _ in range(4)]) for i in range(3000)], "d long, toks array<string>")
    asked = spark.createDataFrame([(i, ["hot", f"w{i}", f"w{i + 1}"]) for i in range(60)], "q long, toks array<string>")
    want = best(scoring.bm25_best(asked, docs, "q", "d", 5), 5)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "HOT_ROWS", 20)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert best(scoring.bm25_best(asked, docs, "q", "d", 5), 5) == want
        rows = scoring.postings(docs, "d", F.col("toks"))
        met = joins.word_join(rows, asked.select("q", F.explode("toks").alias("token")), "token", "d")
        assert met.count() == scoring.postings(docs, "d", F.col("toks")).join(asked.select("q", F.explode("toks").alias("token")), "token").count()
        sizes = sorted(r["n"] for r in met.where("q = 1 and token = 'hot'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
        assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sizes[-1] < 2 * sizes[len(sizes) // 2]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_names_against_all_pairs(spark, monkeypatch):
    rng = random.Random(6)
    part = lambda n: "".join(rng.choice("abc") for _ in range(rng.randrange(n)))
    docs = [(i, part(9), [part(6) for _ in range(rng.randrange(3))]) for i in range(150)] + [(150, "zebra crossing", ["zoo"]), (151, "", []), (152, "zebra crossing", [])]
    asked = [(i, part(12)) for i in range(120)] + [(120, "the zebra crossing"), (121, "zebra"), (122, "z"), (123, "xyxyxyx"), (124, ""), (125, "zo")]
    dd = spark.createDataFrame(docs, "d long, name string, tags array<string>")
    qq = spark.createDataFrame(asked, "q long, qn string")

    def boost(q, name, tags):
        meet = lambda t: t != "" and (t in q or q in t)
        return 0.12 * meet(name) + 0.08 * any(map(meet, tags))

    want = {}
    for q, text in asked:
        s, d = min((-boost(text, name, tags), d) for d, name, tags in docs)
        want[q] = (d, round(-s, 6))
    got = lambda: {r["q"]: (r["d"], round(r["score"], 6)) for r in names.first_by_name(qq, dd, "q", "d", scoring.boost).collect()}
    assert got() == want
    plan = names.first_by_name(qq, dd, "q", "d", scoring.boost)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "HOT_ROWS", 10)
    assert got() == want


def test_hybrid_with_either_likeness(spark):
    rng = random.Random(9)
    draw = lambda n: " ".join(f"w{min(int(rng.expovariate(0.2)), 30)}" for _ in range(n))
    docs = [(i, draw(rng.randrange(1, 12)), f"n{i % 7}", [f"w{i % 5}"]) for i in range(120)] + [(120, "w3", "", []), (121, "w3 w4", "", [])]
    asked = [(i, draw(rng.randrange(1, 7))) for i in range(30)] + [(30, "w3 w4"), (31, "w3")]
    dd = spark.createDataFrame(docs, "d long, norm string, name string, tags array<string>").withColumn("toks", F.split("norm", " "))
    qq = spark.createDataFrame(asked, "q long, norm string").withColumn("toks", F.split("norm", " "))
    every = scoring.hybrid(qq, dd, "q", "d")
    for k in (1, 4):
        assert best(scoring.hybrid_best(qq, dd, "q", "d", k), k) == best(every, k)
    # the full ratio by a plain table over all pairs
    parts = scoring._parts(qq, dd, "q", "d", 1.5, 0.75, 0.25).groupBy("q", "d").agg(F.sum("part").alias("bm"), F.count("*").alias("hits")).collect()
    most = {}
    for r in parts:
        most[r["q"]] = max(most.get(r["q"], -9e9), r["bm"])
    text, of = dict(asked), {d: (n, name, tags) for d, n, name, tags in docs}
    want = {}
    for r in parts:
        q, (norm, name, tags) = text[r["q"]], of[r["d"]]
        meet = lambda t, q=q: t != "" and (t in q or q in t)
        bm = r["bm"] / most[r["q"]] if most[r["q"]] > 0 else r["bm"]
        s = 0.6 * bm + 0.25 * r["hits"] / len(set(q.split())) + 0.15 * by_table(q, norm) + 0.12 * meet(name) + 0.08 * any(map(meet, tags))
        want.setdefault(r["q"], []).append((-round(max(0.0, min(1.0, s)), 6), r["d"]))
    for k in (1, 4):
        assert best(scoring.hybrid_best(qq, dd, "q", "d", k, full=True), k) == {q: sorted(x)[:k] for q, x in want.items()}
    bound = spark.createDataFrame([(a[1], b[1]) for a in asked for b in docs], "a string, b string")
    over = bound.select(scoring.fuzzy_full(F.col("a"), F.col("b")).alias("x"), scoring.ratio_bound(F.col("a"), F.col("b")).alias("y"))
    assert over.where("x > y + 1e-9").count() == 0


def by_table(a, b):
    """The token-set ratio with the subsequences' lengths in a plain table."""
    x, y = set(a.split()), set(b.split())
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))

    def likeness(s, t):
        rows = [0] * (len(t) + 1)
        for c in s:
            row = [0]
            for j, e in enumerate(t):
                row.append(rows[j] + 1 if c == e else max(rows[j + 1], row[j]))
            rows = row
        return 2 * rows[-1] / (len(s) + len(t)) if s or t else 1.0

    if both and not (left and right):
        return 1.0
    first, second = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(likeness(first, second), *([likeness(both, first), likeness(both, second)] if both else [0.0]))
