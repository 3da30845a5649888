"""What showed on larger tables: results against SQL, and searches of few questions by matrices against all pairs."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill import catalog
from lexmill.operators import dense, language, scoring, topk


def test_cut_references_as_in_sql(spark, tmp_path):
    pages = [(1, "<p>a&amp;amp; b &lt;&copy;</p>"), (2, "<title>the&amp</title> &nbsp;x&lt y"), (3, "&am &copyx &"), (4, "&&&amp &middot;&quot;"), (5, None)]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["text"] for r in catalog.html_text_pages(spark, str(tmp_path)).collect()}
    sql = duckdb.connect()
    sql.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(sql.execute(catalog.SQL["html_text"]).fetchall())


def test_triggers_that_begin_and_end_within_words(spark, monkeypatch):
    """A trigger in a question counts whatever words they share; by a pass over the documents and by joins alike."""
    said = [(1, ["alpha beta", "no way"]), (2, ["alpha beta gamma", "alpha", "be be be", "alpha beta"]), (3, []), (4, ["way no", "no way", "no way to"])]
    docs = spark.createDataFrame([(d, d, d % 2, t, ["no", "way", "no"], 0.5 if d == 4 else 1.0) for d, t in said], "d long, place long, kind int, triggers array<string>, own array<string>, factor double")
    asked = spark.createDataFrame([(7, "xalpha betay"), (8, "xalpha beta gammay"), (9, "no way"), (10, "")], "q long, qn string").withColumn("qt", F.array_distinct(F.split("qn", " ")))
    sums = {(r["q"], r["d"]): r["score"] for r in scoring.trigger_sums(asked, docs.select("d", F.explode("triggers").alias("trigger")), "q", "d").collect()}
    want = {}
    for q, qn in ((7, "xalpha betay"), (8, "xalpha beta gammay"), (9, "no way"), (10, "")):
        for d, triggers in said:
            total = 0.0
            for t in triggers:
                words = set(t.split())
                hits = len(words & set(qn.split()))
                if len(words) > 1:
                    total += 3 * (hits == len(words)) + (hits / len(words) if hits >= max(1, len(words) // 2) else 0) + 0.5 * (len(t) >= 10 and t in qn)
            if total:
                want[q, d] = total
    assert sums == pytest.approx(want)
    own = {q: 3 * len({"no", "way"} & set(qn.split())) / 2 for q, qn in ((7, "xalpha betay"), (8, "xalpha beta gammay"), (9, "no way"), (10, ""))}
    every = {(q, d): (want.get((q, d), 0) + own[q]) * (0.5 if d == 4 else 1) for q in own for d, _ in said}
    got = {(r["q"], r["d"]): r["score"] for r in scoring.trigger_best(asked, docs.coalesce(1), "q", "d", 1).collect()}
    first = {}
    for (q, d), s in sorted(every.items(), key=lambda x: (-x[1], x[0])):
        if s > 0:
            first.setdefault((q, d % 2), (d, s))
    assert got == pytest.approx({(q, d): s for (q, _), (d, s) in first.items()})
    monkeypatch.setattr(dense, "BROADCAST_ROWS", 0)
    assert scoring.trigger_best(asked, docs, "q", "d", 1) is None


def test_runs_ranked_within_rows(spark):
    """Runs counted in a row are those counted by key, and a key's rows are one text; only texts and sums are exchanged."""
    said = [(1, "The cat, the cat and THE hat"), (2, "él y ella"), (3, ""), (4, None), (5, "a" * 5 + " " + " ".join("abcdefgh"[i:] for i in range(8))), (1, "more of it")]
    texts = spark.createDataFrame(said, "k long, t string")
    one = texts.groupBy("k").agg(F.concat_ws(" ", F.collect_list("t")).alias("t"))
    want = {(r["k"], r["rank"], r["gram"]) for r in language.ranks(one, "k", "t", 20).collect()}
    got = language.own_ranks(one, "k", "t", 20).select("k", F.posexplode("grams").alias("rank", "gram")).collect()
    assert {(r["k"], r["rank"], r["gram"]) for r in got} == want
    known = language.profiles(spark.createDataFrame([("en", "the cat and the hat of it"), ("es", "él y ella")], "lang string, text string"), "lang", "text")
    found = language.detect(texts, known, "k", "t")
    assert {(r["k"], r["lang"]) for r in found.collect()} >= {(1, "en"), (2, "es")} and found.where("k in (3, 4)").count() == 0
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_full_likeness_in_one_pass(spark, monkeypatch):
    """The token-set ratio inside the ranking, without joins of all pairs: as of all pairs, and as by joins where fewer words count."""
    rng = random.Random(3)
    draw = lambda n: " ".join(f"w{min(int(rng.expovariate(0.1)), 60)}" for _ in range(n))
    said = [(i, draw(rng.randrange(40)), f"n{i % 7}", [f"w{i % 5}", None]) for i in range(150)] + [(150, "w3 w4", None, []), (151, "w3 w4", "", []), (152, "", "w3", ["w4"])]
    docs = spark.createDataFrame(said, "d long, norm string, name string, tags array<string>").withColumn("toks", F.filter(F.split("norm", " "), lambda t: t != ""))
    asked = spark.createDataFrame([(f"q{i}", draw(rng.randrange(1, 9))) for i in range(40)] + [("x", "w3 w4"), ("y", "w3"), ("z", ""), ("none", "v")], "q string, norm string")
    asked = asked.withColumn("toks", F.filter(F.split("norm", " "), lambda t: t != ""))

    def firsts(df, k):
        by = {}
        for r in df.collect():
            by.setdefault(r["q"], []).append((-round(r["score"], 6), r["d"]))
        return {q: sorted(x)[:k] for q, x in by.items()}

    fewer = docs.withColumn("words", F.slice("toks", 1, 6))
    with monkeypatch.context() as m:
        m.setattr(dense, "BROADCAST_ROWS", 0)
        joined = {k: firsts(scoring.hybrid_best(asked, fewer, "q", "d", k, full=True), k) for k in (1, 3)}
    with monkeypatch.context() as m:
        m.setattr(scoring, "fuzzy_plain", scoring.fuzzy_full)
        every = scoring.hybrid(asked, docs, "q", "d").collect()
    every = spark.createDataFrame(every, "q string, d long, score double")

    def refused(*_, **__):
        raise AssertionError("pairs by joins")

    monkeypatch.setattr(topk, "candidates", refused)
    monkeypatch.setattr(dense, "SLICE", 16)
    for k in (1, 3):
        assert firsts(scoring.hybrid_best(asked, docs, "q", "d", k, full=True), k) == firsts(every, k)
        assert firsts(scoring.hybrid_best(asked, fewer, "q", "d", k, full=True), k) == joined[k]


def test_words_counted_in_bits(spark, monkeypatch):
    """Overlap by bits of documents, taken in small parts and with ties of all kinds, as of all pairs, and never by matrix rows."""
    rng = random.Random(8)
    draw = lambda n: list({f"w{min(int(rng.expovariate(0.08)), 90)}" for _ in range(n)})
    said = [(i, 1000 - i if i % 2 else i, draw(rng.randrange(60))) for i in range(700)] + [(700 + i, 2000 + i, [f"w{j}" for j in range(91)]) for i in range(3)] + [(800, 5, []), (801, 1, [f"w{j}" for j in range(40)])]
    docs = spark.createDataFrame(said, "d long, place long, toks array<string>")
    asked = spark.createDataFrame([(i, draw(rng.randrange(1, 40))) for i in range(60)] + [(60, ["w1"]), (61, []), (62, ["none"]), (63, [f"w{j}" for j in range(91)])], "q int, toks array<string>")

    def firsts(df, k):
        place, by = {d: p for d, p, _ in said}, {}
        for r in df.collect():
            by.setdefault(r["q"], []).append((-round(r["score"], 6), place[r["d"]], r["d"]))
        return {q: sorted(x)[:k] for q, x in by.items()}

    def refused(*_, **__):
        raise AssertionError("pairs by joins")

    every = scoring.overlap(asked, docs, "q", "d").cache()
    monkeypatch.setattr(topk, "candidates", refused)
    for k, least in ((1, None), (1, 0.5), (4, None), (9, 0.3)):
        want = firsts(every if least is None else every.where(F.col("score") >= least), k)
        assert firsts(scoring.overlap_best(asked, docs.coalesce(1), "q", "d", k, least), k) == want
        rows = [r for r in asked.collect()]
        told = docs.coalesce(1).withColumnRenamed("toks", "tokens")
        parts = dense.shares(rows, told, "d", k, least, size=7)  # passes of seven questions
        found = dense.keyed(parts, rows, asked.schema["q"].dataType, "q")
        assert firsts(found if least is None else found.where(F.col("score") >= least), k) == want


def test_documents_in_parts():
    """Parts hold as many documents and words as a task may take, and a question's best stay those of all documents."""
    rng = random.Random(2)
    words = [[f"w{rng.randrange(50)}" for _ in range(12)] for _ in range(40)]
    words = [list(set(ws)) for ws in words]
    docs = [sorted({rng.randrange(50) for _ in range(rng.randrange(30))}) for _ in range(900)]
    asked = dense.Bits(words)
    asked.docs, asked.WORDS, asked.DIGIT = 128, 700, 1 << 9
    sizes = np.array([len(d) for d in docs])
    parts = asked.dealt(sizes)
    assert sorted(i for p in parts for i in p.tolist()) == list(range(900)) and max(map(len, parts)) <= 128
    assert max(int(sizes[p].sum()) for p in parts) <= 700 + 30
    place = {w: i for i, w in enumerate(asked.vocabulary.to_pylist())}
    best = dense.Best(len(words), 2)
    for p in parts:
        p = np.sort(p)
        codes = [[place[f"w{t}"] for t in docs[i] if f"w{t}" in place] for i in p.tolist()]
        flat = np.array([c for cs in codes for c in cs], np.int64)
        row = np.repeat(np.arange(len(p)), [len(cs) for cs in codes])
        for q, doc, h in asked.best_of(flat, row, len(p), 2, best):
            best.add(q, p[doc], h / asked.n[q], p[doc], h)
        best.prune()
    got = {q: [tuple(x) for x in part[["hits", "d"]].head(2).to_numpy().tolist()] for q, part in best.prune().groupby("q")}
    for q, ws in enumerate(words):
        hits = sorted((-len({f"w{t}" for t in d} & set(ws)), i) for i, d in enumerate(docs))
        assert got[q] == [(-h, i) for h, i in hits[:2]]


@pytest.mark.parametrize("looked", [1000, 0])
def test_tags_in_texts(spark, monkeypatch, looked):
    """Some distinct tags are looked for in each text, many by joins of runs; repeats, short and empty tags, none exchanged with texts."""
    said = [(1, "the cat sat"), (2, "a"), (3, ""), (4, None), (5, "concatenate")]
    tags = [(1, ["cat", "cat", ""]), (2, ["a", None]), (3, ["the cat sat on"]), (4, []), (5, ["ten", "at"])]
    monkeypatch.setattr(scoring, "LOOKED", looked)
    got = scoring.tag_hits(spark.createDataFrame(said, "asked long, q string"), spark.createDataFrame(tags, "item long, tags array<string>"), "asked", "item")
    want = {(k, i): sum(t in q for t in ts if t) for k, q in said if q for i, ts in tags if any(t in q for t in ts if t)}
    assert {(r["asked"], r["item"]): r["hits"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("substring(q" in plan) == (looked == 0)
