"""Formulas by hand-computed values, and every query against its SQL."""

import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lexmill import catalog, catalog_answers
from lexmill.functions import text as X
from lexmill.operators import merge, products, ranking, scoring
from lexmill.plans import provider, routing, rules
from lexmill.sources.knowledge import read_items, read_texts
from lexmill.sources.tagged import parse_pairs
from lexmill.streaming.answering import answer_stream


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(col).first()[0]


def test_normalisers(spark):
    assert one(spark, X.normalize(F.col("t")), t="  Così-è   È_1 ") == "così è è_1"
    assert one(spark, X.normalize_folded(F.col("t")), t="Così-è_1") == "cosi e 1"
    assert one(spark, X.compact(F.col("t")), t="Ø 12/A-b") == "o12ab"
    assert one(spark, X.normalize_stop(F.col("t"), ("la",)), t="La casa-È la") == "casa-e"
    assert one(spark, X.clamp(F.col("t"), 10), t="One. Two three four") == "One. …"


def test_synonyms_keep_first_mentions(spark):
    out = one(spark, X.expand(F.split("t", " "), {"fee": ["price", "cost"]}), t="the price fee")
    assert out == ["the", "price", "fee", "cost"]


def test_overlap_bounds_and_ties(spark):
    q = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["x"])], "q int, toks array<string>")
    d = spark.createDataFrame([(7, ["a"]), (5, ["b", "b"]), (9, [])], "d int, toks array<string>")
    s = scoring.overlap(q, d, "q", "d")
    assert rows(s) == [(1, 5, 0.5), (1, 7, 0.5)]
    assert rows(ranking.best(s, "q", "score", "d")) == [(1, 5, 0.5)]


def test_trigger_score(spark):
    df = spark.createDataFrame([("how to lay bolts", ["lay bolts", "bolts now", "lay", "how to lay bolts"])], "q string, t array<string>")
    got = df.select(scoring.trigger_score(F.array_distinct(F.split("q", " ")), F.col("q"), F.col("t"))).first()[0]
    assert got == (3 + 1) + 0.5 + 0 + (3 + 1 + 0.5)


def test_triggers_of_whole_texts(spark, tmp_path):
    rng = random.Random(4)
    words = ["a", "to", "the", "bolt", "nut", "screw", "washer", "connector"]
    said = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))
    docs = [(i, "".join(said() + rng.choice([". ", "!\n", "\n", "? "]) for _ in range(rng.randrange(40)))) for i in range(60)]
    docs += [(100, "filler words here. " * 100 + "Mount every dowel"), (101, None), (102, "")]
    items = [(i, said()) for i in range(20)] + [(50, "please mount every dowel"), (51, ""), (52, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def score(question, text):
        total, qt = 0.0, set(question.split())
        for t in (" ".join(x.lower().split()) for x in re.split(r"[.!?]+(?=\s|$)|\n", text)):
            w = set(t.split())
            if len(w) > 1:
                hits = len(w & qt)
                total += 3 * (hits == len(w)) + (hits / len(w) if hits >= max(1, len(w) // 2) else 0) + 0.5 * (len(t) >= 10 and t in question)
        return round(total, 6)

    want = []
    for i, question in items:
        best = sorted((-score(question or "", t or ""), d) for d, t in docs)
        want += [(i, d, -s, k) for k, (s, d) in enumerate(best[:15], 1) if s < 0]
    got = catalog.trigger_texts_top15(spark, str(tmp_path)).select("item_id", "doc_id", "score", "rank")
    assert rows(got) == sorted(want, key=str)
    assert (50, 100, 4.5) in {r[:3] for r in want}


def test_merge_last_wins(spark):
    a = spark.createDataFrame([(1, "x", 0), (1, "y", 1), (2, "z", 2), (None, "n", 3)], "id int, v string, p int")
    b = spark.createDataFrame([(2, "w", 0)], "id int, v string, p int")
    assert rows(merge.merge_layers([a, b], "id", "p").select("id", "v")) == [(1, "y"), (2, "w")]
    again = merge.merge_layers([a, b, b], "id", "p").select("id", "v")
    assert rows(again) == [(1, "y"), (2, "w")]


def test_cascade_never_empties(spark):
    c = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, False)], "q int, d int, ok boolean")
    assert rows(ranking.cascade(c, "q", [(F.lit(True), F.col("ok"))])) == [(1, 1, True), (2, 1, False)]


def test_pairs_of_tagged_text(spark):
    lines = ["[TAGS: a]", "R: lost", "D: first?", "R: yes", "more", "domanda: second?", "risposta: no"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "doc string, place int, line string")
    assert rows(parse_pairs(df)) == [("f", 1, "first?", "yes\nmore"), ("f", 2, "second?", "no")]


def test_slots(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"},), ({"a": "1"},), ({"b": ""},), (None,)], "m map<string,string>")
    out = [tuple(r[0]) for r in df.select(routing.fill_slots(F.col("m"), ["a", "b"], ["a"], {"b": "0"})).collect()]
    assert out == [("OK", ""), ("OK", ""), ("ASK_CLIENT", "a"), ("ERROR", "")]


def test_stream_equals_batch(spark, tmp_path):
    src = spark.createDataFrame([(1, "the price"), (2, "nothing")], "id int, text string")
    src.write.parquet(str(tmp_path / "in"))
    answer = lambda df: df.select("id", routing.route(F.col("text"), [("commercial", ("price",))], "technical").alias("route"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    answer_stream(stream, answer, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("id", "route")) == rows(answer(src))


def test_token_set_ratio():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for a, b in (("", "x"), ("abcbdab", "bdcaba"), ("the cat", "a hat the"), ("aaaa", "aa")):
        assert scoring.common_subsequence(a, b) == plain(a, b)
    assert scoring.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert scoring.token_set_ratio("", "a") == 0
    assert round(scoring.token_set_ratio("ab", "ac"), 6) == 50


def test_hybrid_on_one_pair(spark):
    q = spark.createDataFrame([(1, "red bolt", ["red", "bolt"])], "q int, norm string, toks array<string>")
    d = spark.createDataFrame([(1, "red bolt", ["red", "bolt"], "red bolt", ["red"]), (2, "x", ["x"], "x", []), (3, "y", ["y"], "y", [])], "d int, norm string, toks array<string>, name string, tags array<string>")
    assert rows(scoring.hybrid(q, d, "q", "d").select("q", "d", F.round("score", 6))) == [(1, 1, 1.0)]


def test_rules(spark):
    got = one(spark, rules.answer_by_pattern(F.col("q"), F.col("a"), [{"pattern": "^x", "mode": "override", "answer": "X"}, {"pattern": "x", "mode": "augment", "answer": "more"}]), q="xx", a="old")
    assert got == "X\n\nmore"
    good, bad = rules.usable(spark, [{"pattern": "a"}, {"pattern": "("}])
    assert (len(good), len(bad)) == (1, 1)
    assert one(spark, rules.render("{b} and {a}", a=F.col("x"), b=F.lit("{a}")), x="1") == "{a} and 1"


def test_provider_falls_back(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, p string")
    assert {r["reply"] for r in provider.ask(df, "p").collect()} == {provider.UNAVAILABLE}
    assert [r["reply"] for r in provider.ask(df, "p", call=lambda p: [x.upper() for x in p]).orderBy("id").collect()] == ["A", ""]
    c = spark.createDataFrame([(1, 7, 1, "8"), (1, 8, 2, "8"), (2, 7, 1, None), (2, 9, 2, None)], "q int, d int, r int, chosen string")
    assert rows(provider.pick(c, "q", "d", "r", "chosen")) == [(1, 8, 2), (2, 7, 1)]


def test_knowledge_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"items": [{"id": "1"}, {"id": "2"}]}')
    (tmp_path / "b.json").write_text('[{"id": "3"}]')
    (tmp_path / "c.json").write_text("{")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "t.TXT").write_text("hello")
    got = read_items(spark, str(tmp_path / "*.json"), "id string").select("place", "id")
    assert rows(got) == [(0, "1"), (0, "3"), (1, "2")]
    assert read_items(spark, str(tmp_path / "none"), "id string").count() == 0
    assert rows(read_texts(spark, str(tmp_path)).select("name", "text")) == [("t.TXT", "hello")]
    with pytest.raises(Exception):
        read_items(spark, str(tmp_path / "c.json"), "id string", strict=True).collect()


def test_lookup_prefers_exact_names(spark):
    p = spark.createDataFrame([(1, "Red bolt"), (2, "redbolt"), (3, "blue nut")], "k int, n string")
    q = spark.createDataFrame([("RED-BOLT",), ("a nut 5",), ("none",)], "q string")
    assert rows(products.lookup(q, p, "q", "q", "k", "n", ("red",), ("red",))) == [("RED-BOLT", 1, True, None), ("a nut 5", 3, False, 1.0)]


QUERIES, SQL = catalog.QUERIES | catalog_answers.QUERIES, catalog.SQL | catalog_answers.SQL


SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Plans of many jobs, which take long on few cores: the larger tables are left to the comparison of all queries.
LONG = {"answer_by_blocks", "answer_by_route", "answer_by_search", "stream_answers", "hybrid_top1", "second_chance", "rule_table", "detected_languages", "engine_answers", "trigger_top15"}


@pytest.mark.parametrize(("name", "sf"), [(n, s) for n in sorted(SQL) for s in (SMALL, LARGER) if s == SMALL or n not in LONG])
def test_query_equals_sql(spark, name, sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    got, want = QUERIES[name](spark, sf), con.sql(SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert rows(got.select(*cols)) == sorted((tuple(r) for r in want.project(", ".join(f'"{c}"' for c in cols)).fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
