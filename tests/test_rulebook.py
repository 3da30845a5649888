"""Rules as tables against every rule on every question."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexmill.plans import rulebook


@pytest.mark.parametrize(("pattern", "want"), [
    ("abcd", ["abcd"]), ("(?i)Ab Cd", ["ab cd"]), ("abc?def", ["def"]), ("abcx*", ["abc"]), ("abc{0,2}defg", ["defg"]), ("abc+d", ["abc"]), ("abc|defg", ["abc", "defg"]),
    ("abc|de", None), (r"\babc\b", ["abc"]), (r"a\.bc", ["a.bc"]), ("[abc]def", ["def"]), ("(abc|x)def", ["def"]), ("(abcdef)?", None), ("ab", None), ("àbcd", ["bcd"]),
    (r"\x41bcd", None), ("(?x)a b c d", None), ("ab(?i)cdef", None), ("abc.*xyz1", ["xyz1"]), ("", None), ("abc$", ["abc"]), (r"\p{L}abc", None), (r"abc\d+e", ["abc"]),
])
def test_literals(pattern, want):
    assert rulebook.literals(pattern) == want


def test_literals_are_in_every_match():
    rng = random.Random(2)
    parts = ["ab", "cde", "f", "(gh|i)", "[jk]", "l?", "m+", ".", "n*", "|", r"\.", "op", "é", "q{2}", r"\d"]
    for _ in range(4000):
        pattern = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 8)))
        found = rulebook.literals(pattern)
        if found:
            text = "".join(rng.choice(["ab", "cde", "f", "gh", "i", "j", "l", "m", "n", ".", "op", "é", "qq", "7"]) for _ in range(30))
            for m in re.finditer(pattern, text):
                assert any(x in m[0] for x in found), pattern


def test_ten_thousand_rules(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [(i, " ".join(word() for _ in range(30)).title()) for i in range(60)] + [(60, None), (61, "")]
    rules = [(i, f"(?i){word()[:3]}.{word()[:2]}" if i % 3 else word().title()) for i in range(10_000)] + [(10_000, "^.?$"), (10_001, "(?i)[ab] ?c"), (10_002, "(open"), (10_003, None), (10_004, "abc'?*")]
    table = spark.createDataFrame(rules, "rule long, pattern string")
    good, bad = rulebook.usable(table)
    assert sorted(r["rule"] for r in bad.collect()) == [10_002, 10_003, 10_004] and good.count() == 10_002
    got = sorted((r["q"], r["rule"]) for r in rulebook.matches(spark.createDataFrame(texts, "q long, text string"), good).collect())
    compiled = [(i, re.compile(p)) for i, p in rules[:10_002]]
    want = sorted((q, i) for q, t in texts if t is not None for i, p in compiled if p.search(t))
    assert got == want and len(want) > 300


def test_answers_and_expectations(spark):
    asked = spark.createDataFrame([(1, "one price list", "base"), (2, "nothing", "base"), (3, None, None), (4, "price of one", "base")], "q long, text string, answer string")
    rules = spark.createDataFrame([(1, "price", "override", "P1", 1), (2, "one", "override", "P2", 5), (3, "list", "augment", "A1", None), (4, "one", "augment", "A2", 9), (5, "e", "postscript", "PS", 0)], "rule long, pattern string, mode string, answer string, priority int")
    assert {r["q"]: r["answer"] for r in rulebook.answers(asked, rules).collect()} == {1: "P2\n\nA2\n\nA1\n\nPS", 2: "base", 3: "", 4: "P2\n\nA2\n\nPS"}
    blocks = spark.createDataFrame([("A-1", "f", "x and y"), ("A-2", "f", None), ("B-1", "g", "x")], "id string, family string, answer string")
    want = spark.createDataFrame([(1, "f", "A", ["x", "y"]), (2, "f", "A-1", ["z"]), (3, "g", "", []), (4, None, "", ["x"])], "rule long, family string, id_hint string, must_include array<string>")
    assert sorted(map(tuple, rulebook.expectations(blocks, want).collect())) == [("A-1", 1, True), ("A-1", 2, False), ("A-2", 1, False), ("B-1", 3, True)]
    assert rulebook.matches(asked.select("q", "text").limit(0), rules).count() == 0 and rulebook.matches(asked.select("q", F.col("text")), rules.limit(0)).count() == 0
