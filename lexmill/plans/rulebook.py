"""Rules as tables of any number: pattern rules found by a run of characters that a match must hold, expectations by family."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.joins import few, fits, stored, word_join
from lexmill.operators.names import runs

#: Length of the runs by which patterns are found.
RUN = 3
_FLAGS = re.compile(r"\(\?([a-zA-Z-]+)\)")
_CLASS = set("dDwWsSbBhHvVRXAzZGkpPQE")


def literals(pattern: str) -> list[str] | None:
    """A run of ASCII characters, lower-cased, for each alternative of a pattern that any match of it holds; None where an
    alternative has none of RUN characters. Groups, classes and what may be absent count for nothing."""
    found: list[str] = []
    best, now, depth, i = "", "", 0, 0
    flags = _FLAGS.match(pattern)
    if flags:
        if set(flags[1]) - set("ismu"):
            return None
        i = flags.end()

    def closed() -> str:
        return max(best, now, key=len)

    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            e = pattern[i + 1 : i + 2]
            if not e or e.isalnum():  # a class or a place; named ones and numbers go on behind it
                if e in "pPkxuQNco0123456789" or e not in _CLASS and e not in "tnrfae":
                    return None
                best, now, i = closed(), "", i + 2
                continue
            c, i = e, i + 1
        elif c == "[":
            end = i + 1 + (pattern[i + 1 : i + 2] == "^")
            end = pattern.find("]", end + 1)
            if end < 0 or "[" in pattern[i + 1 : end] or "\\" in pattern[i:end] or "&&" in pattern[i:end]:
                return None
            best, now, i = closed(), "", end + 1
            continue
        elif c == "(":
            if pattern.startswith("(?", i) and _FLAGS.match(pattern, i):
                return None  # flags in the middle
            best, now, depth, i = closed(), "", depth + 1, i + 1
            start, level = i, 1
            while i < len(pattern) and level:
                if pattern[i] == "\\":
                    i += 1
                elif pattern[i] == "[":
                    return None  # brackets within groups may hold parentheses
                level += (pattern[i : i + 1] == "(") - (pattern[i : i + 1] == ")")
                i += 1
            if level or i == start:
                return None
            continue
        elif c == "|":
            found.append(closed())
            best, now, i = "", "", i + 1
            continue
        elif c in "*?{":
            best, now = max(best, now[:-1], key=len), ""
            i = pattern.find("}", i) + 1 if c == "{" else i + 1
            if not i:
                return None
            continue
        elif c in "+.^$)":
            best, now, i = closed(), "", i + 1
            continue
        if ord(c) < 128:
            now += c.lower()
        else:
            best, now = closed(), ""
        i += 1
    found.append(closed())
    return found if all(len(x) >= RUN for x in found) else None


def usable(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rules whose pattern compiles, and those whose does not (or is null). Patterns pass the driver one by one, each
    distinct one once."""
    spark = rules.sparkSession
    compile_ = spark._jvm.java.util.regex.Pattern.compile
    bad = []
    for r in rules.select("pattern").where("pattern is not null").distinct().toLocalIterator():
        try:
            compile_(r["pattern"])
        except Exception:  # what the JVM throws for a pattern, through the gateway
            bad.append((r["pattern"],))
    wrong = stored(spark.createDataFrame(bad, "pattern string"))
    none = rules.where("pattern is null")
    return rules.join(few(wrong), "pattern", "left_anti").where("pattern is not null").select(*rules.columns), rules.join(few(wrong), "pattern", "left_semi").select(*rules.columns).unionByName(none)


def matches(questions: DataFrame, rules: DataFrame, q: str = "q", text: str = "text", rule: str = "rule") -> DataFrame:
    """(q, rule): which rules' patterns are found in which questions' texts. Patterns have to compile; see usable().

    A match must hold one of the pattern's literals. Each literal is looked up by its rarest run of three characters, as counted over the
    questions, in an equi-join with the questions' runs; then the literal and, last, the pattern are tested. Patterns
    without such a literal (there should be few) are tested against all questions."""

    @F.pandas_udf("array<string>")
    def anchors(patterns: pd.Series) -> pd.Series:
        return pd.Series([literals(p) for p in patterns], dtype=object)

    asked = stored(questions.where(F.col(text).isNotNull()).select(q, F.col(text).alias("text"), F.lower(text).alias("low")))
    told = stored(rules.select(rule, "pattern").withColumn("literals", anchors("pattern")))
    spelled = stored(asked.select(q, F.explode(runs(F.col("low"), RUN)).alias("run")))
    counts = spelled.groupBy("run").agg(F.count("*").alias("n"))
    parts = told.select(rule, "pattern", F.explode(F.array_distinct("literals")).alias("literal"))
    each = parts.select(rule, "literal", F.explode(runs(F.col("literal"), RUN)).alias("run")).join(counts, "run", "left")
    rare = each.groupBy(rule, "literal").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("a")).where("a.n > 0")
    rare = stored(rare.select(rule, "literal", F.col("a.run").alias("run")))
    met = word_join(spelled, rare, "run", q).select(q, rule, "literal").join(few(told.select(rule, "pattern")), rule)
    met = met.join(few(asked), q).where(F.contains("low", "literal")).select(q, rule, "text", "pattern").distinct()
    loose = told.where("literals is null").select(rule, "pattern")
    loose = stored(loose)
    free = asked.select(q, "text").join(F.broadcast(loose) if fits(loose) else loose)
    return met.unionByName(free.select(q, rule, "text", "pattern")).where(F.call_function("rlike", F.col("text"), F.col("pattern"))).select(q, rule)


def answers(asked: DataFrame, rules: DataFrame, q: str = "q", text: str = "text", answer: str = "answer", rule: str = "rule") -> DataFrame:
    """asked with the answer after the rules that match its text: the first override by priority, then rule, replaces it; augments
    follow in that order, postscripts come last. rules: rule, pattern, mode, answer, priority."""
    own = rules.select(F.col(rule).alias("rule"), "mode", F.coalesce("priority", F.lit(0)).alias("priority"), F.col("answer").alias("said"))
    met = matches(asked.select(q, text), rules, q, text, rule).withColumnRenamed(rule, "rule").join(few(stored(own)), "rule")
    place = F.struct((-F.col("priority")).alias("p"), "rule")
    listed = lambda mode: F.transform(F.array_sort(F.collect_list(F.when(F.col("mode") == mode, F.struct(place.alias("o"), "said")))), lambda x: x["said"])
    by = met.groupBy(q).agg(F.min(F.when(F.col("mode") == "override", F.struct(place.alias("o"), "said"))).alias("over"), listed("augment").alias("more"), listed("postscript").alias("post"))
    out = asked.join(by, q, "left")
    none = F.array().cast("array<string>")
    said = F.concat_ws("\n\n", F.coalesce("over.said", answer), F.coalesce("more", none), F.coalesce("post", none))
    return out.select(*[c for c in asked.columns if c != answer], said.alias(answer))


def expectations(blocks: DataFrame, rules: DataFrame, ident: str = "id", family: str = "family", answer: str = "answer") -> DataFrame:
    """(id, rule, ok): for rules of a block's family whose id_hint begins its id: whether the answer has all of must_include. rules: rule,
    family, id_hint, must_include. Families meet by an equi-join, hot ones dealt over tasks."""
    wanted = stored(rules.where(F.col("family").isNotNull()).select("rule", F.col("family").alias("_family"), "id_hint", "must_include"))
    rows = blocks.select(F.col(ident).alias("_id"), F.col(family).alias("_family"), F.col(answer).alias("_answer"))
    met = word_join(rows, wanted, "_family", "_id").where(F.startswith("_id", "id_hint"))
    ok = F.forall(F.coalesce("must_include", F.array().cast("array<string>")), lambda s: F.coalesce(F.contains("_answer", s), F.lit(False)))
    return met.select(F.col("_id").alias(ident), "rule", ok.alias("ok"))
