"""Rules over questions and answers: enrichment by topic, patterns, expectations, templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexmill.functions.text import normalize_folded, trim_all


def enrich_by_topic(question: Column, answer: Column, topics: dict[str, str], rules: list[dict], prefix: str = "", suffix: str = "", normalize=normalize_folded) -> Column:
    """prefix, answer, additions, suffix, in paragraphs; empty ones are left out. Additions stand on lines of their own.

    A topic adds its text if its normalised name is one of the question's words. A rule adds its text if any of its
    if_any are (or it has none) and all of its if_all are. Terms of several words are never one word."""
    asked = F.split(normalize(question), " ")
    has = lambda t: F.array_contains(asked, normalize(F.lit(t)))
    texts = [F.when(has(k), F.lit(v.strip())) for k, v in topics.items() if v.strip()]
    for r in rules:
        some, every = r.get("if_any") or (), r.get("if_all") or ()
        fires = reduce(lambda a, t: a | has(t), some, F.lit(not some)) & reduce(lambda a, t: a & has(t), every, F.lit(True))
        if (r.get("add") or "").strip():
            texts.append(F.when(fires, F.lit(r["add"].strip())))
    none = F.lit(None).cast("string")
    added = F.nullif(F.concat_ws("\n", *texts), F.lit("")) if texts else none
    said = lambda t: F.lit(t.strip()) if t.strip() else none
    return F.concat_ws("\n\n", said(prefix), F.nullif(trim_all(F.coalesce(answer, F.lit(""))), F.lit("")), added, said(suffix))


def usable(spark: SparkSession, rules: list[dict]) -> tuple[list[dict], list[dict]]:
    """Rules whose pattern compiles, and those whose does not."""
    good: list[dict] = []
    bad: list[dict] = []
    for r in rules:
        try:
            spark._jvm.java.util.regex.Pattern.compile(r["pattern"])
            good.append(r)
        except Exception:  # what the JVM throws for a pattern, through the gateway
            bad.append(r)
    return good, bad


def answer_by_pattern(question: Column, answer: Column, rules: list[dict]) -> Column:
    """The answer after pattern rules: the first override that matches (by priority, then order) replaces it, augments
    follow in order, postscripts come last. rules: pattern, mode, answer, priority."""
    ranked = sorted(rules, key=lambda r: -r.get("priority", 0))
    hits = lambda mode: [F.when(question.rlike(r["pattern"]), F.lit(r["answer"])) for r in ranked if r["mode"] == mode]
    return F.concat_ws("\n\n", F.coalesce(*hits("override"), answer), *hits("augment"), *hits("postscript"))


def expectations(family: Column, ident: Column, answer: Column, rules: list[dict]) -> Column:
    """Array of (rule, ok) for the rules of a row's family whose id_hint begins its id: ok if the answer has all strings."""
    found = []
    for i, r in enumerate(rules):
        holds = reduce(lambda a, s: a & F.contains(answer, F.lit(s)), r["must_include"], F.lit(True))
        applies = (family == r["family"]) & F.startswith(ident, F.lit(r["id_hint"]))
        found.append(F.when(applies, F.struct(F.lit(i).alias("rule"), F.coalesce(holds, F.lit(False)).alias("ok"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def render(template: str, **fields: Column) -> Column:
    """The template with each {name} replaced by its field; null is empty. Marks inside fields are not replaced again."""
    marks = sorted(((template.find(f"{{{k}}}"), k) for k in fields if f"{{{k}}}" in template))
    parts, rest = [], template
    for _, k in marks:
        before, rest = rest.split(f"{{{k}}}", 1)
        parts += [F.lit(before), F.coalesce(fields[k].cast(StringType()), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def context(fields: list[tuple[str, Column]]) -> Column:
    """label: value of the fields that are filled, joined by commas."""
    return F.concat_ws(", ", *[F.when(v.isNotNull() & (v.cast("string") != ""), F.concat(F.lit(f"{label}: "), v.cast("string"))) for label, v in fields])
