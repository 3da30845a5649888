"""Product lookup by name, product notes, and answers enriched by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import compact, normalize, tokens
from lexmill.operators.joins import word_join


def lookup(questions: DataFrame, products: DataFrame, q: str, text: str, key: str, name: str, codes: tuple[str, ...], prefixes: tuple[str, ...]) -> DataFrame:
    """(q, key, score): the product of each question; questions without any are absent.

    A product whose compact name is the compact question goes before all others. Else the score is the number of
    shared words, + 0.5 if the question has a family code and a number, + 0.25 if it has a code and the name begins
    with a family's prefix; ties go to the least key. Candidates come from equi-joins on words and on compact names;
    products of one name are one candidate. A question without any shared word scores by its codes alone: it gets the
    first product of a family if it has a code, and else, with a code and a number, the first of all."""
    asked = questions.select(q, compact(F.col(text)).alias("same"), F.array_distinct(tokens(normalize(F.col(text)))).alias("toks"))
    coded = F.arrays_overlap("toks", F.array(*map(F.lit, codes)))
    number = F.exists("toks", lambda t: t.rlike(r"^\p{Nd}+$"))
    asked = asked.withColumns({"coded": coded, "number": coded & number})
    names = products.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(key).alias(key))
    family = F.lit(False)
    for p in prefixes:
        family = family | F.startswith(F.lower(name), F.lit(p))
    names = names.select(key, compact(F.col(name)).alias("same"), F.array_distinct(tokens(normalize(F.col(name)))).alias("words"), family.alias("family"))
    by_word = word_join(names.select(key, "family", F.explode("words").alias("w")), asked.select(q, "coded", "number", F.explode("toks").alias("w")), "w", key)
    scored = by_word.groupBy(q, key).agg(F.count("*").alias("hits"), F.first("coded").alias("coded"), F.first("number").alias("number"), F.first("family").alias("family"))
    points = F.col("hits") + F.when(F.col("number"), 0.5).otherwise(0.0) + F.when(F.col("coded") & F.col("family"), 0.25).otherwise(0.0)
    exact = asked.where("same <> ''").join(names, "same").groupBy(q).agg(F.min(key).alias(key))
    both = scored.select(q, key, points.alias("score"), F.lit(0).alias("exact")).unionByName(exact.select(q, key, F.lit(None).cast("double").alias("score"), F.lit(1).alias("exact")))
    # what a question scores without a shared word goes to the first product, or to the first of a family
    firsts = names.agg(F.min(key).alias("first"), F.min(F.when(F.col("family"), F.col(key))).alias("kin"))
    alone = asked.where("coded").select(q, F.when(F.col("number"), 0.5).otherwise(0.0).alias("base")).join(firsts)
    alone = alone.select(q, F.coalesce("kin", "first").alias(key), (F.col("base") + F.when(F.col("kin").isNotNull(), 0.25).otherwise(0.0)).alias("score"))
    both = both.unionByName(alone.where("score > 0").select(q, key, "score", F.lit(0).alias("exact")))
    top = both.groupBy(q).agg(F.max(F.struct("exact", "score", (-F.col(key)).alias("p"))).alias("t"))
    return top.select(q, (-F.col("t.p")).alias(key), (F.col("t.exact") == 1).alias("exact"), F.col("t.score").alias("score"))


def note(title: Column, numbers: list[tuple[str, Column]], texts: list[tuple[str, Column]], extra: list[tuple[Column, str]]) -> Column:
    """Lines of a note: title, numbers that are not null (zero counts), texts that are not empty, lines whose condition holds."""
    lines = [F.when(v.isNotNull(), F.format_string(form, v)) for form, v in numbers]
    lines += [F.when(v != "", F.format_string(form, v)) for form, v in texts]
    lines += [F.when(c, F.lit(line)) for c, line in extra]
    return F.concat_ws("\n", title, *lines)


def enrich(answers: DataFrame, notes: DataFrame, key: str, answer: str, note_col: str) -> DataFrame:
    """answers with the note of their product behind the text; answers without a product stay as they are."""
    joined = answers.join(notes.select(key, F.col(note_col).alias("_note")), key, "left")
    return joined.withColumn(answer, F.concat_ws("\n\n", answer, "_note")).drop("_note")
