"""Names that stand in questions, or hold them: substring joins by rare runs of characters instead of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.joins import few, stored, word_join

#: Length of the runs by which texts are found; shorter texts are found whole.
RUN = 4


def runs(c: Column, n: int = RUN) -> Column:
    """The distinct runs of n characters of a text; none where it is shorter."""
    at = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(c, i, F.lit(n))))


def _all_runs(c: Column) -> Column:
    return F.concat(*[runs(c, n) for n in range(1, RUN + 1)])


def _anchored(texts: DataFrame, key: str, text: str, rows_of: DataFrame) -> DataFrame:
    """(key, text, run): each text by its rarest run, as counted in rows_of (run, n); texts shorter than a run by
    themselves. A run that nobody has cannot meet: such texts are left out where counts say so."""
    short = texts.where((F.length(text) < RUN) & (F.col(text) != "")).select(key, text, F.col(text).alias("run"))
    long = texts.where(F.length(text) >= RUN).select(key, text, F.explode(runs(F.col(text))).alias("run"))
    long = long.join(rows_of, "run", "left").groupBy(key, text).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("a"))
    return short.unionByName(long.where("a.n > 0").select(key, text, F.col("a.run").alias("run")))


def met_texts(questions: DataFrame, texts: DataFrame, q: str, text: str) -> DataFrame:
    """(q, text): texts that are a substring of a question or the other way round; neither is empty.

    questions: q, qn; texts: text, each once. Of what has to be contained the rarest run of four characters is looked up
    among the runs of the other side: an equi-join, of which only the test is left to do. Runs of many rows are dealt over
    tasks."""
    own = texts.select(F.col(text).alias("t")).where("t <> ''")
    mine = stored(own.select("t", F.explode(_all_runs(F.col("t"))).alias("run")))  # all runs of all texts
    counts = mine.groupBy("run").agg(F.count("*").alias("n"))
    asked = questions.select(q, "qn").where("qn <> ''")
    # the text in the question: texts by their rarest run, questions by all of theirs
    inner = _anchored(own.withColumn("k", F.col("t")), "k", "t", counts).select("t", "run")
    spelled = stored(asked.select(q, "qn", F.explode(_all_runs(F.col("qn"))).alias("run")))
    inside = word_join(inner, spelled, "run", "t").where(F.contains("qn", "t"))
    # the question in the text: questions by the run that fewest texts have, texts by all of theirs
    outer = stored(_anchored(asked, q, "qn", counts))
    around = word_join(mine, outer, "run", "t").where(F.contains("t", "qn"))
    return inside.select(q, "t").unionByName(around.select(q, "t")).distinct().withColumnRenamed("t", text)


def first_by_name(questions: DataFrame, docs: DataFrame, q: str, d: str, boost) -> DataFrame:
    """(q, d, score): of each question the first of the documents whose name and tags boost it most, by 0 if none does.

    questions: q, qn; docs: d, name, tags; boost(qn, name, tags) is worth most where a name meets, less where a tag
    alone does. Documents whose name meets are scored; a tag alone brings the first document that has it; else the first of
    all is taken. An empty question is in every name and tag, and documents of one kind are alike to it."""
    kinds = stored(docs.groupBy("name", "tags").agg(F.min(d).alias(d)))
    asked = questions.select(q, "qn")
    named = met_texts(asked, kinds.select("name").distinct(), q, "name")
    named = named.join(few(asked), q).join(kinds, "name").select(q, d, boost(F.col("qn"), F.col("name"), F.col("tags")).alias("score"))
    first = kinds.select(d, F.explode("tags").alias("tag")).where("tag <> ''").groupBy("tag").agg(F.min(d).alias(d))
    tagged = met_texts(asked, first.select("tag"), q, "tag").join(first, "tag").join(few(asked), q)
    tagged = tagged.select(q, d, boost(F.col("qn"), F.lit(""), F.array("tag")).alias("score"))
    blank = kinds.select(d, boost(F.lit(""), F.col("name"), F.col("tags")).alias("score")).agg(F.min(F.struct((-F.col("score")).alias("s"), d)).alias("t"))
    alone = kinds.agg(F.min(d).alias(d)).where(F.col(d).isNotNull()).select(F.lit(0).alias("one"), d, F.lit(0.0).alias("score"))
    whole = blank.where("t is not null").select(F.lit(1).alias("one"), F.col(f"t.{d}").alias(d), (-F.col("t.s")).alias("score"))
    ends = asked.withColumn("one", (F.col("qn") == "").cast("int")).join(F.broadcast(alone.unionByName(whole)), "one").select(q, d, "score")  # two rows
    every = named.unionByName(tagged).unionByName(ends)
    best = every.groupBy(q).agg(F.min(F.struct((-F.col("score")).alias("s"), d)).alias("t"))
    return best.select(q, F.col(f"t.{d}").alias(d), (-F.col("t.s")).alias("score"))
