"""Languages of texts by the order of their commonest runs of letters, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import counted
from lexmill.operators.joins import few, spread_out, stored, word_join

#: Runs of a profile, and letters of a run at most.
TOP, LONGEST = 300, 3


def letters(c: Column) -> Column:
    """The lower-cased words of letters."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")


def word_runs(word: Column) -> Column:
    """All runs of one to LONGEST letters of a word with a mark before and behind it, repeated ones too; not the mark alone."""
    w = F.concat(F.lit("_"), word, F.lit("_"))
    at = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))
    return F.filter(F.concat(*[at(n) for n in range(1, LONGEST + 1)]), lambda g: g != "_")


def ranks(texts: DataFrame, key: str, text: str, top: int = TOP) -> DataFrame:
    """(key, gram, rank): the commonest runs of each key's texts, from 0, ties by the run.

    Words are counted first, so the work on runs goes by distinct words, whatever the texts' lengths."""
    words = spread_out(texts, key) if key in texts.columns else texts
    words = words.select(key, F.explode(letters(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))
    grams = words.select(key, "n", F.explode(word_runs(F.col("word"))).alias("gram")).groupBy(key, "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "gram")
    return grams.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < top).select(key, "gram", "rank")


def profiles(texts: DataFrame, lang: str, text: str, top: int = TOP) -> DataFrame:
    """(lang, gram, rank) of each language's texts, written once; rows without language or text count for nothing."""
    return stored(ranks(texts.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), text), "lang", text, top))


def text_runs(text: Column) -> Column:
    """All runs of a text's words, repeated ones too."""
    return F.flatten(F.transform(letters(text), word_runs))


def own_ranks(texts: DataFrame, key: str, text: str, top: int = TOP) -> DataFrame:
    """(key, grams): ranks() within the row, for texts whose keys differ: the commonest runs in order, and no exchange."""
    grams = texts.select(key, counted(text_runs(F.col(text))).alias("g"))
    order = F.slice(F.sort_array(F.transform("g", lambda x: F.struct((-x["f"]).alias("n"), x["token"].alias("gram")))), 1, top)
    return grams.select(key, order["gram"].alias("grams"))


def detect(texts: DataFrame, known: DataFrame, key: str, text: str, top: int = TOP) -> DataFrame:
    """(key, lang, distance): of each text the language whose profile its own runs are least out of place in, ties by name.

    A run that a profile lacks is as far off as the profile is long. Texts without any run of any profile are absent. key
    names a text: rows of one key count as one text. Only the texts themselves meet by key; runs are counted and ranked in a
    row, and sums by language meet in its task before any exchange."""
    whole = texts.groupBy(key).agg(F.concat_ws(" ", F.collect_list(text)).alias("_t"))
    own = own_ranks(whole, key, "_t", top)
    met = own.select(key, F.size("grams").alias("runs"), F.posexplode("grams").alias("rank", "gram"))
    off = F.abs(F.col("rank") - F.col("place")) - top
    met = word_join(met, known.select("lang", "gram", F.col("rank").alias("place")), "gram", key).groupBy(key, "lang").agg(F.sum(off).alias("off"), F.first("runs").alias("runs"))
    far = met.select(key, "lang", (F.col("off") + F.col("runs") * top).cast("long").alias("distance"))
    best = far.groupBy(key).agg(F.min(F.struct("distance", "lang")).alias("t"))
    return best.select(key, F.col("t.lang").alias("lang"), F.col("t.distance").alias("distance"))


def with_language(df: DataFrame, text: str, known: DataFrame, out: str = "lang", default: str | None = None) -> DataFrame:
    """df with the language of each row's text; default where none is found. Equal texts are judged once."""
    asked = df.select(F.sha2(text, 256).alias("_key"), F.col(text).alias("_text")).where("_key is not null").groupBy("_key").agg(F.first("_text").alias("_text"))
    found = stored(detect(asked, known, "_key", "_text").select("_key", F.col("lang").alias("_lang")))
    rows = df.withColumn("_key", F.sha2(text, 256))
    return rows.join(few(found), "_key", "left").withColumn(out, F.coalesce("_lang", F.lit(default))).drop("_key", "_lang")
