"""Calls of an outside text engine as a batch step; without one, fixed fallbacks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.joins import stored, word_join
from lexmill.operators.language import with_language
from lexmill.plans.rules import render

UNAVAILABLE = "The text engine is not available."


def offline(prompts: list[str]) -> list[str | None]:
    """The provider where there is none: no answers."""
    return [None] * len(prompts)


def _called(call: Callable[[list[str]], list[str | None]], prompts: list[str], tries: int, pause: float) -> tuple[list[str | None], str | None]:
    """The replies to some prompts, and what the last try raised if all failed. Pauses between tries double."""
    for k in range(tries):
        try:
            return list(call(prompts)), None
        except Exception as e:  # whatever an engine's client raises
            error = f"{type(e).__name__}: {e}"
            if k + 1 < tries:
                time.sleep(pause * 2**k)
    return [None] * len(prompts), error


def replies_to(prompts: DataFrame, prompt: str, call: Callable[[list[str]], list[str | None]], kept: str | None = None, size: int = 64, parallel: int = 4, tries: int = 3, pause: float = 0.2) -> DataFrame:
    """(key, reply, error): one row for each distinct prompt, key being its digest; null is asked as an empty prompt.

    A prompt is asked once, size prompts a call, at most parallel calls at a time in each task; a failed call is repeated, with growing
    pauses. kept: path of a Parquet table of replies: what is in it is not asked again, and new replies are added to
    it, failures not. The calls are made once, when the table is written, whatever is read from it later."""
    spark = prompts.sparkSession
    asked = prompts.select(F.coalesce(prompt, F.lit("")).alias("prompt")).groupBy(F.sha2("prompt", 256).alias("key")).agg(F.first("prompt").alias("prompt"))
    known = None
    if kept is not None:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(kept)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            known = spark.read.schema("key string, reply string").parquet(kept)
            asked = asked.join(known, "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(parallel) as pool:
            for pdf in batches:
                parts = [pdf.iloc[at : at + size] for at in range(0, len(pdf), size)]
                said = pool.map(lambda part: _called(call, part["prompt"].tolist(), tries, pause), parts)
                for part, (replies, error) in zip(parts, said, strict=True):
                    yield pd.DataFrame({"key": part["key"], "reply": replies, "error": error})

    made = stored(asked.mapInPandas(run, "key string, reply string, error string"))
    if kept is None:
        return made
    out = made if known is None else made.unionByName(stored(known.join(prompts.select(F.sha2(F.coalesce(prompt, F.lit("")), 256).alias("key")).distinct(), "key", "left_semi").withColumn("error", F.lit(None).cast("string"))))
    made.where("error is null").select("key", "reply").write.mode("append").parquet(kept)
    return out


def ask(df: DataFrame, prompt: str, out: str = "reply", call: Callable[[list[str]], list[str | None]] = offline, fallback: str | None = UNAVAILABLE, **how) -> DataFrame:
    """df with the reply to each prompt, and out_error with what a failed call raised; see replies_to() for how.

    fallback where call has no reply or fails. Without a provider the reply is a literal, and no Python runs."""
    if call is offline:
        return df.withColumns({out: F.lit(fallback).cast("string"), f"{out}_error": F.lit(None).cast("string")})
    said = replies_to(df, prompt, call, **how).select("key", F.col("reply").alias(out), F.col("error").alias(f"{out}_error"))
    rows = df.withColumns({"key": F.sha2(F.coalesce(prompt, F.lit("")), 256), "_row": F.monotonically_increasing_id()})
    return word_join(rows, said, "key", "_row").drop("key", "_row").withColumn(out, F.coalesce(out, F.lit(fallback)))


def two_pass(df: DataFrame, question: str, analyse: str, answer: str, call=offline, fallback: str | None = UNAVAILABLE) -> DataFrame:
    """Adds analysis, solution and reply: a first call describes the case, a second answers with that as context.

    analyse and answer are templates with {question} and, in the second, {analysis}."""
    first = ask(df.withColumn("_p", render(analyse, question=F.col(question))), "_p", "analysis", call, fallback)
    second = first.withColumn("_p", render(answer, question=F.col(question), analysis=F.col("analysis")))
    second = ask(second, "_p", "solution", call, fallback)
    return second.withColumn("reply", F.concat_ws("\n\n", "analysis", F.lit("─" * 40), "solution")).drop("_p")


def translated(df: DataFrame, question: str, context: str, template: str, language: Column | DataFrame, translate=offline, call=offline, pivot: str = "en", failed: str = UNAVAILABLE) -> DataFrame:
    """Adds reply: the question in the pivot language, asked with the context, and the answer in the question's language.

    language: the question's, or profiles of languages (see operators.language) by which it is found; without one it counts
    as the pivot. translate takes texts with the languages from and to in front, as "from>to:text". Whatever has no translation or
    answer gets the failed text."""
    known = with_language(df, question, language, "_l", pivot) if isinstance(language, DataFrame) else df.withColumn("_l", language)
    to_pivot = ask(known.withColumn("_p", F.concat("_l", F.lit(f">{pivot}:"), F.col(question))), "_p", "_q", translate, None)
    to_pivot = to_pivot.withColumn("_q", F.when(F.col("_l") == pivot, F.col(question)).otherwise(F.col("_q")))
    asked = ask(to_pivot.withColumn("_p", render(template, question=F.col("_q"), context=F.col(context))), "_p", "_a", call, None)
    back = ask(asked.withColumn("_p", F.concat(F.lit(f"{pivot}>"), "_l", F.lit(":"), F.col("_a"))), "_p", "_b", translate, None)
    reply = F.when(F.col("_l") == pivot, F.col("_a")).otherwise(F.col("_b"))
    ok = F.col(question).isNotNull() & F.col("_q").isNotNull() & F.col("_a").isNotNull()
    out = back.withColumn("reply", F.coalesce(F.when(ok, reply), F.lit(failed)))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def local_then_engine(df: DataFrame, local: str, question: str, call=offline, fallback: str = UNAVAILABLE) -> DataFrame:
    """Adds reply: the local answer where there is one, else the engine's; only those without one are asked."""
    has = F.coalesce(F.trim(F.col(local)) != "", F.lit(False))
    found = df.where(has).withColumns({"reply": F.col(local), "reply_error": F.lit(None).cast("string")})
    return found.unionByName(ask(df.where(~has), question, "reply", call, fallback))


def choose(candidates: DataFrame, by: str, ident: str, rank: str, question: str, own: str, template: str, call=offline) -> DataFrame:
    """pick() by what the engine names: it is shown the question and a line for each candidate, in order."""
    line = F.concat(F.lit("- ID:"), F.col(ident).cast("string"), F.lit(" | Q:"), F.coalesce(own, F.lit("")))
    shown = candidates.groupBy(by).agg(F.first(question).alias("_q"), F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), line.alias("l")))).alias("_c"))
    shown = shown.withColumn("_p", render(template, question=F.col("_q"), candidates=F.array_join(F.col("_c.l"), "\n")))
    named = ask(shown.select(by, "_p"), "_p", "_chosen", call, None).select(by, F.trim("_chosen").alias("_chosen"))
    return pick(candidates.join(named, by, "left"), by, ident, rank, "_chosen")


def pick(candidates: DataFrame, by: str, ident: str, rank: str, chosen: str) -> DataFrame:
    """The candidate of each question that the engine named in chosen, else that of least rank. One partial aggregate."""
    rest = [c for c in candidates.columns if c not in (by, ident, rank, chosen)]
    named = F.coalesce(F.col(chosen) == F.col(ident).cast("string"), F.lit(False))
    first = F.min_by(F.struct(ident, rank, *rest), F.struct((~named).alias("n"), rank, ident))  # columns need no order
    return candidates.groupBy(by).agg(first.alias("t")).select(by, *[F.col(f"t.{c}").alias(c) for c in (ident, rank, *rest)])
