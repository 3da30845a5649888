"""The best products of sparse vectors without all pairs: a threshold first, then only what can still reach it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.joins import few, fits, stored, word_join

#: Documents, times k, that the rare words of a question should bring to its threshold.
LEAD = 20
#: Share of the documents that are scored whole for the thresholds: this, times the root of k by all documents.
SAMPLE = 4.0
#: Words are passed over as long as they, the last ones of a question, come to this share of its threshold together.
CLOSED = 0.5
#: Scores this much under the threshold are kept, so that callers may round to six digits and break ties themselves.
SLACK = 2e-6


def _part():
    return F.col("w") * F.col("x") + F.col("u") * F.col("y")


def _with_ys(terms: DataFrame) -> DataFrame:
    return terms if "ys" in terms.columns else terms.withColumn("ys", F.array_repeat(F.lit(1), F.size("tokens")))


def whole(pairs: DataFrame, asked: DataFrame, terms: DataFrame, q: str, d: str, tiny: bool = False) -> DataFrame:
    """(q, d, score, hits) of pairs: a question's words are looked up in its document's row."""
    terms = _with_ys(terms)
    told = asked.groupBy(q).agg(F.collect_list("token").alias("asked"), F.collect_list(F.struct("w", "u")).alias("parts"))  # a question's words
    met = terms.join(few(pairs), d).join(F.broadcast(told) if tiny else told, q)
    met = met.withColumn("shared", F.array_intersect("tokens", "asked"))
    at = lambda values, places, t: F.get(values, (F.array_position(places, t) - 1).cast("int"))
    hits = F.transform("shared", lambda t: F.struct(at("xs", "tokens", t).alias("x"), at("ys", "tokens", t).alias("y"), at("parts", "asked", t).alias("p")))
    score = F.aggregate("met", F.lit(0.0), lambda a, t: a + t["p"]["w"] * t["x"] + t["p"]["u"] * t["y"])
    return met.select(q, d, hits.alias("met")).select(q, d, score.alias("score"), F.aggregate("met", F.lit(0), lambda a, t: a + t["y"]).alias("hits"))


def candidates(asked: DataFrame, terms: DataFrame, q: str, d: str, k: int, least: float | None = None, bonus: float = 0.0, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(q, d, score, and hits, the words shared whose y is 1) of all pairs that may be among the k best of their question, ties and those within
    SLACK included: a few more than k for each.

    A score is the sum of w * x + u * y over the words that a question and a document share. asked: q, token, w, u >= 0, and
    of the token df, the documents that have it, and top, their largest x. terms: d and, in the same order, the arrays
    tokens, xs >= 0 and ys, 0 or 1 (1 where there is no ys). least: scores below it are not wanted.

    A caller may add to a score what takes a pair's texts: bonus at most. more(pairs) adds to pairs (q, d, n: words
    shared of those seen, unseen: words not looked at) the columns known, what is added for certain, and maybe, what may come to
    that, both at least 0. The scores returned are without either.

    First a threshold for each question: its k-th best among a share of the documents, chosen by hash and scored whole, and among
    what its rare words bring. The share goes down with the root of the documents, so that neither the sample nor what passes
    its threshold is more than the root of all pairs of a question. Then a question's words are put in order, rare ones
    first, and the last ones, the common words with the long lists, are passed over as far as they alone cannot come to
    more than a share of the threshold. Documents meet by the other words; what a pair has from these, and can have from those
    at most, tells whether it is scored whole. Sums meet in a document's task before any exchange."""
    terms = _with_ys(terms)
    n = terms.count()
    share = min(1.0, SAMPLE * (k / max(n, 1)) ** 0.5)
    order = Window.partitionBy(q).orderBy("df", "token")
    most = F.greatest(F.col("w"), F.lit(0.0)) * F.col("top") + F.col("u")
    behind, before = order.rowsBetween(1, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    asked = stored(asked.select(
        q, "token", "w", "u", most.alias("most"), F.coalesce(F.sum(F.greatest(most, F.lit(0.0))).over(behind), F.lit(0.0)).alias("rest"),
        (F.coalesce(F.sum("df").over(before), F.lit(0)) < LEAD * k).alias("lead"),
        F.sum(F.least(F.col("w"), F.lit(0.0)) * F.col("top")).over(Window.partitionBy(q)).alias("low")))
    tiny = fits(asked)
    chosen = F.pmod(F.xxhash64(F.col(d), F.lit(17)), F.lit(1 << 20)) < int(share * (1 << 20))
    rows = terms.select(d, chosen.alias("chosen"), F.inline(F.arrays_zip(F.col("tokens").alias("token"), F.col("xs").alias("x"), F.col("ys").alias("y"))))

    words = asked.select(q, "token", "w", "u", "low", "lead")
    first = word_join(rows.where("chosen"), words, "token", d, tiny=tiny).unionByName(word_join(rows.where("not chosen"), words.where("lead"), "token", d, tiny=tiny))
    first = first.groupBy(q, d).agg((F.sum(_part()) + F.min("low")).alias("reached"), F.sum("y").alias("n"), F.lit(0).alias("unseen"))
    if more is not None:
        first = more(first).select(q, d, (F.col("reached") + F.col("known")).alias("reached"))
    kth = first.withColumn("r", F.row_number().over(Window.partitionBy(q).orderBy(F.desc("reached")))).where(F.col("r") <= k).where(F.col("r") == k)
    floor = F.col("reached") if least is None else F.greatest("reached", F.lit(float(least)))
    bound = stored(kth.select(q, (floor - SLACK).alias("bound")))
    bound = F.broadcast(bound) if tiny else bound  # a row for each question

    open_ = asked.join(bound, q, "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf") if least is None else least - SLACK)))
    most = F.col("most") + F.col("rest")
    opened = (most + bonus >= F.col("bound")) | (most >= CLOSED * F.col("bound"))
    each = Window.partitionBy(q)
    shut = F.sum(F.when(~opened, F.greatest("most", F.lit(0.0))).otherwise(0.0)).over(each)  # what words passed over may add
    open_ = open_.withColumns({"shut": shut, "unseen": F.sum((~opened).cast("int")).over(each)}).where(opened)
    open_ = open_.select(q, "token", "w", "u", "bound", "shut", "unseen")
    met = word_join(rows, open_ if tiny else stored(open_), "token", d, tiny=tiny)
    met = met.groupBy(q, d).agg(F.sum(_part()).alias("part"), F.sum("y").alias("n"), *[F.first(c).alias(c) for c in ("bound", "shut", "unseen")])
    reach = F.col("part") + F.col("shut")
    met = met.where(reach + bonus >= F.col("bound"))
    found = stored((met if more is None else more(met).where(reach + F.col("known") + F.col("maybe") >= F.col("bound"))).select(q, d))
    scored = whole(found, asked, terms, q, d, tiny).join(bound, q, "left")
    return scored.where(F.col("bound").isNull() | (F.col("score") + bonus >= F.col("bound"))).drop("bound")
