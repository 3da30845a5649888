"""Scores of questions against candidates, as token joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.text import counted
from lexmill.operators import dense, names, topk
from lexmill.operators.joins import few, fits, spread_out, stored, word_join


def postings(df: DataFrame, key: str, toks: Column) -> DataFrame:
    """(key, token) for each distinct token."""
    # explode_outer: explode would have the tokens computed once more in a filter below it
    return df.select(key, F.explode_outer(F.array_distinct(toks)).alias("token")).where("token is not null")


def overlap(questions: DataFrame, docs: DataFrame, q: str, d: str) -> DataFrame:
    """(q, d, score): share of the question's distinct tokens that the document has. Pairs without any are absent.

    questions and docs: key and an array column toks. An equi-join on tokens instead of all pairs; the questions'
    tokens go to all tasks if they are counted as few, and a document's hits meet before any exchange."""
    qs = questions.select(q, F.array_distinct("toks").alias("toks")).select(q, F.size("toks").alias("nq"), F.explode_outer("toks").alias("token")).where("token is not null")
    hits = word_join(postings(docs, d, F.col("toks")), qs, "token", d).groupBy(q, d).agg(F.count("*").alias("n"), F.first("nq").alias("nq"))
    return hits.select(q, d, (F.col("n") / F.col("nq")).alias("score"))


def _parts(questions: DataFrame, docs: DataFrame, q: str, d: str, k1: float, b: float, epsilon: float) -> DataFrame:
    """(q, d, part): what each shared token adds to a pair's BM25; one row for a distinct token of a pair.

    Frequencies within a document are found in its row. One pass counts documents by token and, under a null token, all
    documents and their lengths; a second meets the questions' tokens, which go to all tasks if they are few."""
    terms = docs.select(d, F.size("toks").alias("dl"), counted(F.col("toks")).alias("terms"))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("token"), F.col("dl").alias("f")))
    sums = terms.select(F.explode_outer(F.concat("terms", whole)).alias("t")).groupBy("t.token").agg(F.count("*").alias("df"), F.sum("t.f").alias("total"))
    stats = sums.where("token is null").select(F.col("df").alias("n"), (F.col("total") / F.col("df")).alias("avgdl"))
    raw = sums.where("token is not null").join(F.broadcast(stats)).select("token", "avgdl", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    wanted = few(questions.select(q, F.explode("toks").alias("token")).groupBy(q, "token").agg(F.count("*").alias("qf")))
    idf = raw.join(wanted.select("token").distinct(), "token", "left_semi").join(F.broadcast(mean))
    idf = idf.select("token", "avgdl", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    asked = wanted.join(idf, "token")
    tf = terms.select(d, "dl", F.explode_outer("terms").alias("t")).select(d, "dl", "t.token", "t.f").where("token is not null")
    part = F.col("qf") * F.col("idf") * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return word_join(tf, asked, "token", d).select(q, d, part.alias("part"))


def bm25(questions: DataFrame, docs: DataFrame, q: str, d: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(q, d, score): Okapi BM25 of all pairs that share a token; a negative idf becomes epsilon times the mean idf; repeated
    query tokens count. For the best documents alone bm25_best() is the way.

    docs should be cheap to read again: corpus statistics and scores are separate passes."""
    return _parts(questions, docs, q, d, k1, b, epsilon).groupBy(q, d).agg(F.sum("part").alias("score"))


class Bm25:
    """Documents' terms with their saturated frequencies, written once, and the weights of questions' tokens.

    terms: d and the arrays tokens and xs, x being what a token of weight 1 adds to the document's score. Corpus
    statistics are two aggregates over it: lengths, and documents and the largest x by token. keep: columns of docs that stay."""

    def __init__(self, docs: DataFrame, d: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, keep: tuple[str, ...] = ()):
        self.epsilon = epsilon
        counts = spread_out(docs, d).select(d, *keep, F.size("toks").alias("dl"), counted(F.col("toks")).alias("terms"))
        counts = stored(counts.select(d, *keep, "dl", F.col("terms.token").alias("tokens"), F.col("terms.f").alias("fs")))
        n, mean = counts.agg(F.count("*"), F.avg("dl")).first()
        long = k1 * (1 - b + b * F.col("dl") / F.lit(float(mean or 1.0)))
        self.terms = counts.select(d, *keep, "tokens", F.transform("fs", lambda f: f * (k1 + 1) / (f + long)).alias("xs"))
        each = self.terms.select(F.inline(F.arrays_zip(F.col("tokens").alias("token"), F.col("xs").alias("x"))))
        by = each.groupBy("token").agg(F.count("*").alias("df"), F.max("x").alias("top"))
        self.stats = stored(by.select("token", "df", "top", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")))
        self.mean = self.stats.agg(F.avg("raw")).first()[0] or 0.0

    def asked(self, questions: DataFrame, q: str) -> DataFrame:
        """(q, token, w, qf, df, top): questions' tokens that any document has; w is their number times the idf."""
        wanted = questions.select(q, F.explode("toks").alias("token")).groupBy(q, "token").agg(F.count("*").alias("qf"))
        wanted = stored(wanted)
        idf = F.when(F.col("raw") < 0, self.epsilon * self.mean).otherwise(F.col("raw"))
        return self.stats.join(few(wanted), "token").select(q, "token", (F.col("qf") * idf).alias("w"), "qf", "df", "top")


def bm25_best(questions: DataFrame, docs: DataFrame, q: str, d: str, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(q, d, score): bm25() of the pairs that may be among the k best of their question, ties included; see topk."""
    model = Bm25(docs, d, k1, b, epsilon)
    return _sums_best(stored(model.asked(questions, q)), model.terms, q, d, k)


def _sums_best(asked: DataFrame, terms: DataFrame, q: str, d: str, k: int) -> DataFrame:
    """(q, d, score) of the pairs that may be among the k best: in one pass over the documents where the questions fit as a
    broadcast side does, else by pruned joins."""
    rows = dense.held(asked.groupBy(q).agg(F.collect_list(F.struct("token", "w")).alias("parts")), terms.schema[d].dataType)
    if rows is None:
        return topk.candidates(asked.withColumn("u", F.lit(0.0)), terms, q, d, k).select(q, d, "score")
    return dense.keyed(dense.sums(rows, terms, d, k), rows, asked.schema[q].dataType, q).select(q, d, "score")


def overlap_best(questions: DataFrame, docs: DataFrame, q: str, d: str, k: int, least: float | None = None) -> DataFrame:
    """(q, d, score): overlap() of the pairs that may be among the k best of their question, ties included; see topk.

    least: scores below it are not wanted. Where the questions fit as a broadcast side does, a task holds them and gives out what may
    be among the k best by score and place (docs' column place, else d): one pass over the documents, no pairs exchanged."""
    place = "place" if "place" in docs.columns else d
    rows = dense.held(questions.select(q, F.array_distinct("toks").alias("toks")), docs.schema[d].dataType, docs.schema[place].dataType)
    if rows is not None:
        told = spread_out(docs, d).select(d, F.col(place).alias("place"), F.array_distinct("toks").alias("tokens"))
        told = stored(told) if len(rows) > dense.asked_at_once(k) else told
        out = dense.keyed(dense.shares(rows, told, d, k, least), rows, questions.schema[q].dataType, q).select(q, d, "score")
        return out if least is None else out.where(F.col("score") >= least)
    terms = stored(spread_out(docs, d).select(d, F.array_distinct("toks").alias("tokens")))
    qs = stored(questions.select(q, F.array_distinct("toks").alias("toks")).select(q, F.size("toks").alias("nq"), F.explode("toks").alias("token")))
    df = terms.select(F.explode("tokens").alias("token")).join(few(qs.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    asked = qs.join(few(stored(df)), "token").select(q, "token", F.lit(0.0).alias("w"), (1 / F.col("nq")).alias("u"), "df", F.lit(1.0).alias("top"), "nq")
    ones = terms.withColumn("xs", F.array_repeat(F.lit(1.0), F.size("tokens")))
    found = topk.candidates(asked, ones, q, d, k, least=least)
    nq = few(qs.select(q, "nq").distinct())
    out = found.join(nq, q).select(q, d, (F.col("hits") / F.col("nq")).alias("score"))
    return out if least is None else out.where(F.col("score") >= least)


def fuzzy_plain(a: Column, b: Column) -> Column:
    """1 for equal texts, 0.5 if one contains the other, else 0; 0 for empty ones."""
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.5).otherwise(0.0)


def boost(question: Column, name: Column, tags: Column) -> Column:
    """0.12 if name and question contain one another, 0.08 once if a tag and the question do; 0.25 at most. Empty names
    and tags give nothing, an empty question is in all others."""
    meet = lambda t: (t != "") & (F.contains(question, t) | F.contains(t, question))
    named = F.when(meet(name), 0.12).otherwise(0.0)
    tagged = F.when(F.exists(tags, meet), 0.08).otherwise(0.0)
    return F.least(F.lit(0.25), named + tagged)


def boosts(questions: list[str], name: str | None, tags: tuple[str | None, ...]) -> list[float]:
    """boost() of some questions within a task."""
    meet = lambda q, t: bool(t) and (t in q or q in t)
    return [min(0.25, (0.12 if meet(q, name) else 0.0) + (0.08 if any(meet(q, t) for t in tags) else 0.0)) for q in questions]


def hybrid(questions: DataFrame, docs: DataFrame, q: str, d: str) -> DataFrame:
    """(q, d, score): 0.6 BM25 over the question's best + 0.25 overlap + 0.15 fuzzy + boost, within 0 and 1.

    questions: key, norm, toks; docs: key, norm, toks, name, tags. Only pairs that share a token are scored: any other
    gets 0.275 at most, which is under the threshold of 0.3. BM25 and overlap come from one join on tokens; of its
    pairs alone the texts are compared."""
    parts = _parts(questions, docs, q, d, 1.5, 0.75, 0.25).groupBy(q, d).agg(F.sum("part").alias("bm"), F.count("*").alias("hits"))
    most = parts.groupBy(q).agg(F.max("bm").alias("most"))
    asked = questions.select(q, F.col("norm").alias("qn"), F.size(F.array_distinct("toks")).alias("nq"))
    pairs = parts.join(most, q).join(asked, q).join(docs.select(d, "norm", "name", "tags"), d)
    bm = F.when(F.col("most") > 0, F.col("bm") / F.col("most")).otherwise(F.col("bm"))
    total = 0.6 * bm + 0.25 * F.col("hits") / F.col("nq") + 0.15 * fuzzy_plain(F.col("qn"), F.col("norm")) + boost(F.col("qn"), F.col("name"), F.col("tags"))
    return pairs.select(q, d, F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)).alias("score"))


#: What fuzzy likeness and boost add at most.
BONUS = 0.15 + 0.20


def hybrid_best(questions: DataFrame, docs: DataFrame, q: str, d: str, k: int = 1, full: bool = False) -> DataFrame:
    """(q, d, score): hybrid() of the pairs that may be among the k best of their question, ties included. docs may have words, the
    tokens that overlap counts, where these are fewer than toks.

    The question's best BM25 comes first; with it, BM25 and overlap are one sum over shared words, and topk gives the pairs
    that can still be among the best when likeness and boost are added. Only these pairs have their texts fetched. full: likeness is
    the token-set ratio (of the pairs that can reach the best with it) instead of its plain form; where the questions fit as a
    broadcast side does, that is one pass over the documents, after one over those of best BM25, whose scores are its thresholds."""
    own = ("words",) if "words" in docs.columns else ()
    model = Bm25(docs, d, keep=("norm", "name", "tags", *own))
    if own:
        model.terms = stored(model.terms.withColumn("ys", F.transform("tokens", lambda t: F.array_contains("words", t).cast("int"))).drop("words"))
    ys = [c for c in model.terms.columns if c == "ys"]
    asked = stored(model.asked(questions, q))
    flat = asked.withColumn("u", F.lit(0.0))
    near = _sums_best(asked, model.terms.select(d, "tokens", "xs"), q, d, k if full else 1)
    near = stored(near, dense.SLICE) if full else near
    most = near.groupBy(q).agg(F.max("score").alias("most"))
    told = stored(questions.select(q, F.col("norm").alias("qn"), F.size(F.array_distinct("toks")).alias("nq")).join(most, q))
    if full:
        rows = dense.held(asked.groupBy(q).agg(F.collect_list(F.struct("token", "w")).alias("parts")).join(told, q), model.terms.schema[d].dataType)
        if rows is not None:
            return _likeliest(rows, model.terms, near.select(d).distinct(), q, d, k, asked.schema[q].dataType)
    weight = 0.6 * F.when(F.col("most") > 0, F.col("w") / F.col("most")).otherwise(F.col("w"))
    both = asked.join(few(told.select(q, "most", "nq")), q).select(q, "token", weight.alias("w"), (0.25 / F.col("nq")).alias("u"), "df", "top")
    own = model.terms.select(F.struct(F.col(d).alias("id"), "name", "tags", F.size(F.filter(F.split("norm", " "), lambda t: t != "")).alias("nd")).alias("_d"), "tokens", "xs", *ys)
    asking = few(told.select(q, "qn", "nq"))

    def more(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(asking, q)
        # a text within another shares all its words but the first and the last
        near = F.lit(True) if full else F.col("n") + F.col("unseen") >= F.least(F.col("nq"), F.col("_d.nd")) - 2
        return pairs.withColumns({"known": boost(F.col("qn"), F.col("_d.name"), F.col("_d.tags")), "maybe": F.when(near, 0.15).otherwise(0.0)})

    found = stored(topk.candidates(both, own, q, "_d", k, bonus=BONUS, more=more).select(q, F.col("_d.id").alias(d)))
    found = stored(topk.whole(found, flat, model.terms.select(d, "tokens", "xs", *ys), q, d))
    texts = model.terms.join(few(found.select(d).distinct()), d, "left_semi").select(d, "norm", "name", "tags")
    pairs = found.join(few(told), q).join(texts, d)
    bm = F.when(F.col("most") > 0, F.col("score") / F.col("most")).otherwise(F.col("score"))
    base = 0.6 * bm + 0.25 * F.col("hits") / F.col("nq")
    pairs = pairs.select(q, d, base.alias("base"), boost(F.col("qn"), F.col("name"), F.col("tags")).alias("boost"), "qn", "norm")
    if full:
        least = F.col("base") + F.col("boost")
        pairs = stored(pairs.withColumns({"least": least, "most": least + 0.15 * ratio_bound(F.col("qn"), F.col("norm"))}))
        kth = pairs.groupBy(q).agg(F.get(F.sort_array(F.collect_list("least"), False), F.lit(k - 1)).alias("kth"))  # a few more than k
        pairs = pairs.join(few(kth), q).where(F.col("kth").isNull() | (F.col("most") >= F.col("kth") - topk.SLACK))
        fuzzy = fuzzy_full(F.col("qn"), F.col("norm"))
    else:
        fuzzy = fuzzy_plain(F.col("qn"), F.col("norm"))
    return pairs.select(q, d, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("base") + 0.15 * fuzzy + F.col("boost"))).alias("score"))


def _likeliest(rows: list, terms: DataFrame, near: DataFrame, q: str, d: str, k: int, key: T.DataType) -> DataFrame:
    """(q, d, score) of the pairs that may be among the k best by the token-set ratio. near: documents from which a
    question's k-th best is a threshold for all others."""
    search = lambda rows, docs: stored(dense.likeliest(rows, docs, d, k, boosts, token_set_ratio), dense.SLICE)
    first = search([r.asDict() | {"least": None} for r in rows], terms.join(few(near), d, "left_semi"))
    kth = first.groupBy("_i").agg(F.get(F.sort_array(F.collect_list("score"), False), F.lit(k - 1)).alias("least"))  # k of each task
    least = dict(kth.collect())
    found = search([r.asDict() | {"least": least.get(i)} for i, r in enumerate(rows)], terms)
    return dense.keyed(found, rows, key, q).select(q, d, "score")


def unmatched(questions: DataFrame, docs: DataFrame, scored: DataFrame, q: str, d: str) -> DataFrame:
    """(q, d, score): for questions that share no token with any document, the first of the documents of best boost."""
    left = questions.join(scored.select(q).distinct(), q, "left_anti").select(q, F.col("norm").alias("qn"))
    return names.first_by_name(stored(left), docs, q, d, boost)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with the columns of the table as bits of one integer."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def token_set_ratio(a: str, b: str) -> float:
    """0 to 100: the best indel similarity among common words, common words with one's rest, and with the other's rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and not (left and right):
        return 100.0
    shared = len(both) + bool(both)
    n, m = shared + len(left), shared + len(right)
    found = [200 * (shared + common_subsequence(left, right)) / (n + m)]
    if both:
        found += [200 * len(both) / (len(both) + n), 200 * len(both) / (len(both) + m)]
    return max(found)


def fuzzy_full(a: Column, b: Column) -> Column:
    """The token-set ratio of two texts, 0 to 1, in Arrow batches. Costs the product of the lengths: for winners, not for all."""

    @F.pandas_udf("double")
    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([token_set_ratio(x or "", y or "") / 100 for x, y in zip(a, b, strict=True)], dtype=float)

    return ratios(a, b)


def fuzzy_ratio(pairs: DataFrame, a: str, b: str, out: str = "fuzzy") -> DataFrame:
    """pairs with fuzzy_full() of two columns in their place."""
    return pairs.withColumn(out, fuzzy_full(F.col(a), F.col(b))).drop(a, b)


def ratio_bound(a: Column, b: Column) -> Column:
    """What the token-set ratio of two texts, 0 to 1, can be at most: from the lengths of their common words and rests."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda t: t != ""))
    length = lambda w: F.greatest(F.length(F.array_join(w, " ")), F.lit(0))
    x, y = words(a), words(b)
    both, left, right = F.array_intersect(x, y), F.array_except(x, y), F.array_except(y, x)
    n = length(both)
    shared = n + (F.size(both) > 0).cast("int")
    p, r = shared + length(left), shared + length(right)
    best = F.greatest(2 * (shared + F.least(length(left), length(right))) / (p + r), F.when(F.size(both) > 0, F.greatest(2 * n / (n + p), 2 * n / (n + r))).otherwise(0.0))
    whole = (F.size(both) > 0) & ((F.size(left) == 0) | (F.size(right) == 0))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when(whole, 1.0).otherwise(F.least(F.lit(1.0), best))


def trigger_score(q_toks: Column, q_norm: Column, triggers: Column) -> Column:
    """Sum over normalised triggers: 3 if all its words are in the question, the share of words if at least half
    are, 0.5 if the trigger (10 characters or more) is a substring; triggers of one word count nothing."""

    def one(t: Column) -> Column:
        words = F.array_distinct(F.split(t, " "))
        n, hits = F.size(words), F.size(F.array_intersect(words, q_toks))
        whole = F.when(hits == n, F.lit(3.0)).otherwise(F.lit(0.0))
        half = F.when(hits >= F.greatest(F.lit(1), F.floor(n / 2)), hits / n).otherwise(F.lit(0.0))
        inside = F.when((F.length(t) >= 10) & F.contains(q_norm, t), F.lit(0.5)).otherwise(F.lit(0.0))
        return F.when(n <= 1, F.lit(0.0)).otherwise(whole + half + inside)

    return F.aggregate(triggers, F.lit(0.0), lambda a, t: a + one(t))


def trigger_sums(questions: DataFrame, triggers: DataFrame, q: str, d: str) -> DataFrame:
    """(q, d, score): trigger_score over all triggers of d, for pairs that score; repeats of a trigger count.

    questions: key, qn and qt (its distinct words); triggers: key and trigger, one row each, of any number. A trigger of
    n words scores with half of them in the question at least, so one of any n - half + 1 words is there: these, the
    longest, are joined with the questions' words, and a pair is scored at the first word it shares. What is in a question may begin
    and end within words, so it is found by its first characters. Sums are partial."""
    k = triggers.select(d, "trigger", F.array_distinct(F.split("trigger", " ")).alias("words")).withColumn("n", F.size("words")).where("n > 1")
    long = k.where(F.length("trigger") >= dense.RUN).select(d, "trigger")
    k = k.withColumn("half", F.greatest(F.lit(1), F.floor(F.col("n") / 2).cast("int")))
    longest = F.sort_array(F.transform("words", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    k = k.withColumn("words", F.transform(longest, lambda x: x["w"]))
    k = k.select(d, "trigger", "words", "n", "half", F.explode(F.slice("words", F.lit(1), F.col("n") - F.col("half") + 1)).alias("token"))
    asked = questions.select(q, "qn", "qt", F.explode("qt").alias("token"))
    met = word_join(k, asked, "token", d).withColumn("shared", F.array_intersect("words", "qt"))
    met = met.where((F.size("shared") >= F.col("half")) & (F.get("shared", F.lit(0)) == F.col("token")))
    met = met.withColumn("hits", F.size("shared"))
    whole = F.when(F.col("hits") == F.col("n"), F.lit(3.0)).otherwise(F.lit(0.0))
    scored = met.select(q, d, (whole + F.col("hits") / F.col("n")).alias("part"))
    spelled = questions.select(q, "qn", F.explode(names.runs(F.col("qn"), dense.RUN)).alias("run"))
    inside = word_join(long.withColumn("run", F.substring("trigger", 1, dense.RUN)), spelled, "run", d).where(F.contains("qn", "trigger"))
    scored = scored.unionByName(inside.select(q, d, F.lit(0.5).alias("part")))
    return scored.groupBy(q, d).agg(F.sum("part").alias("score"))


def trigger_best(questions: DataFrame, docs: DataFrame, q: str, d: str, k: int) -> DataFrame | None:
    """(q, d, score, kind): of each question and kind of documents the k best by score and place, and what comes within
    dense.SLACK of them; None if the questions are too many to be held by a task: then trigger_sums() is the way.

    questions: key, qn and qt; docs: key (each once), place, kind, triggers, own and factor; see dense.trigger_best()."""
    rows = dense.held(questions.select(q, "qn", "qt"), docs.schema[d].dataType, docs.schema["place"].dataType)
    if rows is None:
        return None
    found = dense.trigger_best(rows, docs, d, k)
    return dense.keyed(found, rows, questions.schema[q].dataType, q).select(q, d, "score", "kind")


def block_score(triggers_score: Column, q_toks: Column, own_toks: Column, overview: Column) -> Column:
    """Trigger scores and three times the share of the block's own question; half of it for overview blocks."""
    share = F.size(F.array_intersect(q_toks, own_toks)) / F.greatest(F.size(F.array_distinct(own_toks)), F.lit(1))
    return (triggers_score + 3 * share) * F.when(overview, 0.5).otherwise(1.0)


#: Distinct tags that are looked for in every question.
LOOKED = 1000


def tag_hits(questions: DataFrame, items: DataFrame, q: str, d: str) -> DataFrame:
    """(q, d, hits): how many of an item's tags are substrings of the question's text q; repeats of a tag count.

    questions: key and q; items: key and tags. Some distinct tags, however many items have them, are looked for in each text; beyond
    LOOKED it is an equi-join of the text's runs of one to three characters with the beginnings of the tags, then the test,
    instead of all pairs."""
    tags = stored(items.select(d, F.explode("tags").alias("tag")).where("tag <> ''").groupBy(d, "tag").agg(F.count("*").alias("k")))
    each = tags.select("tag").distinct()
    if fits(each, LOOKED):
        met = questions.select(q, "q").join(F.broadcast(each), F.contains("q", "tag")).select(q, "tag")
        met = word_join(met, tags, "tag", q)
    else:
        at = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("q"), F.lit(1))), lambda i: F.substring(F.col("q"), i, F.lit(n)))
        runs = questions.select(q, "q", F.explode(F.array_distinct(F.concat(at(1), at(2), at(3)))).alias("run"))
        met = word_join(tags.withColumn("run", F.substring("tag", 1, 3)), runs, "run", d).where(F.contains("q", "tag"))
    return met.groupBy(q, d).agg(F.sum("k").cast("int").alias("hits"))
