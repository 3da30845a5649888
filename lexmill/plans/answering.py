"""Questions in bulk against knowledge bases: the three ways of answering, each one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import dense, ranking, scoring
from lexmill.operators.joins import few, stored
from lexmill.plans import predicates, provider, routing, rules
from lexmill.plans.predicates import Terms

#: Where a row's answer came from.
LOCAL, NO_LOCAL, TWO_PASS, ENGINE, EMPTY = "items", "items_fallback", "two_pass", "engine", "empty"


def in_language(answers: Column, lang: str, default: str, fallback: Column) -> Column:
    """The answer in a language, else in the default one, else the fallback; empty ones don't count."""
    return X.first_filled(F.try_element_at(answers, F.lit(lang)), F.try_element_at(answers, F.lit(default)), fallback)


def variant(variants: Column, mode: str, lang: str) -> Column:
    """A nested map's value; null where a level has no such key."""
    return F.try_element_at(F.try_element_at(variants, F.lit(mode)), F.lit(lang))


def by_route(questions: DataFrame, blocks: DataFrame, items: DataFrame, routes: list[tuple[str, tuple[str, ...]]], refer: str, analyse: str, solve: str, call=provider.offline, least: float = 0.18, mode: str = "gold", lang: str = "it") -> DataFrame:
    """(q, answer, source, item, block): routed questions, each answered by its route.

    questions: q, text (blank ones get source empty and no answer). items: item, tags (array), place, variants (map of
    maps), answer_lang, answer. blocks: block, place, text. The first route ("commercial") takes the item with most tags in
    the question, the second ("situational") two calls of the engine, all others one call; they also name the block whose
    words the question shares most, by least at least."""
    asked, blank = routing.checked(questions.select("q", "text"), "text")
    asked = asked.withColumn("route", routing.route(F.col("text"), routes, "technical"))
    commercial, situational = (asked.where(F.col("route") == name) for name, _ in routes[:2])
    technical = asked.where(F.col("route") == "technical")

    n1 = commercial.select(F.col("q").alias("asked"), X.normalize(F.lower("text")).alias("q"))
    hits = scoring.tag_hits(n1.withColumnRenamed("asked", "question_id"), items.select("item", F.transform("tags", F.lower).alias("tags")), "question_id", "item")
    best = ranking.best(hits.join(items.select("item", "place"), "item"), "question_id", "hits", "place").select(F.col("question_id").alias("q"), "item")
    found = best.join(items, "item").select("q", "item", X.first_filled(variant(F.col("variants"), mode, lang), F.col("answer_lang"), F.coalesce("answer", F.lit(""))).alias("found"))
    local = commercial.join(found, "q", "left").select(
        "q", F.when(F.col("item").isNotNull(), F.coalesce("found", F.lit(""))).otherwise(F.lit(refer)).alias("answer"),
        F.when(F.col("item").isNotNull(), LOCAL).otherwise(NO_LOCAL).alias("source"), "item", F.lit(None).cast(blocks.schema["block"].dataType).alias("block"))

    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    two = provider.two_pass(situational, "text", analyse, solve, call).select("q", F.col("reply").alias("answer"), F.lit(TWO_PASS).alias("source"), none(items, "item"), none(blocks, "block"))

    toks = lambda df, key: df.select(key, X.tokens(X.normalize(F.coalesce("text", F.lit("")))).alias("toks"))
    told = blocks.select("block", "place", X.tokens(X.normalize(F.coalesce("text", F.lit("")))).alias("toks"))
    shared = scoring.overlap_best(toks(technical, "q"), told, "q", "block", 1, least).join(blocks.select("block", "place"), "block")
    meta = ranking.best(shared, "q", "score", "place", least).select("q", "block")
    one = provider.ask(technical, "text", "answer", call).join(meta, "q", "left").select("q", "answer", F.lit(ENGINE).alias("source"), none(items, "item"), "block")
    rest = blank.select("q", F.lit(None).cast("string").alias("answer"), F.lit(EMPTY).alias("source"), none(items, "item"), none(blocks, "block"))
    return local.unionByName(two).unionByName(one).unionByName(rest)


def _block_texts(blocks: DataFrame, *more: Column) -> DataFrame:
    """block, its normalised triggers, its own words, the factor of overview blocks, and more."""
    told = F.filter(F.transform(F.coalesce("triggers", F.array().cast("array<string>")), lambda t: X.normalize_folded(t)), lambda t: t != "")
    return blocks.select("block", told.alias("triggers"), X.split_words(X.normalize_folded(F.col("question"))).alias("own"), F.when(_overview(), 0.5).otherwise(1.0).alias("factor"), *more)


def _overview() -> Column:
    return F.contains(F.upper(F.coalesce("id", F.lit(""))), F.lit("OVERVIEW"))


def _asked_words(questions: DataFrame) -> DataFrame:
    return questions.select("q", F.col("norm").alias("qn"), F.array_distinct(X.split_words(F.col("norm"))).alias("qt"))


def block_scores(questions: DataFrame, blocks: DataFrame) -> DataFrame:
    """(q, block, score): trigger scores and three times the share of a block's own words that the question has; half of
    it for overview blocks. Pairs that score nothing are absent. For the best blocks alone block_best() is the way.

    questions: q, norm; blocks: block, id, question, triggers. Both parts are token joins, and sums are partial."""
    asked, texts = _asked_words(questions), _block_texts(blocks)
    told = texts.select("block", F.explode("triggers").alias("trigger"))
    share = scoring.overlap(texts.select("block", F.col("own").alias("toks")), asked.select("q", F.col("qt").alias("toks")), "block", "q").select("q", "block", (3 * F.col("score")).alias("score"))
    both = scoring.trigger_sums(asked, told, "q", "block").select("q", "block", "score").unionByName(share).groupBy("q", "block").agg(F.sum("score").alias("score"))
    return both.join(texts.select("block", "factor"), "block").select("q", "block", (F.col("score") * F.col("factor")).alias("score")).where("score > 0")


def block_best(questions: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(q, block, score): block_scores() of pairs that may be among the k best by score and place of their question and kind of
    blocks (overlay, overview, other), written once; of all pairs where the questions are too many for one pass.

    blocks: as for block_scores(), block and place being whole numbers, and overlay."""
    kind = F.when(F.col("overlay"), 0).when(_overview(), 1).otherwise(2)
    dealt = blocks.repartition("block")  # few files should not mean few tasks
    told = _block_texts(dealt, "place", kind.alias("kind"))
    found = scoring.trigger_best(_asked_words(questions), told, "q", "block", k)
    if found is None:
        return block_scores(questions, blocks)
    found = stored(found)  # k of each task
    kth = found.withColumn("rank", F.row_number().over(Window.partitionBy("q", "kind").orderBy(F.desc("score"))))
    kth = kth.where(F.col("rank") == k).select("q", "kind", (F.col("score") - dense.SLACK).alias("least"))
    return stored(found.join(F.broadcast(kth), ["q", "kind"], "left").where(F.col("least").isNull() | (F.col("score") >= F.col("least"))).select("q", "block", "score"))


def by_blocks(questions: DataFrame, blocks: DataFrame, fallback: str, terms: Terms = Terms(), template: str = "{question}\n{candidates}", call=provider.offline, lang: str = "it", default: str = "it", mode: str = "gold", limit: int = 15) -> DataFrame:
    """(q, ok, answer, family, id, mode, lang, score): the block that answers each question, or the fallback.

    questions: q, text (blank ones are left out; see routing.checked). blocks: block (unique), overlay (boolean), place,
    id, family, question, triggers, tags, answers (map by language). The first tier with any candidate is used: overlays,
    then overview blocks if the question asks for an overview, then all others; of a tier the limit best by score and place
    are candidates, which the predicates narrow and the engine picks from (the first, where there is none)."""
    asked, _ = routing.checked(questions.select("q", "text"), "text")
    asked = asked.withColumn("norm", X.normalize_folded(F.col("text")))
    asked = stored(asked)
    flags = asked.select("q", "text", *[c.alias(k) for k, c in predicates.asks(F.col("norm"), terms).items()])
    pairs = block_best(asked, blocks, limit)
    told = blocks.join(few(pairs.select("block").distinct()), "block", "left_semi")  # only these blocks' texts are searched for terms
    marked = told.select("block", "overlay", "place", "id", "family", "question", "answers", *[c.alias(k) for k, c in predicates.says(F.col("id"), F.col("question"), F.col("triggers"), F.col("tags"), terms).items()])
    scored = pairs.join(marked, "block").join(flags, "q")
    tier = F.when(F.col("overlay"), F.array(F.lit(0))).when(F.col("is_overview") & F.col("asks_overview"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))
    tiers = scored.withColumn("tier", F.explode(tier))
    first = tiers.groupBy("q").agg(F.min("tier").alias("tier"))
    top = ranking.top_k(tiers.join(first, ["q", "tier"]), "q", limit, F.desc("score"), F.asc("place")).drop("rank")
    ranked = predicates.narrowed(top, "q", F.desc("score"), F.asc("place"))
    won = provider.choose(ranked, "q", "id", "rank", "text", "question", template, call).select("q", "id", "family", "score", "answers")
    out = asked.select("q").join(won, "q", "left")
    ok = F.col("score").isNotNull()
    return out.select(
        "q", ok.alias("ok"), F.when(ok, in_language(F.col("answers"), lang, default, F.lit(fallback))).otherwise(F.lit(fallback)).alias("answer"),
        "family", "id", F.lit(mode).alias("mode"), F.lit(lang).alias("lang"), F.coalesce("score", F.lit(0.0)).alias("score"))


def best_answer(pairs: DataFrame, by: str, question: Column, limit: int = 1200, full: bool = False) -> DataFrame:
    """(by, answer, matched): of each document's pairs the one whose question is most like the question asked, the first
    of equals; its answer without a label, whole. Where that is empty, the first paragraph of the text without labels.

    pairs: by, text, q, a, place, one row for each pair (q null: a document without pairs). question: normalised. full: by
    the token-set ratio instead of its plain form."""
    alike = scoring.fuzzy_full if full else scoring.fuzzy_plain
    score = F.when(X.normalize_folded(F.col("q")) == "", 0.0).otherwise(alike(question, X.normalize_folded(F.col("q"))))
    rows = pairs.select(by, "text", "place", F.trim("q").alias("q"), X.strip_label(F.coalesce("a", F.lit(""))).alias("a"), F.when(F.col("q").isNull(), -1.0).otherwise(score).alias("s"))
    won = rows.groupBy(by).agg(F.max(F.struct("s", (-F.col("place")).alias("p"), "q", "a", "text")).alias("w"))
    start = X.first_paragraph(X.strip_labels(X.trim_all(F.coalesce("w.text", F.lit("")))))
    none = F.col("w.a") == ""
    return won.select(by, X.clamp(F.when(none, start).otherwise(F.col("w.a")), limit).alias("answer"), F.when(~none, F.col("w.q")).alias("matched"))


def two_chances(questions: DataFrame, index: DataFrame, threshold: float = 0.30, full: bool = False) -> DataFrame:
    """(q, doc, score, second): the best document of the expanded question; under the threshold that of the question as
    it is, whatever it scores. Both are asked in one search.

    questions: q, base, toks, expanded (words); index: doc, norm, toks, name, tags, and words, if overlap counts other ones than toks."""
    plain = F.struct(F.lit(True).alias("second"), F.col("base").alias("norm"), F.col("toks").alias("toks"))
    wide = F.struct(F.lit(False).alias("second"), F.array_join("expanded", " ").alias("norm"), F.col("expanded").alias("toks"))
    both = questions.select("q", F.explode(F.array(wide, plain)).alias("v")).select(F.struct("q", "v.second").alias("key"), "v.norm", "v.toks")
    both, index = stored(both), stored(index)
    scored = stored(scoring.hybrid_best(both, index, "key", "doc", full=full))
    scored = scored.unionByName(scoring.unmatched(both, index, scored, "key", "doc")).withColumn("score", F.round("score", 6))
    best = ranking.best(scored, "key", "score", "doc").select("key.q", "key.second", "doc", "score")
    top = best.groupBy("q").agg(F.min_by(F.struct("doc", "score", "second"), F.when(~F.col("second") & (F.col("score") >= threshold), 0).otherwise(F.when(F.col("second"), 1).otherwise(2))).alias("t"))
    return top.select("q", "t.*")


def by_search(questions: DataFrame, docs: DataFrame, synonyms: dict[str, list[str]], enrichment: dict | None = None, stop: tuple[str, ...] = (), threshold: float = 0.30, limit: int = 1200, full: bool = False) -> DataFrame:
    """(q, answer, found, score, doc, matched): the document of best hybrid score and the best answer in it.

    questions: q, text; docs: doc, name, text, norm, norm_tags, qas, as sources.tagged.index gives them. The expanded question is
    searched first; under the threshold the question as it is takes its best, whatever it scores, so only documents
    without any text give no answer. Enrichment (topics, rules, prefix, suffix) is added to what was found. full: texts and
    the questions of pairs are compared by their token-set ratio, not by its plain form. Synonyms are normalised as texts are."""
    norm = lambda c: X.normalize_stop(c, stop)
    asked = questions.select("q", "text", norm(F.col("text")).alias("base"))
    words = X.tokens(F.col("base"))
    said = F.array_join(F.flatten(F.transform("qas", lambda x: F.array(norm(x["q"]), norm(x["a"])))), " ")
    index = docs.select("doc", "norm", "name", F.col("norm_tags").alias("tags"), X.tokens(F.concat_ws(" ", "norm", said)).alias("toks"), X.tokens(F.col("norm")).alias("words"))

    expanded = X.expand(words, synonyms, norm) if synonyms else words
    top = two_chances(asked.select("q", "base", words.alias("toks"), expanded.alias("expanded")), index, threshold, full)
    pairs = top.join(asked, "q").join(docs.select("doc", F.col("text").alias("body"), F.posexplode_outer("qas").alias("place", "qa")), "doc")
    pairs = pairs.select(F.col("q").alias("asked"), F.col("body").alias("text"), F.coalesce("place", F.lit(0)).alias("place"), F.col("qa.q").alias("q"), F.col("qa.a").alias("a"), "base")
    answers = best_answer(pairs, "asked", F.col("base"), limit, full).withColumnRenamed("asked", "q")
    out = top.join(answers, "q").join(asked.select("q", "text"), "q")
    has = F.col("answer") != ""
    e = enrichment or {}
    rich = rules.enrich_by_topic(F.col("text"), F.col("answer"), e.get("topics") or {}, e.get("rules") or [], e.get("prefix") or "", e.get("suffix") or "", norm) if e else F.col("answer")
    return out.select("q", F.when(has, rich).alias("answer"), has.alias("found"), F.when(has, F.round("score", 3)).alias("score"), "doc", "matched")
