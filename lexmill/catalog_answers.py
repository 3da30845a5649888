"""Queries of hybrid ranking, product lookup, rules and fallbacks, with equivalent SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.catalog import SQL as TEXTS_SQL
from lexmill.catalog import _FOLD, _NORM, AFTER, BEFORE, ROUTES, SYNONYMS, _lines, _t, _word
from lexmill.functions import text as X
from lexmill.operators import language, products, ranking, scoring
from lexmill.operators.joins import shared_dir, stored
from lexmill.plans import answering, predicates, provider, rulebook, rules
from lexmill.sources.knowledge import concatenated, headed
from lexmill.sources.tagged import index
from lexmill.streaming.answering import answer_stream

THRESHOLD = 0.3
CODES = ("small", "red")
TOPICS = {"The": "On the.", "of that": "Never, being two words.", "Quê": "Sobre que."}
TOPIC_RULES = [{"if_any": ("The", "der"), "add": "Article."}, {"if_all": ("the", "that"), "add": "Both."}, {"add": "Always."}, {"if_any": ("the",), "add": " "}]
PATTERNS = [
    {"pattern": f"(?i){BEFORE}the{AFTER}", "mode": "augment", "answer": "More on it."},
    {"pattern": f"(?i)^re{AFTER}", "mode": "override", "answer": "Replaced.", "priority": 1},
    {"pattern": f"(?i){BEFORE}que{AFTER}", "mode": "override", "answer": "Reemplazado.", "priority": 5},
    {"pattern": r"[?]\z", "mode": "postscript", "answer": "P.S."},
    {"pattern": "(unclosed", "mode": "override", "answer": "Never."},
]
EXPECTED = [{"family": "en", "id_hint": "1", "must_include": ["the", "an"]}, {"family": "fr", "id_hint": "", "must_include": ["le"]}, {"family": "en", "id_hint": "12", "must_include": ["zzz"]}]
TEMPLATE = "Question: {question}\nContext: {context}\nAnswer:"


def _questions(spark, d) -> DataFrame:
    q = _t(spark, d, "benchmark").select("item_id", X.normalize(F.coalesce("text", F.lit(""))).alias("norm"))
    return q.select("item_id", "norm", X.tokens(F.col("norm")).alias("toks"))


def _named_docs(spark, d) -> DataFrame:
    """A document is named by its source and tagged by its language."""
    named = [F.lower(F.coalesce(c, F.lit(""))) for c in ("source", "lang")]
    k = _t(spark, d, "documents").select("doc_id", X.normalize(F.coalesce("text", F.lit(""))).alias("norm"), named[0].alias("name"), F.array(named[1]).alias("tags"))
    return k.select("doc_id", "norm", X.tokens(F.col("norm")).alias("toks"), "name", "tags")


def _top1(scored: DataFrame) -> DataFrame:
    return ranking.best(scored.withColumn("score", F.round("score", 6)), "item_id", "score", "doc_id").select("item_id", "doc_id", "score")


def _best(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """The best document of every question, those without a shared token included."""
    scored = stored(scoring.hybrid_best(questions, docs, "item_id", "doc_id"))
    return _top1(scored.unionByName(scoring.unmatched(questions, docs, scored, "item_id", "doc_id")))


def hybrid_top1(spark, d):
    return _best(_questions(spark, d), _named_docs(spark, d))


def hybrid_full_top1(spark, d):
    """hybrid_top1 with the token-set ratio inside the ranking. No SQL: subsequences need a table for each pair."""
    questions, docs = _questions(spark, d), _named_docs(spark, d)
    scored = stored(scoring.hybrid_best(questions, docs, "item_id", "doc_id", full=True))
    return _top1(scored.unionByName(scoring.unmatched(questions, docs, scored, "item_id", "doc_id")))


def second_chance(spark, d):
    """The best match of the expanded question; if it is under the threshold, that of the question as it is."""
    q = _questions(spark, d).select(F.col("item_id").alias("q"), F.col("norm").alias("base"), "toks", X.expand(F.col("toks"), SYNONYMS).alias("expanded"))
    top = answering.two_chances(q, _named_docs(spark, d).withColumnRenamed("doc_id", "doc"), THRESHOLD)
    return top.select(F.col("q").alias("item_id"), F.col("doc").alias("doc_id"), "score", "second")


def fuzzy_token_set(spark, d):
    """The token-set ratio of each question and its best document."""
    top = hybrid_top1(spark, d).select("item_id", "doc_id")
    texts = _named_docs(spark, d).select("doc_id", F.col("norm").alias("dn"))
    pairs = top.join(_questions(spark, d).select("item_id", F.col("norm").alias("qn")), "item_id").join(texts, "doc_id")
    return scoring.fuzzy_ratio(pairs, "qn", "dn").withColumn("fuzzy", F.round("fuzzy", 6))


def best_qa(spark, d):
    """Of a conversation's question-answer pairs the one nearest to its last question: its whole answer, clamped, or
    where that is empty the first paragraph of the conversation's system text."""
    c = _t(spark, d, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    last = q.groupBy("conv_id").agg(F.max(F.struct("turn", "q")).alias("f")).select("conv_id", F.col("f.q").alias("asked"))
    text = c.where("role = 'system'").groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("s")).select("conv_id", F.col("s.text").alias("text"))
    pairs = q.join(a, ["conv_id", "turn"]).join(last, "conv_id").join(text, "conv_id", "left").withColumnsRenamed({"turn": "place", "answer": "a"})
    return answering.best_answer(pairs, "conv_id", X.normalize_folded(F.col("asked")), 300)


def folder_parts(spark, d):
    return _t(spark, d, "documents").select("source", "doc_id", headed(F.col("doc_id"), F.col("text")).alias("part"))


def _product_questions(spark, d) -> DataFrame:
    p = _t(spark, d, "part")
    loose = p.select(F.concat_ws(" ", F.lit("need"), "p_name", F.col("p_size").cast("string")).alias("q"))
    return loose.unionByName(p.select(F.upper("p_name").alias("q"))).distinct()


def lookup_product(spark, d):
    return products.lookup(_product_questions(spark, d), _t(spark, d, "part"), "q", "q", "p_partkey", "p_name", CODES, CODES)


def _note(df: DataFrame) -> DataFrame:
    numbers = [("size: %d", F.col("p_size")), ("price: %.2f", F.col("p_retailprice"))]
    texts = [("brand: %s", F.col("p_brand"))]
    extra = [(F.col("p_type").isin("ECONOMY", "SMALL"), "can be rented")]
    return df.select("p_partkey", products.note(F.col("p_name"), numbers, texts, extra).alias("note"))


def product_note(spark, d):
    return _note(_t(spark, d, "part"))


def enrich_answer(spark, d):
    answers = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("answer"))
    return products.enrich(answers, _note(_t(spark, d, "part")), "p_partkey", "answer", "note").groupBy("answer").agg(F.count("*").alias("n"))


def enrich_rules(spark, d):
    return _t(spark, d, "benchmark").select("item_id", rules.enrich_by_topic(F.col("text"), F.col("text"), TOPICS, TOPIC_RULES, "Answer:", "End.").alias("answer"))


def _turns(spark, d) -> DataFrame:
    c = _t(spark, d, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    return c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q")).join(a, ["conv_id", "turn"])


def regex_rules(spark, d):
    good, _ = rules.usable(spark, PATTERNS)
    return _turns(spark, d).select("conv_id", "turn", rules.answer_by_pattern(F.col("q"), F.col("a"), good).alias("answer"))


def expected_patterns(spark, d):
    found = rules.expectations(F.col("lang"), F.col("doc_id").cast("string"), F.col("text"), EXPECTED)
    return _t(spark, d, "documents").select("doc_id", F.inline(found))


def render_template(spark, d):
    made = rules.context([("item", F.col("item_id")), ("length", F.length("text"))])
    return _t(spark, d, "benchmark").select("item_id", rules.render(TEMPLATE, question=F.col("text"), context=made).alias("prompt"))


def context_string(spark, d):
    fields = [("brand", F.col("p_brand")), ("type", F.nullif(F.col("p_type"), F.lit("SMALL"))), ("size", F.col("p_size"))]
    return _t(spark, d, "part").select("p_partkey", rules.context(fields).alias("context"))


def offline_answers(spark, d):
    q = _t(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return provider.ask(q, "text").select("conv_id", "turn", "reply")


def folder_text(spark, d):
    """The parts of each language's shortest texts, joined by blank lines: a conversation is a folder, its turns are files."""
    c = _t(spark, d, "conversations").select("conv_id", "turn", headed(F.concat_ws("-", "turn", "role"), F.col("text")).alias("part"))
    return concatenated(c, ["conv_id"], "turn", F.col("part"))


def _blocks(spark, d) -> DataFrame:
    """Documents as blocks: each line is a trigger, the first one the block's question; one source is the overlay."""
    k = _t(spark, d, "documents")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    kind = F.when(F.col("doc_id") % 7 == 0, "OVERVIEW").when(F.col("doc_id") % 5 == 0, "KILLER").otherwise("ITEM")
    return k.select(F.col("doc_id").alias("block"), (F.coalesce(F.col("source"), F.lit("")) == "src0").alias("overlay"), F.col("doc_id").alias("place"), F.concat_ws("-", kind, F.col("doc_id").cast("string")).alias("id"),
        F.col("lang").alias("family"), F.element_at(lines, 1).alias("question"), lines.alias("triggers"), F.array("lang").alias("tags"), F.create_map(F.coalesce("lang", F.lit("xx")), F.concat(F.lit("See "), F.col("doc_id").cast("string"))).alias("answers"))


#: Terms of the test tables' invented words in place of the Italian ones.
OWN_TERMS = predicates.Terms(overview=("tion",), diagnostic=("the ",), structural=(" in ",), structural_block=("ing",), ambient_block=("zzz",), negation=(" of ",), negation_block=("er",), geometry=("and",), defect=("xx",), limits=("that",), limits_id="-1")


def _bench_questions(spark, d) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("q"), "text")


def block_score_top3(spark, d):
    q = _bench_questions(spark, d).select("q", X.normalize_folded(F.col("text")).alias("norm"))
    s = answering.block_best(q, _blocks(spark, d), 3).withColumn("score", F.round("score", 6))
    return ranking.top_k(s, "q", 3, F.desc("score"), F.asc("block"))


def question_flags(spark, d):
    q = _t(spark, d, "documents").select("doc_id", "lang", X.normalize_folded(F.col("text")).alias("norm"))
    told = F.array("norm")
    return q.select("doc_id", *[c.alias(k) for k, c in predicates.asks(F.col("norm"), OWN_TERMS).items()], *[c.alias(k) for k, c in predicates.says(F.concat_ws("-", F.lit("err"), F.col("doc_id").cast("string")), F.col("lang"), told, told, OWN_TERMS).items()])


def answer_by_blocks(spark, d):
    out = answering.by_blocks(_bench_questions(spark, d), _blocks(spark, d), "No answer.", OWN_TERMS, lang="fr", default="en")
    return out.withColumn("score", F.round("score", 6))


def _word_rules(spark, d) -> DataFrame:
    """A rule for each longer word of the benchmark: its mode and priority come from the word's length."""
    words = _t(spark, d, "benchmark").select(F.explode(X.tokens(X.normalize_folded(F.col("text")))).alias("rule")).where("length(rule) >= 4").distinct()
    mode = F.element_at(F.array(*map(F.lit, ("override", "augment", "postscript"))), (F.length("rule") % 3 + 1).cast("int"))
    return words.select("rule", F.concat(F.lit("(?i) "), "rule", F.lit("[a-z]*[ .,]")).alias("pattern"), mode.alias("mode"), F.concat(F.lit("See "), "rule").alias("answer"), F.length("rule").alias("priority"))


def rule_table(spark, d):
    """Answers of all turns after a table of as many rules as the benchmark has longer words."""
    turns = _turns(spark, d).select(F.struct("conv_id", "turn").alias("q"), F.col("q").alias("text"), F.col("a").alias("answer"))
    return rulebook.answers(turns, _word_rules(spark, d)).select("q.conv_id", "q.turn", "answer")


def expectation_table(spark, d):
    """Expectations as a table: each benchmark item expects its first two words of the documents of a language and an id's beginning."""
    words = X.tokens(X.normalize(F.coalesce("text", F.lit(""))))
    lang = F.element_at(F.array(*map(F.lit, ("en", "fr", "de"))), (F.col("item_id") % 3 + 1).cast("int"))
    told = _t(spark, d, "benchmark").select(F.col("item_id").alias("rule"), lang.alias("family"), (F.col("item_id") % 10).cast("string").alias("id_hint"), F.slice(words, F.lit(1), F.lit(2)).alias("must_include"))
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("family"), F.lower("text").alias("answer"))
    return rulebook.expectations(docs, told).groupBy("rule").agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("int")).alias("held"))


def _routed(turns: DataFrame, documents: DataFrame) -> DataFrame:
    c = turns.where("role = 'user'").select(F.struct("conv_id", "turn").alias("q"), "text")
    said = F.create_map(F.lit("gold"), F.create_map(F.lit("it"), F.when(F.col("item") % 2 == 0, F.col("name")).otherwise("")))
    items = documents.groupBy("lang", "source").agg(F.min("doc_id").alias("item")).withColumn("name", F.concat_ws(" ", "source", "lang"))
    items = items.select("item", F.array(F.col("lang"), F.substring_index("source", "c", 1)).alias("tags"), F.col("item").alias("place"), said.alias("variants"), F.lit("").alias("answer_lang"), F.concat(F.lit("Item "), F.col("item").cast("string")).alias("answer"))
    blocks = documents.select(F.col("doc_id").alias("block"), F.col("doc_id").alias("place"), "text")
    out = answering.by_route(c, blocks, items, ROUTES, "Ask the office.", "Case: {question}", "Case: {question}\nFound: {analysis}")
    return out.select("q.conv_id", "q.turn", "answer", "source", "item", "block")


def answer_by_route(spark, d):
    """All users' turns: part names are the company's items, documents the blocks."""
    return _routed(_t(spark, d, "conversations"), _t(spark, d, "documents"))


def stream_answers(spark, d):
    """answer_by_route over a stream of the turns, one file a batch, all that is there."""
    schema = _t(spark, d, "conversations").schema
    turns = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/conversation[s].parquet")
    to = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    answer_stream(turns, lambda batch: _routed(batch, _t(spark, d, "documents")), f"{to}/out", f"{to}/progress").awaitTermination()
    return spark.read.parquet(f"{to}/out").drop("batch")


def answer_by_search(spark, d):
    """Conversations are the tagged documents; the benchmark asks."""
    docs = index(_lines(spark, d), X.normalize_folded).withColumn("name", F.col("doc").cast("string"))
    rich = {"topics": TOPICS, "rules": TOPIC_RULES, "prefix": "Answer:", "suffix": ""}
    return answering.by_search(_bench_questions(spark, d), docs, SYNONYMS, rich)


def fallback_chain(spark, d):
    """The local answer, else the engine's: assistants' turns answer users' turns where there are any."""
    pairs = _t(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text").join(_turns(spark, d).select("conv_id", "turn", "a"), ["conv_id", "turn"], "left")
    return provider.local_then_engine(pairs, "a", "text").select("conv_id", "turn", "reply")


def translated_answers(spark, d):
    """Without a provider every answer is the failed text, but for questions in the pivot language, which need none."""
    q = _t(spark, d, "documents").select("doc_id", "text", "lang", F.lit("").alias("context"))
    return provider.translated(q, "text", "context", "{context}\n{question}", F.col("lang"), failed="No translation.").select("doc_id", "reply")


def _profiles(spark, d) -> DataFrame:
    return language.profiles(_t(spark, d, "documents").select("lang", "text"), "lang", "text")


def detected_languages(spark, d):
    """The language of every turn and its distance, by profiles of all documents."""
    turns = _t(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("q"), "text")
    return language.detect(turns, _profiles(spark, d), "q", "text").select("q.conv_id", "q.turn", "lang", "distance")


def _echo(prompts: list[str]) -> list[str | None]:
    """An engine for tests: says how long its prompt is, and its last words."""
    return [f"{len(p)}: {p[-20:]}" for p in prompts]


def engine_answers(spark, d):
    """Users' turns put to an engine that echoes, found in their own language, asked in English and put back."""
    q = _t(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text", F.lit("none").alias("context"))
    return provider.translated(q, "text", "context", "{context}\n{question}", _profiles(spark, d), _echo, _echo).select("conv_id", "turn", "reply")


QUERIES = {
    f.__name__: f
    for f in (
        hybrid_top1, hybrid_full_top1, second_chance, fuzzy_token_set, best_qa, folder_parts, lookup_product, product_note, enrich_answer, enrich_rules, regex_rules, expected_patterns,
        render_template, context_string, offline_answers, folder_text, block_score_top3, question_flags, answer_by_blocks, answer_by_route, answer_by_search,
        fallback_chain, translated_answers, rule_table, expectation_table, stream_answers,
        detected_languages, engine_answers,
    )
}

_WORDS = "list_filter(string_split({c}, ' '), lambda x: x <> '')"
_GROUPS = " ".join(f"when x in {(k, *v)} then {[k, *v]}" for k, v in SYNONYMS.items())
_MORE = f"list_concat(t, flatten(list_transform(t, lambda x: case {_GROUPS} else [] end)))"
_EXPANDED = f"list_filter({_MORE}, lambda x, i: list_position({_MORE}, x) = i)"


def _hybrid_sql(name: str, toks: str, where: str = "true", text: str = "n") -> str:
    """CTEs that end in {name}(item_id, doc_id, score), over k, tf and df."""
    return f"""
    {name}q as (select item_id, {text} n, {toks} t from q0 where {where}),
    {name}w as (select item_id, w, count(*) qf from (select item_id, unnest(t) w from {name}q) group by 1, 2),
    {name}b as (select item_id, doc_id, sum(qf * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / a))) bm, count(*) hits from tf join df using (w) join {name}w using (w) group by 1, 2),
    {name}m as (select *, max(bm) over (partition by item_id) most from {name}b),
    {name}s as (select item_id, doc_id, 0.6 * case when most > 0 then bm / most else bm end + 0.25 * hits / len(list_distinct({name}q.t))
        + 0.15 * case when {name}q.n = '' or k.n = '' then 0 when {name}q.n = k.n then 1 when contains({name}q.n, k.n) or contains(k.n, {name}q.n) then 0.5 else 0 end
        + case when k.name <> '' and (contains({name}q.n, k.name) or contains(k.name, {name}q.n)) then 0.12 else 0 end
        + case when len(list_filter(k.tags, lambda x: x <> '' and (contains({name}q.n, x) or contains(x, {name}q.n)))) > 0 then 0.08 else 0 end v
        from {name}m join {name}q using (item_id) join k using (doc_id)),
    {name} as (select item_id, doc_id, round(greatest(0, least(1, v)), 6)::double score from {name}s qualify row_number() over (partition by item_id order by score desc, doc_id) = 1)"""


_BASE = f"""
    q0 as (select item_id, n, {_WORDS.format(c="n")} t from (select item_id, {_NORM.format(c="coalesce(text, '')")} n from benchmark)),
    k as (select doc_id, n, {_WORDS.format(c="n")} t, name, tags from (select doc_id, {_NORM.format(c="coalesce(text, '')")} n, lower(coalesce(source, '')) name, [lower(coalesce(lang, ''))] tags from documents)),
    tf as (select doc_id, w, count(*) f, any_value(dl) dl from (select doc_id, len(t) dl, unnest(t) w from k) group by 1, 2),
    st as (select count(*) n, avg(len(t)) a from k),
    ra as (select w, a, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) r from tf, st group by w, n, a),
    df as (select w, a, case when r < 0 then 0.25 * (select avg(r) from ra) else r end idf from ra)"""
_HAS = lambda t: f"list_contains(t, '{t}')"

SQL = {
    "hybrid_top1": f"with {_BASE}, {_hybrid_sql('h', 't')} select * from h",
    "second_chance": f"""with {_BASE}, {_hybrid_sql("e", _EXPANDED, text=f"array_to_string({_EXPANDED}, ' ')")}, f as (select * from e where score >= {THRESHOLD}), {_hybrid_sql("h", "t", "item_id not in (select item_id from f)")}
        select *, false "second" from f union all select *, true from h""",
    "best_qa": rf"""with q as (select conv_id, turn, text, {_FOLD.format(c="text")} q from conversations where role = 'user'), a as (select conv_id, turn - 1 turn, text a from conversations where role = 'assistant'),
        f as (select conv_id, arg_max(q, turn) asked from q group by 1), t as (select conv_id, arg_min(text, turn) body from conversations where role = 'system' group by 1),
        p as (select conv_id, turn, trim(text) matched, body, regexp_replace(coalesce(a, ''), '^\s+|\s+$', '', 'g') a, case when asked = '' or q = '' then 0 when asked = q then 1 when contains(asked, q) or contains(q, asked) then 0.5 else 0 end::double score
          from q join a using (conv_id, turn) join f using (conv_id) left join t using (conv_id)),
        w as (select *, case when a <> '' then a else regexp_replace(split_part(coalesce(body, ''), chr(10) || chr(10), 1), '^\s+|\s+$', '', 'g') end b from p qualify row_number() over (partition by conv_id order by score desc, turn) = 1)
        select conv_id, case when length(b) <= 300 then b else regexp_replace(coalesce(nullif(regexp_extract(b[1:300], '(?s)^(.+?[.!?])(?:\s|$)', 1), ''), b[1:300]), '\s+$', '') || ' …' end answer, case when a <> '' then matched end matched from w""",
    "folder_text": """select conv_id, string_agg('### FILE: ' || turn || '-' || role || ' ###' || chr(10) || coalesce(text, ''), chr(10) || chr(10) order by turn) "text" from conversations group by 1""",
    "fallback_chain": f"""select u.conv_id, u.turn, case when trim(a.text) <> '' then a.text else '{provider.UNAVAILABLE}' end reply from conversations u left join conversations a on u.conv_id = a.conv_id and a.role = 'assistant' and a.turn = u.turn + 1 where u.role = 'user'""",
    "translated_answers": "select doc_id, 'No translation.' reply from documents",
    "block_score_top3": f"""with q as (select item_id q, n, list_distinct(string_split(n, ' ')) t from (select item_id, {_FOLD.format(c="text")} n from benchmark)),
        l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) s from documents), k as (select doc_id, g, list_distinct(string_split(g, ' ')) d from (select doc_id, {_FOLD.format(c="s")} g from l) where g <> ''),
        h as (select q, doc_id, len(d) c, len(list_intersect(t, d)) x, length(g) >= 10 and contains(n, g) inside from q, k),
        s as (select q, doc_id, sum(case when c <= 1 then 0 else (case when x = c then 3.0 else 0 end) + (case when x >= greatest(1, c // 2) then x / c::double else 0 end) + (case when inside then 0.5 else 0 end) end)::double v from h group by 1, 2),
        o as (select doc_id, list_distinct(string_split({_FOLD.format(c="string_split(coalesce(text, ''), chr(10))[1]")}, ' ')) d from documents),
        b as (select q, doc_id, 3 * len(list_intersect(t, d)) / len(d)::double v from q, o),
        z as (select q, doc_id "block", round((coalesce(s.v, 0) + b.v) * case when doc_id % 7 = 0 then 0.5 else 1 end, 6)::double score from b left join s using (q, doc_id))
        select q, "block", score, row_number() over (partition by q order by score desc, "block")::int "rank" from z where score > 0 qualify "rank" <= 3""",
    "question_flags": f"""with n as (select doc_id, coalesce(lang, '') l, {_FOLD.format(c="text")} n from documents), o as (select *, trim(l || ' ' || n) own from n)
        select doc_id, contains(n, 'tion') asks_overview, contains(n, 'the ') asks_diagnostic, contains(n, ' in ') asks_structural, contains(n, ' of ') asks_negation, contains(n, 'and') asks_geometry, contains(n, 'that') asks_limits,
          contains(own, 'ing') and not contains(own, 'zzz') is_structural, contains(own, 'er') is_negated, not contains(own, 'xx') or contains(own, 'and') is_geometric, false is_safe, contains('ERR-' || doc_id, '-1') is_limits, false is_overview from o""",
    "rule_table": rf"""with w as (select distinct r from (select unnest(string_split({_FOLD.format(c="text")}, ' ')) r from benchmark) where length(r) >= 4),
        p as (select u.conv_id, u.turn, u.text q, a.text a from conversations u join conversations a on u.conv_id = a.conv_id and u.role = 'user' and a.role = 'assistant' and a.turn = u.turn + 1),
        m as (select conv_id, turn, r, length(r) % 3 k, row_number() over (partition by conv_id, turn order by length(r) desc, r) o from p join w on regexp_matches(q, '(?i) ' || r || '[a-z]*[ .,]')),
        g as (select conv_id, turn, 'See ' || (arg_min(r, o) filter (k = 0)) x, list('See ' || r order by o) filter (k = 1) y, list('See ' || r order by o) filter (k = 2) z from m group by 1, 2)
        select conv_id, turn, array_to_string(list_concat(list_concat(case when coalesce(x, a) is null then [] else [coalesce(x, a)] end, coalesce(y, [])), coalesce(z, [])), chr(10) || chr(10)) answer from p left join g using (conv_id, turn)""",
    "expectation_table": rf"""with r as (select item_id, ['en', 'fr', 'de'][item_id % 3 + 1] l, (item_id % 10)::varchar h, ({_WORDS.format(c=_NORM.format(c="coalesce(text, '')"))})[1:2] w from benchmark)
        select item_id "rule", count(*) n, sum(coalesce(len(list_filter(w, lambda x: not contains(lower(text), x))) = 0, false)::int)::bigint held from r join documents on l = lang and starts_with(doc_id::varchar, h) group by 1""",
    "answer_by_route": rf"""with u as (select conv_id, turn, text, lower(coalesce(text, '')) low, {_NORM.format(c="lower(coalesce(text, ''))")} n from conversations where role = 'user'),
        c as (select *, case when not regexp_matches(low, '\S') then 'blank' when {" or ".join(f"contains(low, '{t}')" for t in ROUTES[0][1])} then 'c' when {" or ".join(f"contains(low, '{t}')" for t in ROUTES[1][1])} then 's' else 't' end r from u),
        i as (select min(doc_id) item, lower(lang) a, lower(split_part(source, 'c', 1)) b, concat_ws(' ', source, lang) name from documents group by lang, source),
        h as (select conv_id, turn, item, name, coalesce((a <> '' and contains(n, a))::int, 0) + coalesce((b <> '' and contains(n, b))::int, 0) hits from c, i where r = 'c'),
        f as (select * from h where hits > 0 qualify row_number() over (partition by conv_id, turn order by hits desc, item) = 1),
        t as (select conv_id, turn, list_distinct({_WORDS.format(c="n")}) t from c where r = 't'), k as (select doc_id, list_distinct({_WORDS.format(c=_NORM.format(c="coalesce(text, '')"))}) t from documents),
        o as (select conv_id, turn, doc_id, count(*) / any_value(nq)::double s from (select conv_id, turn, len(t) nq, unnest(t) w from t) join (select doc_id, unnest(t) w from k) using (w) group by 1, 2, 3),
        b as (select * from o where s >= 0.18 qualify row_number() over (partition by conv_id, turn order by s desc, doc_id) = 1)
        select conv_id, turn, case r when 'c' then case when item is null then 'Ask the office.' when item % 2 = 0 and name <> '' then name else 'Item ' || item end when 's' then '{provider.UNAVAILABLE}' || chr(10) || chr(10) || repeat('─', 40) || chr(10) || chr(10) || '{provider.UNAVAILABLE}' when 't' then '{provider.UNAVAILABLE}' end answer,
          case r when 'c' then case when item is null then '{answering.NO_LOCAL}' else '{answering.LOCAL}' end when 's' then '{answering.TWO_PASS}' when 't' then '{answering.ENGINE}' else '{answering.EMPTY}' end source, item, doc_id "block"
        from c left join f using (conv_id, turn) left join b using (conv_id, turn)""",
    "folder_parts": "select source, doc_id, '### FILE: ' || doc_id || ' ###' || chr(10) || coalesce(text, '') part from documents",
    "lookup_product": rf"""with u as (select distinct unnest([concat_ws(' ', 'need', p_name, p_size), upper(p_name)]) q from part), q as (select q, regexp_replace(lower(q), '[^\p{{L}}\p{{N}}]+', '', 'g') same, list_distinct({_WORDS.format(c=_NORM.format(c="q"))}) t from u),
        n as (select min(p_partkey) p_partkey, p_name, regexp_replace(lower(p_name), '[^\p{{L}}\p{{N}}]+', '', 'g') same, list_distinct({_WORDS.format(c=_NORM.format(c="p_name"))}) w from part group by p_name),
        s as (select q, p_partkey, q.same = n.same exact, len(list_intersect(t, w)) hits, list_has_any(t, ['small', 'red']) coded, len(list_filter(t, lambda x: regexp_full_match(x, '\p{{Nd}}+'))) > 0 num,
            starts_with(lower(p_name), 'small') or starts_with(lower(p_name), 'red') fam from q, n)
        select q, p_partkey, exact, case when not exact then (hits + case when coded and num then 0.5 else 0 end + case when coded and fam then 0.25 else 0 end)::double end score from s where exact or hits > 0 or coded and (num or fam)
        qualify row_number() over (partition by q order by exact desc, score desc, p_partkey) = 1""",
    "product_note": """select p_partkey, concat_ws(chr(10), p_name, 'size: ' || p_size, printf('price: %.2f', p_retailprice), 'brand: ' || nullif(p_brand, ''), case when p_type in ('ECONOMY', 'SMALL') then 'can be rented' end) note from part""",
    "enrich_answer": """with n as (select p_partkey, concat_ws(chr(10), p_name, 'size: ' || p_size, printf('price: %.2f', p_retailprice), 'brand: ' || nullif(p_brand, ''), case when p_type in ('ECONOMY', 'SMALL') then 'can be rented' end) note from part)
        select concat_ws(chr(10) || chr(10), 'line ' || l_linenumber, note) answer, count(*) n from lineitem left join n on l_partkey = p_partkey group by 1""",
    "enrich_rules": f"""select item_id, concat_ws(chr(10) || chr(10), 'Answer:', nullif(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), ''), concat_ws(chr(10), case when {_HAS("the")} then 'On the.' end, case when {_HAS("que")} then 'Sobre que.' end,
          case when {_HAS("the")} or {_HAS("der")} then 'Article.' end, case when {_HAS("the")} and {_HAS("that")} then 'Both.' end, 'Always.'), 'End.') answer from (select item_id, text, string_split({_FOLD.format(c="text")}, ' ') t from benchmark)""",
    "regex_rules": rf"""select u.conv_id, u.turn, concat_ws(chr(10) || chr(10), case when {_word('lower(u.text)', 'que')} then 'Reemplazado.' when regexp_matches(u.text, '(?i)^re($|[^\p{{L}}\p{{N}}_])') then 'Replaced.' else a.text end,
          case when {_word('lower(u.text)', 'the')} then 'More on it.' end, case when ends_with(u.text, '?') then 'P.S.' end) answer
        from conversations u join conversations a on u.conv_id = a.conv_id and u.role = 'user' and a.role = 'assistant' and a.turn = u.turn + 1""",
    "expected_patterns": """select doc_id, rule, coalesce(ok, false) ok from (select doc_id, 0 rule, contains(text, 'the') and contains(text, 'an') ok from documents where lang = 'en' and starts_with(doc_id::varchar, '1')
        union all select doc_id, 1, contains(text, 'le') from documents where lang = 'fr' union all select doc_id, 2, contains(text, 'zzz') from documents where lang = 'en' and starts_with(doc_id::varchar, '12'))""",
    "render_template": "select item_id, 'Question: ' || coalesce(text, '') || chr(10) || 'Context: ' || concat_ws(', ', 'item: ' || item_id, 'length: ' || length(text)) || chr(10) || 'Answer:' prompt from benchmark",
    "context_string": "select p_partkey, concat_ws(', ', 'brand: ' || nullif(p_brand, ''), 'type: ' || nullif(nullif(p_type, 'SMALL'), ''), 'size: ' || p_size) context from part",
    "offline_answers": f"select conv_id, turn, '{provider.UNAVAILABLE}' reply from conversations where role = 'user'",
}
_RANKS = r"""{n}w as (select k, w, count(*) c from (select k, unnest(list_filter(string_split_regex(lower(coalesce(t, '')), '[^\p{{L}}]+'), lambda w: w <> '')) w from {n}t) group by 1, 2),
    {n}g as (select k, g, sum(c) c from (select k, c, unnest(list_filter(flatten([[('_' || w || '_')[i : i + n - 1] for i in range(1, length(w) + 4 - n)] for n in [1, 2, 3]]), lambda g: g <> '_')) g from {n}w) group by 1, 2),
    {n} as (select k, g, row_number() over (partition by k order by c desc, g) - 1 r from {n}g qualify r < 300)"""
_DETECTED = f"""lt as (select lang k, text t from documents where lang is not null), {_RANKS.format(n="l")}, qt as (select {{c_id: conv_id, t_id: turn}} k, text t from conversations), {_RANKS.format(n="q")},
    z as (select k, count(*) m from q group by 1), o as (select q.k, l.k lang, sum(abs(q.r - l.r) - 300) s from q join l on q.g = l.g group by 1, 2),
    found as (select k.c_id conv_id, k.t_id turn, lang, (s + m * 300)::bigint distance from o join z using (k) qualify row_number() over (partition by k order by s, lang) = 1)"""
SQL["detected_languages"] = f"with {_DETECTED} select * from found"
_ECHO = lambda t: f"(length({t}) || ': ' || right({t}, 20))"
SQL["engine_answers"] = f"""with {_DETECTED}, u as (select conv_id, turn, text, coalesce(lang, 'en') lang from conversations left join found using (conv_id, turn) where role = 'user'),
    v as (select *, case when lang = 'en' then text else {_ECHO("(lang || '>en:' || text)")} end q from u), a as (select *, {_ECHO("('none' || chr(10) || q)")} a from v)
    select conv_id, turn, case when text is null then '{provider.UNAVAILABLE}' when lang = 'en' then a else {_ECHO("('en>' || lang || ':' || a)")} end reply from a"""
SQL["stream_answers"] = SQL["answer_by_route"]
_SCORED = SQL["block_score_top3"].split("z as (")[0]
_KILLS = " or ".join([*(f"contains(upper(id), '{t}')" for t in OWN_TERMS.killer_ids), *(f"contains(fu, '{t}')" for t in OWN_TERMS.killer)])
#: Five stages in turn: each narrows a question's candidates if it asks for it and any stays.
_STAGES = ", ".join(f"c{i + 1} as (select * exclude g from (select *, max({keep}) over (partition by q) g from c{i}) where not (asks_{ask} and g) or {keep})" for i, (ask, keep) in enumerate((("s", "is_s"), ("n", "is_n"), ("g", "is_g"), ("d", "is_safe"))))
SQL["answer_by_blocks"] = f"""{_SCORED} z as (select q, doc_id, (coalesce(s.v, 0) + b.v) * case when doc_id % 7 = 0 then 0.5 else 1 end score from b left join s using (q, doc_id)),
    e as (select doc_id, lang, source, case when doc_id % 7 = 0 then 'OVERVIEW' when doc_id % 5 = 0 then 'KILLER' else 'ITEM' end || '-' || doc_id id, string_split(coalesce(text, ''), chr(10))[1] || ' ' || replace(coalesce(text, ''), chr(10), ' ') told from documents),
    m as (select *, {_FOLD.format(c="told")} own, {_FOLD.format(c="id || ' ' || told")} nm, {_FOLD.format(c="concat_ws(' ', id, told, lang)")} fu from e),
    y as (select *, contains(own, 'ing') and not contains(own, 'zzz') is_s, contains(own, 'er') is_n, not contains(nm, 'xx') or contains(nm, 'and') is_g, not ({_KILLS}) is_safe, contains(upper(id), '-1') is_l from m),
    x as (select *, contains(n, 'tion') asks_o, contains(n, 'the ') asks_d, contains(n, ' in ') asks_s, contains(n, ' of ') asks_n, contains(n, 'and') asks_g, contains(n, 'that') asks_l from q),
    v as (select x.q, y.*, score, asks_d, asks_s, asks_n, asks_g, asks_l, unnest(case when source = 'src0' then [0] when doc_id % 7 = 0 and asks_o then [1, 2] else [2] end) tier from z join y using (doc_id) join x on x.q = z.q where score > 0),
    c0 as (select * from (select * from v qualify tier = min(tier) over (partition by q)) qualify row_number() over (partition by q order by score desc, doc_id) <= 15), {_STAGES},
    w as (select * from c4 qualify row_number() over (partition by q order by (asks_l and is_l) desc, score desc, doc_id) = 1)
    select q.q, w.q is not null ok, case when w.q is not null and coalesce(lang in ('fr', 'en'), false) then 'See ' || doc_id else 'No answer.' end answer, lang family, id, 'gold' "mode", 'fr' "lang", round(coalesce(score, 0), 6)::double score from q left join w on w.q = q.q"""
_STOPPED = r"trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce({c}, ''))), '[^a-z0-9\s_-]', ' ', 'g'), '\s+', ' ', 'g'))"
_SEARCHED = lambda name, toks, where="true", text="n": _hybrid_sql(name, toks, where, text).replace("count(*) hits", "count(*) filter (list_contains(ws, w)) hits").replace("join df using (w)", "join df using (w) join (select doc_id, ws from k) using (doc_id)")
#: Tags and free lines, and numbered lines of pairs, as txt_texts and txt_parse have them.
_TAGGED = TEXTS_SQL["txt_texts"].removeprefix("with ").split("select conv_id doc,")[0].strip()
_PAIRED = "kk as (" + TEXTS_SQL["txt_parse"].split(" k as (", 1)[1].split("select conv_id doc")[0].strip().replace("g as (", "gg as (").replace("from k)", "from kk)")
_CORPUS = "tf as" + _BASE.split("tf as", 1)[1]
SQL["answer_by_search"] = rf"""with {_TAGGED}, {_PAIRED},
    pp as (select conv_id, n, max(regexp_replace(s, '^\s+|\s+$', '', 'g')) filter (q) qu, coalesce(regexp_replace(string_agg(s, chr(10) order by turn, i) filter (not q), '^\s+|\s+$', '', 'g'), '') an from gg where n > 0 and not t group by 1, 2),
    said as (select conv_id, string_agg({_STOPPED.format(c="qu")} || ' ' || {_STOPPED.format(c="an")}, ' ' order by n) said from pp group by 1),
    tl as (select conv_id, list({_FOLD.format(c="t")} order by turn, k) tags from t where t <> '' group by 1),
    k as (select conv_id doc_id, {_FOLD.format(c="x")} n, {_WORDS.format(c=f"concat_ws(' ', {_FOLD.format(c='x')}, said)")} t, {_WORDS.format(c=_FOLD.format(c="x"))} ws, conv_id::varchar name, coalesce(tags, []) tags, x body from x left join said using (conv_id) left join tl using (conv_id) where length(x) >= 500 or said is not null),
    q0 as (select item_id, n, {_WORDS.format(c="n")} t from (select item_id, {_STOPPED.format(c="text")} n from benchmark)),
    {_CORPUS}, {_SEARCHED("e", _EXPANDED, text=f"array_to_string({_EXPANDED}, ' ')")}, ef as (select * from e where score >= {THRESHOLD}), {_SEARCHED("h", "t", "item_id not in (select item_id from ef)")},
    top as (select * from ef union all select * from h),
    c as (select item_id, doc_id, top.score, q0.n base, pp.n pn, trim(qu) matched, regexp_replace(coalesce(an, ''), '^\s+|\s+$', '', 'g') a, k.body, {_FOLD.format(c="qu")} f from top join q0 using (item_id) join k using (doc_id) left join pp on conv_id = doc_id),
    w as (select *, case when a <> '' then a else regexp_replace(split_part(body, chr(10) || chr(10), 1), '^\s+|\s+$', '', 'g') end b from c
      qualify row_number() over (partition by item_id order by case when f is null then -1 when f = '' or base = '' then 0 when base = f then 1 when contains(base, f) or contains(f, base) then 0.5 else 0 end desc, pn) = 1),
    v as (select *, case when length(b) <= 1200 then b else regexp_replace(coalesce(nullif(regexp_extract(b[1:1200], '(?s)^(.+?[.!?])(?:\s|$)', 1), ''), b[1:1200]), '\s+$', '') || ' …' end answer from w),
    y as (select item_id, t from (select item_id, string_split({_STOPPED.format(c="text")}, ' ') t from benchmark))
    select item_id q, concat_ws(chr(10) || chr(10), 'Answer:', answer, concat_ws(chr(10), case when {_HAS("the")} then 'On the.' end, case when {_HAS("que")} then 'Sobre que.' end,
      case when {_HAS("the")} or {_HAS("der")} then 'Article.' end, case when {_HAS("the")} and {_HAS("that")} then 'Both.' end, 'Always.')) answer, true found, round(score, 3) score, doc_id doc, case when a <> '' then matched end matched from v join y using (item_id)"""
