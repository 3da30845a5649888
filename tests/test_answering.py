"""The three ways of answering and their parts, by cases worked out by hand."""

from pyspark.sql import functions as F

from lexmill import catalog_answers
from lexmill.functions import text as X
from lexmill.operators import merge, products, scoring
from lexmill.plans import answering, predicates, provider, routing, rules
from lexmill.sources import knowledge, tagged
from lexmill.sources.html import html_text


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(col).first()[0]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


LINES = ["[TAGS : Price, , Re-sale]", "lead in", "D : First question? ", "R: yes", "more", "", "[tags: x]", "risposta : and", "DOMANDA: second?", "r: no ", "────", "D:", "end"]


def lines(spark, doc="f", text=LINES):
    return tagged.lines_of(spark.createDataFrame([(doc, "\n".join(text)), ("none", None)], "d string, t string"), "d", "t")


def test_tagged_texts(spark):
    df = lines(spark)
    assert rows(tagged.parse_pairs(df)) == [("f", 1, "First question?", "yes\nmore\n\nand"), ("f", 2, "second?", "no \n────"), ("f", 3, "", "end")]
    got = tagged.parse_texts(df, X.normalize_folded).first()
    assert got["tags"] == ["Price", "Re-sale", "x"] and got["norm_tags"] == ["price", "re sale", "x"]
    assert got["text"] == "lead in\nmore\n\n────\nend" and got["norm"] == "lead in more end"
    assert tagged.index(df, X.normalize_folded).count() == 1
    assert tagged.index(lines(spark, text=["short"]), X.normalize_folded).count() == 0
    assert tagged.index(lines(spark, text=["x" * 500]), X.normalize_folded).first()["qas"] == []


def test_texts(spark):
    assert one(spark, X.clamp(F.col("t"), 10), t=". Abc def ghi") == ". Abc def …"  # a sentence has a sign before its end
    assert one(spark, X.clamp(F.col("t"), 8), t="One two\t\n more") == "One two …"
    assert one(spark, X.strip_label(F.col("t")), t=" risposta : a R: b ") == "a R: b"
    assert one(spark, X.strip_labels(F.col("t")), t="D: a\nR : b\nc") == "a\nb\nc"
    assert one(spark, X.first_paragraph(F.col("t")), t=" a\nb \n\nc") == "a\nb"
    assert one(spark, X.tokens_of_name(F.col("t")), t="CTX 12/40_a-b") == ["ctx", "12", "40_a", "b"]
    assert one(spark, X.split_words(X.normalize_folded(F.col("t"))), t="?") == [""]
    assert one(spark, X.normalize_folded(F.col("t"), X.fold_exact), t="ﬁne²É") == "fine2e"
    assert one(spark, F.to_json(X.counted(F.split("t", " "))), t="b a b") == '[{"token":"a","f":1},{"token":"b","f":2}]'


def test_references(spark):
    assert one(spark, html_text(F.col("t")), t="<p>&#39;&#x41;&#128512; &#xD800; &#; &amp;#65; &lt;b&gt;</p>") == "'A😀 &#xD800; &#; &#65; <b>"
    assert one(spark, html_text(F.col("t")), t=None) is None


def test_empty_keys_are_dropped(spark):
    a = spark.createDataFrame([("", "x", 0), ("1", "y", 1), (None, "z", 2)], "id string, v string, p int")
    assert rows(merge.merge_layers([a], "id", "p").select("id", "v")) == [("1", "y")]


def test_products_by_code_alone(spark):
    p = spark.createDataFrame([(1, "blue nut"), (2, "ctx 12"), (3, "ctx 14")], "k int, n string")
    q = spark.createDataFrame([("vcx 99",), ("vcx",), ("ctx 14",), ("none 99",)], "q string")
    got = rows(products.lookup(q, p, "q", "q", "k", "n", ("vcx", "ctx"), ("ctx",)))
    assert got == [("ctx 14", 3, True, None), ("vcx 99", 2, False, 0.75), ("vcx", 2, False, 0.25)]
    got = rows(products.lookup(q, p, "q", "q", "k", "n", ("vcx",), ("zzz",)))
    assert got == [("ctx 14", 3, True, None), ("vcx 99", 1, False, 0.5)]


def test_enrichment(spark):
    topics, given = {"Prèzzo": "Ask the office.", "two words": "never"}, [{"if_any": ["Bolt", "nut"], "add": "Any."}, {"if_all": ["bolt", "nut"], "add": "All."}, {"add": " "}]
    e = lambda q: one(spark, rules.enrich_by_topic(F.col("q"), F.lit(" Answer. "), topics, given, "P", "S"), q=q)
    assert e("PREZZO two words bolt?") == "P\n\nAnswer.\n\nAsk the office.\nAny.\n\nS"
    assert e("nut bolt") == "P\n\nAnswer.\n\nAny.\nAll.\n\nS" and e(None) == "P\n\nAnswer.\n\nS"


def test_guard_notes(spark):
    given = [{"when_any": [r"\bctx\b"], "unless_any": ["price"], "require": ["nail", "sheet"], "require_note": "N1", "forbid": ["glue"], "forbid_note": "N2"}, {"when": ("ctx",), "ensure": ["a", "b"], "ensure_note": ""}]
    g = lambda q, a: one(spark, routing.guard(F.col("q"), F.col("a"), given), q=q, a=a)
    assert g("CTX?", "a nail") == "a nail\nN1" and g("ctx", "nail, sheet, glue") == "nail, sheet, glue\nN2"
    assert g("ctx price", "x") == "x" and g("none", "glue") == "glue"


def test_slots_from_replies(spark):
    s = lambda raw: tuple(one(spark, routing.slots(F.col("raw"), ["size", "cover"], {"cover": "25", "note": ""}), raw=raw))
    assert s('{"status": "READY", "found": {"size": 5}}') == ("OK", {"size": "5"}, "", None, None)
    assert s('{"status": "MISSING", "found": {"a": "1"}, "needed_fields": ["cover", "fire"]}') == ("OK", {"a": "1", "cover": "25"}, "", None, None)
    got = s('{"status": "MISSING", "needed_fields": ["size", "note", "cover"], "followup_question": "Size?"}')
    assert got == ("ASK_CLIENT", {"cover": "25"}, "note,size", "Size?", None)
    assert s('{"status": "MISSING", "needed_fields": ["size"]}')[3] == "More details are needed."
    assert s("Sorry, no" + "x" * 3000)[::4] == ("ERROR", ("Sorry, no" + "x" * 3000)[:2000]) and s(None)[0] == "ERROR" and s('{"status": "READY"}')[0] == "ERROR"


def test_gates(spark):
    q = spark.createDataFrame([(1, " a ", "GOLD"), (2, " \n\t", "gold"), (3, None, None), (4, "b", "x")], "q int, text string, mode string")
    good, blank = routing.checked(q, "text")
    assert [r["q"] for r in good.orderBy("q").collect()] == [1, 4] and blank.count() == 2
    wanted, other = routing.gated(q, "mode")
    assert [r["q"] for r in wanted.orderBy("q").collect()] == [1, 2] and other.count() == 2


BLOCKS = "block int, overlay boolean, place int, id string, family string, question string, triggers array<string>, tags array<string>, answers map<string,string>"


def blocks(spark):
    a = lambda t: {"it": t}
    return spark.createDataFrame([
        (1, True, 1, "O-1", "f", "posa speciale", ["posa speciale urgente"], [], a("overlay")),
        (2, False, 2, "X-OVERVIEW", "f", "cos e il bullone", ["bullone base"], [], a("overview")),
        (3, False, 3, "X-ERR", "f", "bullone errore", ["bullone con errore di posa"], [], a("killer")),
        (4, False, 4, "X-OK", "f", "verifica bullone", ["verifica del bullone"], ["t"], {"it": "", "en": "check"}),
        (5, False, 5, "X-LIMITI-APPLICAZIONE-1", "f", "limiti bullone", ["limiti bullone"], [], a("limits")),
    ], BLOCKS)


def test_block_scores(spark):
    q = spark.createDataFrame([(1, "verifica del bullone")], "q int, norm string")
    got = {r["block"]: round(r["score"], 6) for r in answering.block_scores(q, blocks(spark)).collect()}
    # 4: all words 3 + share 1 + substring 0.5, and both own words 3; 3: 1 of 5 words is too few, half the own question;
    # 2: half the words 0.5 and 3 * 1/4, halved; 5: as 2 but 3 * 1/2
    assert got == {4: 7.5, 3: 1.5, 2: round((0.5 + 0.75) / 2, 6), 5: 2.0}


def test_by_blocks(spark):
    terms = predicates.Terms(limits=("quando non usare",))
    asked = {1: "come verifico il bullone?", 2: "Cos'è il bullone", 3: "posa speciale", 4: "bullone, quando non usare", 5: "zzz", 6: "bullone non posso", 7: " "}
    q = spark.createDataFrame(list(asked.items()), "q int, text string")
    out = {r["q"]: r for r in answering.by_blocks(q, blocks(spark), "none", terms).collect()}
    assert set(out) == set(range(1, 7))
    assert out[3]["id"] == "O-1" and out[2]["id"] == "X-OVERVIEW" and out[2]["answer"] == "overview"
    assert out[4]["id"] == "X-LIMITI-APPLICAZIONE-1" and out[6]["id"] == "X-ERR"
    assert (out[5]["ok"], out[5]["answer"], out[5]["score"]) == (False, "none", 0.0)
    assert out[1]["id"] not in ("X-ERR", "X-LIMITI-APPLICAZIONE-1")
    named = answering.by_blocks(q.where("q = 6"), blocks(spark), "none", predicates.Terms(negation=()), call=lambda ps: ["X-OK"] * len(ps), lang="en").first()
    assert (named["id"], named["answer"], named["lang"]) == ("X-OK", "check", "en")


def test_by_route(spark):
    routes = [("commercial", ("price",)), ("situational", ("site",))]
    q = spark.createDataFrame([(1, "price of Red-Bolt"), (2, "price of zinc"), (3, "on site"), (4, "lay the bolt now"), (5, "")], "q int, text string")
    items = spark.createDataFrame([("a", ["red", "bolt"], 1, {"gold": {"it": ""}}, "", "old"), ("b", ["red"], 0, None, None, "b")], "item string, tags array<string>, place int, variants map<string,map<string,string>>, answer_lang string, answer string")
    kb = spark.createDataFrame([(7, 1, "lay bolt"), (8, 2, "lay the bolt"), (9, 3, "zzz")], "block int, place int, text string")
    out = {r["q"]: tuple(r)[1:] for r in answering.by_route(q, kb, items, routes, "ask us", "{question}", "{analysis}", call=lambda ps: [p.upper() for p in ps]).collect()}
    assert out[1] == ("old", "items", "a", None) and out[2] == ("ask us", "items_fallback", None, None)
    assert out[3] == ("ON SITE\n\n" + "─" * 40 + "\n\nON SITE", "two_pass", None, None)
    assert out[4] == ("LAY THE BOLT NOW", "engine", None, 8) and out[5] == (None, "empty", None, None)


def test_by_search(spark):
    docs = tagged.index(lines(spark).unionByName(lines(spark, "g", ["Bolts are laid by hand. " * 30, "", "next"])).unionByName(lines(spark, "h", ["D: glue?", "R: no glue"])), X.normalize_folded).withColumn("name", F.col("doc")).withColumn("doc", F.ascii("doc"))
    q = spark.createDataFrame([(1, "second?"), (2, "adhesive"), (3, "laid bolts"), (4, "qqq")], "q int, text string")
    out = {r["q"]: r for r in answering.by_search(q, docs, {"glue": ["adhesive"]}, {"prefix": "P", "topics": {"laid": "T"}}, limit=40).collect()}
    assert (out[1]["doc"], out[1]["answer"], out[1]["matched"]) == (ord("f"), "P\n\nno \n────", "second?")
    assert (out[2]["doc"], out[2]["answer"]) == (ord("h"), "P\n\nno glue")
    assert out[3]["answer"] == "P\n\nBolts are laid by hand. …\n\nT" and out[3]["matched"] is None
    assert out[4]["found"] and out[4]["score"] == 0.0  # a second chance takes its best, whatever it scores


def test_engine_steps(spark):
    q = spark.createDataFrame([(1, "ciao", "it", "C"), (2, "hello", "en", "C"), (3, None, "it", "C")], "q int, t string, l string, c string")
    turn = lambda ps: [None if p is None or p.endswith(":") else p.upper() for p in ps]
    out = {r["q"]: r["reply"] for r in provider.translated(q, "t", "c", "{context} {question}", F.col("l"), turn, lambda ps: [f"<{p}>" for p in ps]).collect()}
    assert out == {1: "EN>IT:<C IT>EN:CIAO>", 2: "<C hello>", 3: provider.UNAVAILABLE}

    def broken(ps):
        raise OSError("no route")

    got = provider.ask(q, "t", call=broken).collect()
    assert {r["reply"] for r in got} == {provider.UNAVAILABLE} and {r["reply_error"] for r in got} == {"OSError: no route"}
    assert "MapInPandas" not in provider.ask(q, "t")._jdf.queryExecution().toString()
    local = provider.local_then_engine(q.withColumn("own", F.when(F.col("q") == 1, "here")), "own", "t", lambda ps: ["asked"] * len(ps))
    assert {r["q"]: r["reply"] for r in local.collect()} == {1: "here", 2: "asked", 3: "asked"}


def test_knowledge_base(spark, tmp_path):
    (tmp_path / "over").mkdir()
    (tmp_path / "base.json").write_text('{"items": [{"id": "b", "v": "1"}, {"id": "a", "v": "1"}, {"id": "", "v": "1"}, {"id": "a", "v": "2"}]}')
    (tmp_path / "over" / "1.json").write_text('[{"id": "a", "v": "3"}, {"id": "c", "v": "3"}]')
    (tmp_path / "over" / "2.json").write_text('{"items": [{"id": "c", "v": "4"}]}')
    (tmp_path / "over" / "3.json").write_text("{")
    got = knowledge.overlaid(spark, str(tmp_path / "base.json"), str(tmp_path / "over" / "*.json"), "id string, v string")
    assert [tuple(r) for r in got.collect()] == [("a", "3"), ("b", "1"), ("c", "4")]
    knowledge.write_items(got, str(tmp_path / "out"))
    assert rows(spark.read.json(str(tmp_path / "out")).select("id", "v")) == [("a", "3"), ("b", "1"), ("c", "4")]
    kb = knowledge.Knowledge(spark, str(tmp_path / "over" / "*.json"), "id string, v string")
    first = kb.items()
    assert first.count() == 3 and kb.items() is first and kb.stats().count() == 2
    (tmp_path / "over" / "4.json").write_text('[{"id": "z"}]')
    assert kb.items().count() == 4 and kb.reload().count() == 4
    (tmp_path / "e.json").write_text('{"topics": {"a": "A"}, "rules": [{"if_any": ["x"], "add": "y"}], "prefix": "p"}')
    e = knowledge.read_enrichment(spark, str(tmp_path / "e.json"))
    assert e["topics"] == {"a": "A"} and e["rules"][0]["if_any"] == ["x"] and (e["prefix"], e["suffix"]) == ("p", "")
    assert knowledge.read_enrichment(spark, str(tmp_path / "none.json"))["rules"] == []
    spark.conf.set("lexmill.k", "3")
    assert knowledge.Settings.of(spark, {"k": "top_k"}) == knowledge.Settings(top_k=3)
    assert one(spark, knowledge.stem(F.col("n")), n="/a/B.c.TXT") == "b.c"


def test_unmatched_questions_have_a_row(spark):
    q = spark.createDataFrame([(1, "src9", ["src9"]), (2, "", [])], "q int, norm string, toks array<string>")
    d = spark.createDataFrame([(5, "a b", ["a", "b"], "src1", ["en"]), (4, "c", ["c"], "src9", [""])], "d int, norm string, toks array<string>, name string, tags array<string>")
    got = rows(scoring.unmatched(q, d, scoring.hybrid(q, d, "q", "d"), "q", "d"))
    assert got == [(1, 4, 0.12), (2, 5, 0.2)]


def test_word_ends_of_all_alphabets(spark):
    good, bad = rules.usable(spark, catalog_answers.PATTERNS)
    said = lambda q: one(spark, rules.answer_by_pattern(F.col("q"), F.lit("old"), good), q=q)
    assert len(bad) == 1 and said("équequeou") == "old" and said("a que b") == "Reemplazado." and said("so?\n") == "old"
