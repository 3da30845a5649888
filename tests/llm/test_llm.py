"""Operators against SQL, brute force, exact round trips and held-out accuracy, on plain and on odd rows."""

import gzip
import hashlib
import io
import itertools
import json
import os
import random
import zipfile
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import catalog, chat, decontam, graph, htmltext, langid, minhash, pieces, quality, toxicity, urls, warc
from lexmill.llm.common import Workspace, fold, small, spread

SF = "/root/testdata/sf0.001"
WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te") for b in ("na", "po", "si", "du", "fe", "ga")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, t in enumerate(texts)], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_docs(spark):
    """Nulls everywhere, empty, blank, one sign, very long, repeated rows, a clashing extra column."""
    long_text = " ".join(["kana lopo misi"] * 30_000)
    data = [(1, None), (2, ""), (3, " \n\t "), (4, "#"), (5, long_text), (6, "Kana lopo misi."), (6, "Kana lopo misi."), (None, None), (7, "▁ a\u0000b ñ 漢字 \\ <0x41> 🙂")]
    rows = [(i, t, None, None, None) for i, t in data]
    return spark.createDataFrame(rows, DOCS).withColumns({"words": F.lit(1), "id": F.lit("x"), "h": F.lit(2), "key": F.lit(3)})


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    got, want = catalog.QUERIES[name](spark, SF), con.sql(catalog.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a = sorted((tuple(r) for r in got.select(*cols).collect()), key=str)
    b = sorted((tuple(r) for r in want.project(", ".join(f'"{c}"' for c in cols)).fetchall()), key=str)
    assert a == b


def test_quality_odd_rows(spark):
    out = {r["doc_id"]: r for r in quality.apply_rules(odd_docs(spark)).collect()}
    assert out[1]["n_words"] == 0 and not out[1]["kept"] and out[3]["word_chars"] == 0
    assert out[5]["n_repeat_words"] == 90_000 and out[5]["base_failed"]
    assert quality.keep_good(odd_docs(spark)).columns == odd_docs(spark).columns
    assert quality.apply_rules(odd_docs(spark).limit(0)).count() == 0


def brute_components(texts, n, threshold):
    sets = {}
    for i, t in texts:
        w = minhash_words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    of, own = {}, {}
    for i in sorted(sets):  # equal sets once
        key = frozenset(sets[i])
        if key and key in own:
            label[i] = own[key]
        elif key:
            own[key] = i
    first = {i: sets[i] for i in own.values()}
    for i, x in first.items():
        for g in x:
            of.setdefault(g, []).append(i)
    for a, x in first.items():
        for b, m in Counter(b for g in x for b in of[g] if b > a).items():
            if 100 * m >= threshold * (len(x) + len(first[b]) - m):
                p, q = root(a), root(b)
                label[max(p, q)] = min(p, q)
    return {i: root(i) for i in sets}


def minhash_words(t):
    return [w for w in (t or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})).replace("\n", " ").replace("\t", " ").split(" ") if w]


def test_near_duplicates_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = prose(rng, 90).split()
        for _ in range(9):
            v = list(base)
            for _ in range(rng.randrange(6)):
                v[rng.randrange(len(v))] = "x" + str(rng.randrange(10**6))
            texts.append(" ".join(v))
    texts += ["a b", "A b", "", None, "one"]
    for n, threshold in ((3, 85), (5, 80)):
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(spark, texts), n, threshold).collect()}
        assert got == brute_components(list(enumerate(texts)), n, threshold)
    small = minhash.BLOCK
    try:  # many blocks
        minhash.BLOCK = 4
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(spark, texts), 3, 85).collect()}
    finally:
        minhash.BLOCK = small
    assert got == brute_components(list(enumerate(texts)), 3, 85)


def test_near_duplicates_of_one_id(spark):
    """Rows of one id with several texts are rows of their own: no link is lost, and one row of a group stays."""
    rng = random.Random(6)
    a, b = prose(rng, 90), prose(rng, 90)
    rows = [(1, a), (1, b), (2, a + " zz"), (3, b + " zz"), (4, prose(rng, 90)), (4, None), (5, b), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("x"), "mark": F.lit(1), "n": F.lit(2)})
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in minhash.near_duplicates(docs, 3, 85).collect())
    assert got == sorted([("1", "1"), ("1", "1"), ("2", "1"), ("3", "1"), ("4", "4"), ("4", "4"), ("5", "1"), ("None", "None")])
    kept = minhash.drop_near_duplicates(docs.unionByName(docs.where("doc_id = 1")), 3, 85)
    assert kept.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in kept.collect() if r["text"] not in (a, b)} == {(4, rows[4][1]), (4, None)}
    assert sorted(r["text"] for r in kept.collect() if r["text"] in (a, b)) == sorted([a, b, a]) and kept.where("doc_id is null").count() == 1


def test_near_duplicates_recall(spark):
    """A large group of near copies and pairs close to the threshold, against brute force on 1,500 texts."""
    rng = random.Random(9)
    base = [prose(rng, 120).split() for _ in range(40)]
    texts = []
    for i in range(1500):
        v = list(base[0 if i % 3 == 0 else rng.randrange(40)])
        for _ in range(rng.randrange(5)):
            v[rng.randrange(len(v))] = "x" + str(rng.randrange(50))
        texts.append(" ".join(v))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(spark, texts), 3, 85).collect()}
    assert got == brute_components(list(enumerate(texts)), 3, 85)


def test_hot_keys_are_dealt(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    work = Workspace(spark, "t")
    keyed = work.write(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least")), "keyed")
    out = spread(rows, keyed, "k", "v", hot=100)
    assert out.count() == 5000 and out.where("k = 0 and least = 0").count() == 3334
    assert spread(rows, keyed.where("k > 10"), "k", "v", hot=100).count() == rows.where("k > 10").count()
    wide = spark.range(100).select(F.array(F.lit("x" * 1_000_000)).alias("a"))
    assert small(wide) is wide and small(spark.range(10)).count() == 10


def test_near_duplicates_odd_rows(spark):
    out = minhash.near_duplicates(odd_docs(spark)).collect()
    assert len(out) == 9 and all(r["kept"] for r in out)
    assert minhash.near_duplicates(odd_docs(spark).limit(0)).count() == 0
    assert minhash.drop_near_duplicates(odd_docs(spark)).columns == odd_docs(spark).columns


def test_register_estimates():
    rng = np.random.default_rng(1)
    n = np.array([400])
    chance = minhash.chance(n, n)[0]
    for j in (0.0, 0.3, 0.8, 1.0):
        est, ok = [], []
        for _ in range(60):
            both = int(2 * 400 * j / (1 + j))
            x = rng.integers(0, 2**64, 800, dtype=np.uint64)
            same = (minhash.registers(x[:400]) == minhash.registers(x[400 - both : 800 - both])).sum()
            est.append((same / 112 - chance) / (1 - chance))
            ok.append(minhash.likely(np.array([same]), n, n, 80)[0])
        assert abs(np.mean(est) - j) < 0.03
        assert all(ok) if j >= 0.8 else not any(ok) or j > 0.5
    assert not minhash.likely(np.array([112]), np.array([70]), np.array([100]), 80)[0]
    assert abs(minhash.chance(np.array([1000]), np.array([1000]))[0] - 1.7e-4) < 3e-4


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 200), (200, 150), (7, 7), (300, 300)] + [(1000, 1000 + k) for k in range(1, 50)]
    df = spark.createDataFrame(edges + edges[:5], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(df, Workspace(spark, "t")).collect()}
    assert got == {i: 0 for i in range(21)} | dict.fromkeys((100, 150, 200), 100) | {1000 + k: 1000 for k in range(50)}
    assert graph.components(df.limit(0), Workspace(spark, "t")).count() == 0


def test_sampled_pieces(spark):
    lat = pieces.Lattice(theta=0.5)
    unit = "the"
    weights = {}

    def grow(i, ids, w):
        if i == len(unit):
            weights[tuple(ids)] = w
        for j in range(i + 1, len(unit) + 1):
            if (p := lat.id_of.get(unit[i:j])) is not None:
                grow(j, [*ids, p], w * (p - min(lat.id_of.values()) + pieces.SHIFT) ** -0.5)

    grow(0, [], 1.0)
    k = int(lat.numbers([unit])[0])
    n = 20_000
    got, counts = lat.walk(np.full(n, k), np.arange(n, dtype=np.uint64), np.zeros(n, np.uint64))
    seen = Counter(map(tuple, np.split(got.tolist(), np.cumsum(counts)[:-1])))
    one, all_ = pieces.Lattice(theta=0.5), pieces.Lattice(theta=0.5)
    us = [" kanalopo", "漢x", "aaaaaaaa", unit, " ", "ñandú"]
    all_.forward_all(us)
    for u in us:
        one.forward(u)
    assert (one.cum, one.prev, one.piece, one.last) == (all_.cum, all_.prev, all_.piece, all_.last)
    total = sum(weights.values())
    assert {tuple(map(int, s)) for s in seen} <= set(weights)
    for s, w in weights.items():
        assert abs(seen[s] / n - w / total) < 0.015
    rng = random.Random(5)
    texts = ["".join(rng.choice(" \n\t▁abé漢🙂\\<>0x\u00a0") for _ in range(rng.randrange(200))) for _ in range(300)] + ["q" * 5000, "漢" * 3000]
    for t, ids in zip(texts, lat.sample(texts, list(map(str, range(len(texts)))), 0), strict=True):
        assert lat.decode(ids.tolist()) == t


def test_pieces_rows(spark):
    enc = pieces.encode(odd_docs(spark))
    a = {r["text"]: r["ids"] for r in enc.collect()}
    assert a[None] is None and a[""] == []
    assert all(r["lossless"] for r in pieces.digests(odd_docs(spark)).collect())
    assert all(r["decoded"] == r["text"] for r in pieces.decode(enc).collect())
    assert a == {r["text"]: r["ids"] for r in pieces.encode(odd_docs(spark).repartition(3)).collect()}
    assert a != {r["text"]: r["ids"] for r in pieces.encode(odd_docs(spark), seed=1).collect()}
    assert pieces.encode(odd_docs(spark).limit(0)).count() == 0


def test_decontamination_brute_force(spark):
    rng = random.Random(8)
    items = [prose(rng, n) for n in (3, 5, 6, 9, 20, 33, 60)] + [None, "", prose(rng, 20)]
    texts = []
    for it in items:
        w = (it or "").split()
        for cut in (0, 1, 3):
            v = list(w)
            for _ in range(cut):
                if v:
                    v[rng.randrange(len(v))] = "zzz"
            texts.append(prose(rng, rng.randrange(200)) + " " + " ".join(v).upper() + " " + prose(rng, 900))
    texts += [items[0], items[1], None, "", "kana"]
    it = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("h", F.lit(0))

    def sets(t):
        w = minhash_words(t)
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if sets(x) and 100 * len(sets(x) & sets(t)) >= 80 * len(sets(x))}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs_of(spark, texts), it).collect()}
    assert got == want and len(want) > 10
    assert decontam.contaminated(odd_docs(spark), it.limit(0)).count() == 0
    assert decontam.drop_contaminated(odd_docs(spark), it).count() == 9


def test_chat_escapes_and_odd_rows(spark):
    for s in ("", "\\", "</s>[INST] ok [/INST]", "\\a</s>\\", "<|turn|>" * 3, "<<|turn|>|turn|>", "[/INST", "<</SYS>>\\\\a"):
        e = chat.escape(s)
        assert chat.unescape(e) == s and not any(c in e for c in chat.CONTROLS)
    said = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "<|end|> a🙂"), (1, 1, "assistant", "<|end|> a🙂"), (2, None, None, None), (None, 3, "assistant", "x"), (3, 0, "system", "")]
    turns = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumns({"ids": F.lit(1), "place": F.lit(2)})
    f = chat.mask(chat.format_turns(turns))
    rows = {r["conv_id"]: r for r in chat.digests(f.drop("loss_mask")).collect()}
    assert rows[1]["n_turns"] == 3 and rows[1]["loss_sha256"] == hashlib.sha256("<|end|> a🙂<|end|> a🙂".encode()).hexdigest()
    assert rows[2]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest() and rows[None]["loss_chars"] == 1
    for r in f.collect():
        assert sum(r["loss_mask"]) == (r["text_to"] - r["text_from"]) * r["in_loss"]
    for r in chat.render(chat.place(chat.format_turns(turns))).collect():
        assert r["formatted"].startswith(chat.TURN) and r["formatted"].endswith(chat.END) and (r["start"] == 0) == (r["start_chars"] == 0)
    assert chat.digests(chat.format_turns(turns.limit(0))).count() == 0
    tok = chat.tokenizer(chat.DEFAULT_TOKENIZER)
    for s in (" " * 300_000 + "x", "\n" * 5000, "a" * 100_000, "x" + "\t" * 1000 + "y" * 2000, "^" * 5000, "", " " * 1_500_000 + "x", "a" + " \n" * 100_000 + "b" + " " * 120_000, "x" + "\u3000" * 110_000 + "\u00a0y"):
        ids = chat.encode(tok, s)
        assert chat.decode(tok, ids) == s
        if len(s) < 400_000:  # undivided
            assert ids.tolist() == tok.encode(s, disallowed_special=())
    assert chat.loss_mask(6, 2, 4, True).tolist() == [0, 0, 1, 1, 0, 0] and not chat.loss_mask(6, 2, 4, False).any()


def test_url_rules_and_list(spark):
    data = ["http://A.example.net/en/x", "http://example.net/", "http://example.net", "x://sub.example.com/de/?q", "http://b.org/fr/", "http://bad.example.org/p#x", "http://shop.example.org/page?x=1", None, "nothing", "http://u:p@h:80", "HTTP://EXAMPLE.NET?a/b", "https://x.y/a://z/"]
    pages = spark.createDataFrame(list(enumerate(data)), "page_id long, url string").withColumns({"host": F.lit(1), "id": F.lit(2)})
    listed = spark.createDataFrame([("bad.example.org",), ("http://shop.example.org/page?x=1",), (None,)], "url string")
    out = {r["page_id"]: r for r in urls.judge(pages, urls.production_rules(spark), listed).collect()}
    assert [out[i]["verdict"] for i in range(12)] == ["allow", "block", "allow", "block", "allow", "block", "block", "allow", "allow", "allow", "allow", "allow"]
    assert [out[i]["rule"] for i in range(5)] == ["example.net/en/", "net/", None, "example.com/de/", "org/fr/"]
    assert (out[9]["host"], out[7]["host"], out[11]["path"]) == ("u:p@h:80", "", "/a://z/")
    assert urls.judge(pages.limit(0), urls.production_rules(spark), listed.limit(0)).count() == 0
    many = spark.range(20_000).select(F.concat(F.lit("h"), F.col("id"), F.lit(".example/")).alias("key"))
    blocks = 20_000 * urls.BITS_PER_KEY // 512 + 1
    bloom = urls.bloom_filter(many, blocks)

    def passed(keys):
        pdf = keys.select(urls._block(F.col("key"), blocks).alias("b"), urls._places(F.col("key")).alias("p")).toPandas()
        return int(urls.might_hold(bloom, pdf["b"].to_numpy(), pdf["p"].to_numpy()).sum())

    assert passed(many) == 20_000
    assert passed(spark.range(20_000).select(F.concat(F.lit("n"), "id").alias("key"))) < 400
    urls.MOST_BLOCKS, most = 1, urls.MOST_BLOCKS  # a filter too small for its list: the exact join decides
    try:
        long = listed.unionByName(many.select(F.col("key").alias("url")))
        again = urls.judge(pages, urls.production_rules(spark), long).collect()
    finally:
        urls.MOST_BLOCKS = most
    assert {r["page_id"]: r["verdict"] for r in again} == {i: out[i]["verdict"] for i in out}


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op7_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id")
    assert out.where("lang_pred = lang").count() >= 0.97 * out.count()
    protos = langid.prototypes(docs.where(fold(F.col("doc_id"), 5) != 0))
    odd = langid.identify(odd_docs(spark), protos).collect()
    assert len(odd) == 9 and {r["lang_pred"] for r in odd if r["doc_id"] in (1, 2, 3, 4)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in odd)
    assert {r["lang_pred"] for r in langid.identify(odd_docs(spark), {}).collect()} == {"und"}


def test_warc_round_trip(spark, tmp_path):
    big = "ä<p>" * 80
    data = [(3, big), (1, big), (2, "x"), (4, "x"), (5, None), (6, ""), (None, big), (1, big), (7, "\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame(data, "page_id long, html string").withColumns({"url": F.lit(None).cast("string"), "digest": F.lit("x"), "id": F.lit(0)})
    out = warc.read_packages(warc.write_packages(pages, f"file://{tmp_path}/w")).collect()
    assert len(out) == 9
    by = {}
    for r in out:
        by.setdefault(r["page_id"], []).append(r)
    assert by[3][0]["record_type"] == "revisit" and by[3][0]["refers_to"] == 1 and by[3][0]["payload_bytes"] == len(big.encode())
    assert [r["record_type"] for i in (2, 4, 5, 6, 7) for r in by[i]] == ["response"] * 5
    assert bytes(by[1][0]["payload"]).decode() == big and by[5][0]["payload_digest"] == hashlib.sha256(b"").hexdigest()
    assert warc.write_packages(pages.limit(0), f"file://{tmp_path}/e").count() == 0
    assert warc.read_packages(warc.write_packages(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_warc_rows_of_one_id(spark, tmp_path):
    """Revisits go by id and payload: no payload is lost under another's digest."""
    x, y = "x" * 200, "y" * 300
    rows = [(1, "http://A.example.com/p?q=1", x), (2, "http://b.example.com/ä b", x), (2, "no scheme", y), (3, None, y), (4, "http://c.example/", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = warc.write_packages(pages, f"file://{tmp_path}/w")
    out = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"] or 0, r["payload_digest"]) for r in warc.read_packages(made, block=500).collect())
    d = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert out == sorted([(1, 200, "response", 0, d(x)), (2, 200, "revisit", 1, d(x)), (2, 300, "response", 0, d(y)), (3, 300, "revisit", 2, d(y)), (4, 3_000_000, "response", 0, d(rows[4][2]))])
    assert {r["url"] for r in warc.read_packages(made).collect()} == {"http://A.example.com/p?q=1", "http://b.example.com/%C3%A4%20b", "no%20scheme", None, "http://c.example/"}
    with zipfile.ZipFile(made.first()["path"].removeprefix("file://")) as z:
        assert z.testzip() is None and set(z.namelist()) == {warc.DATA, warc.INDEX, warc.MANIFEST}
        lines = z.read(warc.INDEX).splitlines()
        assert lines == sorted(lines) and all(b" 20240101000000 {" in x for x in lines)
        raw = z.read(warc.DATA)
        assert b"WARC-Type: warcinfo" in gzip.GzipFile(fileobj=io.BytesIO(raw)).read()
        for part in json.loads(z.read(warc.MANIFEST))["resources"]:
            assert part["hash"] == "sha256:" + hashlib.sha256(z.read(part["path"])).hexdigest()
    assert warc.sort_key("http://A.example.com/P?q=1") == "com,example,a)/p?q=1" and warc.sort_key("urn:page:1") == "urn:page:1"
    many = pages.where("page_id < 4").crossJoin(spark.range(300).select(F.col("id").alias("k"))).select((F.col("page_id") * 1000 + F.col("k")).alias("page_id"), F.concat("html", F.col("k").cast("string"), F.col("page_id").cast("string")).alias("html"))
    read = warc.read_packages(warc.write_packages(many.coalesce(1), f"file://{tmp_path}/m", url_col=None), block=2000)
    assert read.count() == many.count() and read.rdd.getNumPartitions() > 4


def test_zip_directories(tmp_path):
    for wide in (False, True):
        f = io.BytesIO()
        with zipfile.ZipFile(f, "w") as z:
            for k in range(3):
                with z.open(zipfile.ZipInfo(f"m{k}"), "w", force_zip64=wide) as m:
                    m.write(b"x" * k + b"end")
        raw = f.getvalue()
        at = warc.directory(lambda o, n, raw=raw: raw[o : o + n], len(raw))
        assert [raw[o : o + n] for o, n in (at[f"m{k}"] for k in range(3))] == [b"end", b"xend", b"xxend"]
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:  # more members than 16 bits count: a ZIP64 end
        for k in range(65_600):
            z.writestr(zipfile.ZipInfo(str(k)), b"")
    raw = f.getvalue()
    assert len(warc.directory(lambda o, n: raw[o : o + n], len(raw))) == 65_600
    with pytest.raises(ValueError):
        warc.directory(lambda o, n: b"", 0)
    assert gzip.decompress(gzip.compress(b"a", 1, mtime=0)) == b"a"


def test_toxicity(spark):
    rng = random.Random(2)
    bad = ("vile", "scumbag", "idiotic")
    texts = [prose(rng, 60) + (" " + " ".join(rng.sample(bad, 2)) if i % 5 == 0 else "") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score(docs_of(spark, texts), labels).collect()}
    assert all(out[i]["predicted"] == int(i % 5 == 0) for i in range(600))
    assert out[305]["evidence"][0]["label"] == 1
    odd = toxicity.score(odd_docs(spark), labels, train_docs=docs_of(spark, texts)).collect()
    assert len(odd) == 9 and not any(r["predicted"] for r in odd)
    none = toxicity.score(docs_of(spark, texts[:5]), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert toxicity.keep_clean(odd_docs(spark), labels, docs_of(spark, texts)).columns == odd_docs(spark).columns


def test_html(spark):
    m = htmltext.model()
    body = "<h1>Head</h1><p>One <b>two</b>three &amp; four.<p>Five&nbsp;six<br>seven.</p><ul><li>eight</ul>"
    text = "Head One twothree & four. Five six seven. eight"
    for page in (
        f"<nav><a href=x>n</a></nav><article>{body}</article><footer>f</footer>",
        f"<header><h1>Site</h1></header><main>{body}</main><aside class=sidebar><p>Aside text, a whole sentence.</p></aside>",
        f"<div class='cookie-banner'><p>Cookies are used here.</p></div><div id=content>{body}</div><div id=comments><p>I liked this one a lot, thank you.</p></div>",
        f"<article>{body}<div class='ad'>Buy this now, all of it.</div><form><p>Your mail</p></form></article><script>var x='<p>no</p>'</script><!-- <p>no</p> --><foot",
    ):
        assert m.text(page) == text
    tree = htmltext.Tree().read("<div><p>a</p><div class=ad><p>b</p></div></div><p>c")
    n = len(tree.tags)
    like = lambda i, y: np.prod([m.unary[f][y] for f in htmltext.features(tree, i) if f in m.unary])
    mass, total = np.zeros(n), 0.0
    for ys in itertools.product(htmltext.STATES, repeat=n - 1):
        ys = (htmltext.WRAPPER, *ys)
        p = np.prod([m.pair[tree.tags[i]][ys[tree.parents[i]]][ys[i]] * like(i, ys[i]) for i in range(1, n)])
        total += p
        mass += p * (np.array(ys) == 1)
    assert np.allclose(mass / total, m.marginals(tree), atol=1e-6)
    data = [(1, None, None), (2, "u", ""), (None, "u", "<p>" * 3000 + "deep"), (3, "u", "<"), (3, "u", "&#x41;&amp")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumns({"text": F.lit("no"), "id": F.lit(0)})
    assert htmltext.extract(pages).count() == 5 and htmltext.extract(pages.limit(0)).count() == 0


def test_pipeline_brute_force(spark):
    import corpus_pipeline

    ids = [r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r["doc_id"] for r in toxicity.score(docs, labels).where("predicted = 1").collect()}
    good = {r["doc_id"] for r in quality.apply_rules(docs).where("kept").collect()}
    left = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good - bad]
    comp = brute_components(left, 5, 80)

    def sets(t):
        w = minhash_words(t)
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}

    own = [sets(x) for x in items]
    want = [i for i, t in left if comp[i] == i and not any(100 * len(s & sets(t)) >= 80 * len(s) for s in own)]
    assert sorted(ids) == sorted(want) and 0 < len(want) < 200
