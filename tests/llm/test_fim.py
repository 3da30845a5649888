"""Fill-in-the-middle against a version that goes character by character."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lexmill.llm import fim


def by_hand(doc_id, text, seed=42):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def texts():
    rng = random.Random(5)
    signs = ["a", "é", "日", "😀", " ", "\n", "\t", "<", ">", "P", "S", "M", "<P", "<S>", "<<S", " ", " ", "\x1c", "\x0b"]
    out = [None, "", " ", "\n\n", "<", "a<", "<M", "<P>", "P>", "<<P>>", " <S>", "a <M> b", "x" * 5000, " " * 5000, "é" * 999 + " 日本"]
    out += ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(600)]
    out += ["".join(rng.choice(["a", "é", " ", "日", "b"]) for _ in range(rng.randrange(1, 3000))) for _ in range(60)]
    return out


def test_transform_and_restore(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, "again and again"), (3, "again and again"), (None, "no id at all here"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "n", "form", "output", "h", "h1")})
    out = fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert {x["form"] for x in out} == {"plain", "psm", "spm"}
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = sorted(((i, t or "", *by_hand(i, t)) for i, t in rows), key=key)
    assert sorted(((r["doc_id"], r["back"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out), key=key) == want
    assert fim.transform(docs.limit(0)).count() == 0
    named = fim.transform(docs.select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("body")), 7, 100, 0, "key", "body")
    assert {(r["key"], r["form"]) for r in named.where("key = '14'").collect()} == {("14", "psm")}


def test_windows_do_not_show(monkeypatch):
    rng = random.Random(8)
    data = np.frombuffer("".join(rng.choice("a <PSM>é日\n") for _ in range(4000)).encode(), np.uint8)
    starts = np.array([0, 1, 2, 50, 51, 900, 901, 3000])
    whole = fim.scan(data, starts)
    parts = np.concatenate([fim.scan(data[a:b], np.array([0])) for a, b in zip(starts, [*starts[1:], len(data)], strict=True)])
    assert (whole == parts).all()
    for window in (2, 3, 7, 64):
        monkeypatch.setattr(fim, "WINDOW", window)
        assert (fim.scan(data, starts) == whole).all()
    assert fim.counted(whole[3000:], fim.MARK) == len(re.findall(rb"<[PSM]>", data[3000:].tobytes()))
    for k in (0, 1, 5, 10_000):
        assert fim.place_of_unit(whole[3000:], k, 16) == fim.place_of_unit(whole[3000:], k)


def test_a_long_text(spark):
    text = " ".join(f"wörd{i}" for i in range(1_500_000))
    docs = spark.range(8).select(F.col("id").alias("doc_id")).crossJoin(spark.createDataFrame([(text,)], "text string"))
    out = fim.transform(docs)
    got = {r["doc_id"]: tuple(r)[1:] for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256)).collect()}
    for i in range(8):
        *rest, made = by_hand(i, text)
        assert got[i] == (*rest, hashlib.sha256(made.encode()).hexdigest())
