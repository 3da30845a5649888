"""Calls in bulk, knowledge brought up to date by file, and a stream that meets changed knowledge."""

import os
import time

from pyspark.sql import functions as F

from lexmill.operators.joins import stored
from lexmill.plans import provider
from lexmill.sources import knowledge
from lexmill.streaming.answering import answer_stream


def engine(folder, broken=0, never=()):
    """A fake engine that writes a line for each prompt it is asked, and fails that often for each call."""

    def call(prompts):
        name = f"{folder}/{abs(hash(tuple(prompts)))}"
        with open(name, "a") as f:
            f.write("x")
        if len(open(name).read()) <= broken or any(p in never for p in prompts):
            raise OSError("busy")
        for p in prompts:
            with open(f"{folder}/asked-{p}", "a") as f:
                f.write("x")
        return [p.upper() for p in prompts]

    return call


def asked(folder):
    return {n[6:]: len((folder / n).read_text()) for n in os.listdir(folder) if n.startswith("asked-")}


def test_equal_prompts_are_asked_once(spark, tmp_path):
    (tmp_path / "a").mkdir()
    df = spark.createDataFrame([(i, f"p{i % 7}") for i in range(300)] + [(300, None), (300, None)], "q int, t string")
    got = provider.ask(df, "t", call=engine(tmp_path / "a", broken=2), size=3, pause=0.01)
    assert sorted((r["q"], r["reply"]) for r in got.collect()) == sorted([(i, f"P{i % 7}") for i in range(300)] + [(300, ""), (300, "")])
    assert got.count() == 302 and got.columns == ["q", "t", "reply", "reply_error"]
    assert asked(tmp_path / "a") == {"": 1} | {f"p{i}": 1 for i in range(7)}  # three tries, and no more however often it is read


def test_replies_are_kept(spark, tmp_path):
    (tmp_path / "a").mkdir()
    kept, first = str(tmp_path / "kept"), spark.createDataFrame([("a",), ("b",), ("bad",)], "t string")
    call = engine(tmp_path / "a", never=("bad",))
    how = {"kept": kept, "size": 1, "tries": 2, "pause": 0.0}
    said = {r["t"]: (r["reply"], r["reply_error"]) for r in provider.ask(first, "t", call=call, **how).collect()}
    assert said == {"a": ("A", None), "b": ("B", None), "bad": (provider.UNAVAILABLE, "OSError: busy")}
    again = {r["t"]: r["reply"] for r in provider.ask(first.unionByName(spark.createDataFrame([("c",)], "t string")), "t", call=engine(tmp_path / "a"), **how).collect()}
    assert again == {"a": "A", "b": "B", "bad": "BAD", "c": "C"} and asked(tmp_path / "a") == {"a": 1, "b": 1, "bad": 1, "c": 1}
    assert spark.read.parquet(kept).count() == 4


def put(path, text):
    path.write_text(text)
    stamp = time.time() + put.more
    put.more += 5
    os.utime(path, (stamp, stamp))


put.more = 5


def test_changed_files_alone_are_read_again(spark, tmp_path, monkeypatch):
    kb_dir = tmp_path / "k b"
    kb_dir.mkdir()
    put(kb_dir / "1.json", '[{"id": "a"}]')
    put(kb_dir / "2+x.json", '﻿{"items": [{"id": "b"}, {"id": "c"}]}')
    put(kb_dir / "3.json", "{")
    read, inner = [], knowledge.read_items
    monkeypatch.setattr(knowledge, "read_items", lambda spark, path, *a: read.append(sorted(os.path.basename(p) for p in path)) or inner(spark, path, *a))
    kb = knowledge.Knowledge(spark, str(kb_dir), "id string")
    ids = lambda: sorted(r["id"] for r in kb.items().collect())
    assert ids() == ["a", "b", "c"] and ids() == ["a", "b", "c"] and read == [["1.json", "2+x.json", "3.json"]]
    put(kb_dir / "2+x.json", '[{"id": "d"}]')  # rewritten in place
    put(kb_dir / "4.json", '[{"id": "e"}]')
    assert ids() == ["a", "d", "e"] and read[1:] == [["2+x.json", "4.json"]]
    os.remove(kb_dir / "1.json")
    assert ids() == ["d", "e"] and len(read) == 2
    assert kb.reload().count() == 2 and read[2] == ["2+x.json", "3.json", "4.json"]


def test_stream_with_changing_knowledge(spark, tmp_path):
    for name in ("in", "kb"):
        (tmp_path / name).mkdir()
    put(tmp_path / "kb" / "1.json", '[{"id": "x", "v": "old"}]')
    kb = knowledge.Knowledge(spark, str(tmp_path / "kb"), "id string, v string")
    plan = lambda batch, items: batch.join(items, batch["ask"] == items["id"], "left").select("ask", "v")

    def run():
        spark.read.parquet(str(tmp_path / "in")).count()
        stream = spark.readStream.schema("ask string").parquet(str(tmp_path / "in"))
        answer_stream(stream, plan, str(tmp_path / "out"), str(tmp_path / "cp"), kb).awaitTermination()
        return sorted((r["ask"], r["v"], r["batch"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    ask = lambda x: spark.createDataFrame([(x,)], "ask string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ask("x")
    assert run() == [("x", "old", 0)]
    put(tmp_path / "kb" / "1.json", '[{"id": "x", "v": "new"}]')
    ask("x")
    assert run() == [("x", "new", 1), ("x", "old", 0)]
    # a batch that is done again after its answers were written changes nothing
    os.remove(tmp_path / "cp" / "commits" / "1")
    (tmp_path / "cp" / "commits" / ".1.crc").unlink(missing_ok=True)
    put(tmp_path / "kb" / "1.json", '[{"id": "x", "v": "newer"}]')
    assert run() == [("x", "new", 1), ("x", "old", 0)]


def test_stored_tables_can_be_read_again(spark):
    t = stored(spark.range(10).withColumn("r", F.rand()))
    assert t.collect() == t.collect()
