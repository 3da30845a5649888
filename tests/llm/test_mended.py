"""Attributes that pages use as they like, sessions without a checkpoint folder, hot places, long runs of blanks."""

import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from lexmill.llm import chat, common, htmltext, urls

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SAID = "The council met for two hours on the new bridge and could not agree on who will pay for it, so the vote was put off."


@pytest.mark.parametrize("own", ["data-content='Some popover text'", "data-content", "data-content=''", "data-content='0'"])
def test_labels_are_read_from_labelled_pages_alone(own):
    assert htmltext.model().text(f"<nav><a href=/>Home</a></nav><article {own}><h1>Bridge</h1><p>{SAID}</p></article>") == f"Bridge {SAID}"
    assert set(htmltext.Tree().read(f"<div data-content='1'><p>{SAID}</p></div>").labels) == {0}


def test_hidden_elements_are_not_shown():
    page = f"<article><p>{SAID}</p><p hidden>Secret one.</p><div hidden=''><p>Secret two.</p><ul><li>three</ul></div><p>Then <b hidden>secret <i>four</i></b>more was said.</p></article>"
    assert htmltext.model().text(page) == f"{SAID} Then more was said."


def test_session_without_settings(tmp_path):
    """No spark.checkpoint.dir, no defaults from any folder: a temporary one, the same throughout."""
    code = (
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "from lexmill.llm.common import Workspace, shared_dir\n"
        "assert s.conf.get('spark.checkpoint.dir', None) is None\n"
        "assert Workspace(s, 'x').write(s.range(5), 'a').count() == 5 and shared_dir(s) == shared_dir(s)\n"
        "print('done')\n"
    )
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    env.pop("PYSPARK_SUBMIT_ARGS", None)
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=200)
    assert "done" in out.stdout, out.stderr[-2000:]


def test_hot_places_beyond_broadcast(spark, monkeypatch):
    """90,000 long places measure over the bound of bytes; one place, its host and its domain have a third of all rows."""
    long = F.concat(F.lit("http://h"), (F.col("id") % 7).cast("string"), F.lit(".example.com/de/"), F.repeat(F.lit("x"), 200), F.col("id").cast("string"))
    pages = spark.range(90_000).select(F.col("id").alias("page_id"), long.alias("url"))
    pages = pages.unionByName(spark.range(90_000, 135_000).select(F.col("id").alias("page_id"), F.lit("http://hot.example.com/fr/").alias("url")))
    rules, listed = urls.production_rules(spark), spark.createDataFrame([("hot.example.com",)], "url string")
    parts = []

    def spread(rows, keyed, key, by, **how):
        parts.append((key, keyed.where("n > 1000").count()))
        return common_spread(rows, keyed, key, by, **how)

    common_spread = common.spread
    monkeypatch.setattr(common, "spread", spread)
    got = urls.judge(pages, rules, listed).groupBy("rule", "verdict", "listed").count()
    assert sorted(map(tuple, got.collect()), key=str) == [("example.com/de/", "block", False, 90_000), (None, "block", True, 45_000)]
    assert parts == [(["host", "path"], 1)]
    monkeypatch.setattr(common, "fits", lambda *a: False)  # and with rules and listed URLs joined by shuffle
    got = urls.judge(pages, rules, listed).groupBy("rule", "verdict", "listed").count()
    assert sorted(map(tuple, got.collect()), key=str) == [("example.com/de/", "block", False, 90_000), (None, "block", True, 45_000)]
    assert [p[0] for p in parts[1:]] == [["suffix"], ["key"], ["host", "path"]] and parts[1][1] >= 1


def test_runs_of_blanks_take_linear_time():
    tok = chat.tokenizer(chat.DEFAULT_TOKENIZER)
    text = "a".join([" " * 99_999] * 30)
    began = time.time()
    assert list(chat._SPACES.finditer(text)) == []
    assert time.time() - began < 2
    small = "b" + " " * 250_000 + "c" + "\n" * 100_000
    assert chat.decode(tok, chat.encode(tok, small)) == small
    assert [m.span() for m in chat._SPACES.finditer(small)] == [(1, 250_001), (250_002, 350_002)]
    began = time.time()
    ids = chat.encode(tok, text)
    print(time.time() - began)
    assert chat.decode(tok, ids) == text
