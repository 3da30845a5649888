"""One large tagged file by splits, and all names of character references."""

import html
from html.entities import html5

from pyspark.sql import functions as F

from lexmill.sources.html import references
from lexmill.sources.tagged import lines_of, parse_pairs, read_lines


def test_one_large_file_over_many_tasks(spark, tmp_path):
    text = "free\n" + "".join(f"D: q{i}\nR: a{i}\n" + "more\n" * (i % 4) + ("[TAGS: t]\n" if i % 9 == 0 else "") for i in range(30_000))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "big.txt").write_text(text)
    (tmp_path / "in" / "small.txt").write_text("R: none\nD: x\r\nR: y\nz\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        lines = read_lines(spark, str(tmp_path / "in"))
        assert lines.rdd.getNumPartitions() > 8 and lines.select("piece").distinct().count() > 8
        got = parse_pairs(lines, piece="piece").withColumn("doc", F.substring_index("doc", "/", -1))
        whole = spark.createDataFrame([("big.txt", text), ("small.txt", "R: none\nD: x\r\nR: y\nz\n")], "name string, body string")
        want = parse_pairs(lines_of(whole, "name", "body"))
        assert got.count() == 30_001 and got.exceptAll(want).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_all_names_of_references(spark):
    cases = [f"a &{n} b" for n in html5] + [f"a&{n[:-1]}" for n in html5 if n.endswith(";")] + [f"&{n}x;&" for n in html5]
    cases += ["&", "&&amp;", "&amp;lt;", "&#38;lt;", "&notit; &notin; &no; &NotEqualTilde;", "&ampamp;", "&; & lt;", "", "x", "&lt", "&unknown;&copy"]
    out = spark.createDataFrame([(c,) for c in cases], "c string").select("c", references(F.col("c")).alias("o")).collect()
    assert [(r["c"], r["o"]) for r in out if r["o"] != html.unescape(r["c"])] == []
    assert spark.createDataFrame([(None,)], "c string").select(references(F.col("c"))).first()[0] is None
