"""Tagged question-and-answer texts: [TAGS: …], D: …, R: … and free lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.text import trim_all
from lexmill.operators.joins import few, stored

#: What lines of the format look like.
TAGS, QUESTION, ANSWER = r"(?i)^\s*\[TAGS\s*:\s*(.*?)\]\s*$", r"(?i)^\s*(?:D|DOMANDA)\s*:\s*(.*)$", r"(?i)^\s*(?:R|RISPOSTA)\s*:\s*(.*)$"


def lines_of(texts: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, place, line) of whole texts; null has none."""
    return texts.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.posexplode(F.split(text, r"\r\n|[\n\r]")).alias("place", "line"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc, place, piece, line) of text files (a file, folder or glob), read by splits: a file of any size is the work of many
    tasks. doc is the file; place orders its lines, piece is the split that a line is in, rising with place."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return lines.select(F.col("_metadata.file_path").alias("doc"), at.alias("place"), F.col("_metadata.file_block_start").alias("piece"), F.col("value").alias("line"))


def kind_of(line: Column) -> Column:
    """t, q or a for lines of tags, questions and answers, x for free lines; the first that fits."""
    return F.when(line.rlike(TAGS), "t").when(line.rlike(QUESTION), "q").when(line.rlike(ANSWER), "a").otherwise("x")


def _numbered(marked: DataFrame, pieces: bool) -> DataFrame:
    """marked with n, the questions up to each line. By pieces in two levels: questions are counted by piece, a document's
    pieces get what is before them, and lines are counted within their piece; so no task sees a whole document."""
    asks = (F.col("kind") == "q").cast("long")
    if not pieces:
        return marked.withColumn("n", F.sum(asks).over(Window.partitionBy("doc").orderBy("place")))
    before = Window.partitionBy("doc").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = marked.groupBy("doc", "piece").agg(F.sum(asks).alias("own")).withColumn("carry", F.coalesce(F.sum("own").over(before), F.lit(0)))
    within = F.sum(asks).over(Window.partitionBy("doc", "piece").orderBy("place"))
    carry = few(stored(carry.where("carry > 0").select("doc", "piece", "carry")))
    return marked.withColumn("n", within).join(carry, ["doc", "piece"], "left").withColumn("n", F.col("n") + F.coalesce("carry", F.lit(0))).drop("carry")


def parse_pairs(lines: DataFrame, doc: str = "doc", place: str = "place", line: str = "line", piece: str | None = None) -> DataFrame:
    """(doc, n, question, answer) of all documents' lines.

    A question opens a pair; its answer is what R: and free lines bring until the next question, joined by line
    breaks and trimmed. Answers before the first question belong to none. Lines of tags belong to no answer. piece: a
    column that parts long documents, rising with place (see read_lines); without it a document is numbered in one task."""
    part = [F.col(piece).alias("piece")] if piece else []
    marked = lines.select(F.col(doc).alias("doc"), F.col(place).alias("place"), *part, F.col(line).alias("line"), kind_of(F.col(line)).alias("kind"))
    grouped = _numbered(marked, bool(piece)).where("n > 0 and kind <> 't'")
    said = F.when(F.col("kind") == "q", trim_all(F.regexp_extract("line", QUESTION, 1))).when(F.col("kind") == "a", F.regexp_extract("line", ANSWER, 1)).otherwise(F.col("line"))
    parts = grouped.select("doc", "n", "place", "kind", said.alias("said")).groupBy("doc", "n").agg(
        F.max(F.when(F.col("kind") == "q", F.col("said"))).alias("question"),
        F.array_sort(F.collect_list(F.when(F.col("kind") != "q", F.struct("place", "said")))).alias("a"),
    )
    return parts.select("doc", "n", "question", trim_all(F.array_join(F.col("a.said"), "\n")).alias("answer"))


def parse_texts(lines: DataFrame, normalize, doc: str = "doc", place: str = "place", line: str = "line") -> DataFrame:
    """(doc, tags, norm_tags, text, norm) of all documents' lines: tags of all lines of tags, in order, and the free
    lines joined by line breaks and trimmed; what stands on lines of questions and answers is no part of the text."""
    kind = kind_of(F.col(line))
    parts = F.filter(F.transform(F.split(F.regexp_extract(line, TAGS, 1), ","), trim_all), lambda t: t != "")
    marked = lines.select(F.col(doc).alias("doc"), F.col(place).alias("place"), F.when(kind == "t", parts).alias("tags"), F.when(kind == "x", F.col(line)).alias("free"))
    out = marked.groupBy("doc").agg(
        F.array_sort(F.collect_list(F.when(F.col("tags").isNotNull(), F.struct("place", "tags")))).alias("t"),
        F.array_sort(F.collect_list(F.when(F.col("free").isNotNull(), F.struct("place", "free")))).alias("x"),
    )
    out = out.select("doc", F.flatten("t.tags").alias("tags"), trim_all(F.array_join("x.free", "\n")).alias("text"))
    return out.withColumns({"norm_tags": F.transform("tags", lambda t: normalize(t)), "norm": normalize(F.col("text"))})


def index(lines: DataFrame, normalize, least: int = 500) -> DataFrame:
    """parse_texts() with the pairs as qas (array of question, answer, in order), of the documents worth keeping: those
    with a pair or with least characters of text."""
    qas = parse_pairs(lines).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "question", "answer"))), lambda x: F.struct(x["question"].alias("q"), x["answer"].alias("a"))).alias("qas"))
    both = parse_texts(lines, normalize).join(qas, "doc", "left").withColumn("qas", F.coalesce("qas", F.array().cast("array<struct<q:string,a:string>>")))
    return both.where((F.length("text") >= least) | (F.size("qas") > 0))
