"""Knowledge bases in JSON and folders of texts."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.joins import few, stored


def read_items(spark: SparkSession, path: str | list[str], schema: str, envelope: str = "items", strict: bool = False) -> DataFrame:
    """(file, place, and the fields of schema) of JSON files that hold a list of items, or an object with one.

    path: a file, folder or glob, or several. Rows are ordered by file and place where a caller sorts them, never by listing. A
    missing path gives no rows and a file that does not parse none either; strict raises for both."""
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException:
        if strict:
            raise
        return spark.createDataFrame([], f"file string, place int, {schema}")
    item = f"array<struct<{schema}>>"
    options = {"mode": "PERMISSIVE"}
    text = F.trim(F.regexp_replace("value", "^﻿", ""))
    bare = F.from_json(F.when(F.startswith(text, F.lit("[")), text), item, options)
    wrapped = F.from_json(F.when(F.startswith(text, F.lit("{")), text), f"struct<`{envelope}`: {item}>", options)[envelope]
    valid = F.call_function("try_parse_json", text).isNotNull()
    items = F.when(valid, F.coalesce(bare, wrapped))
    if strict:
        items = F.coalesce(items, F.raise_error(F.concat(F.lit("no items in "), F.col("file"))).cast(item))
    rows = files.select(F.col("_metadata.file_path").alias("file"), "value").select("file", F.posexplode(items).alias("place", "i"))
    return rows.where("i is not null").select("file", "place", "i.*")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(file, name, text) of all .txt files below a folder, whatever the case of the suffix, by path; none if it is missing."""
    try:
        files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[tT][xX][tT]").text(folder, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], "file string, name string, text string")
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text")).orderBy("file")


def headed(name, text):
    """A text under a line with its name: the parts of a concatenated folder, which stay rows."""
    return F.concat(F.lit("### FILE: "), name.cast("string"), F.lit(" ###\n"), F.coalesce(text, F.lit("")))


def concatenated(texts: DataFrame, by: list[str], order: str, part: Column, between: str = "\n\n") -> DataFrame:
    """(by, text): the parts of each group in order, with blank lines between. A group becomes one string, so groups
    must be small (a folder of a knowledge base); larger ones stay rows of headed()."""
    joined = F.array_join(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p"))))["p"], between)
    return texts.groupBy(*by).agg(joined.alias("text"))


def stem(name: Column) -> Column:
    """The lower-cased name of a file without its folder and suffix."""
    return F.lower(F.regexp_replace(F.substring_index(name, "/", -1), r"(?<=.)\.[^.]*$", ""))


def overlaid(spark: SparkSession, base: str, overlays: str, schema: str, key: str = "id", envelope: str = "items") -> DataFrame:
    """The items of base with those of the overlays' files in their place: later files and places win, items without a
    key are dropped, new ones added, sorted by key. Files that don't parse are passed over."""
    own = read_items(spark, base, schema, envelope).withColumn("file", F.lit(""))
    over = read_items(spark, overlays, schema, envelope)
    rest = [c for c in own.columns if c not in (key, "file", "place")]
    rows = own.unionByName(over).where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    top = rows.groupBy(key).agg(F.max(F.struct("file", "place", *rest)).alias("t"))
    return top.select(key, *[F.col(f"t.{c}").alias(c) for c in rest]).orderBy(key)


def write_items(items: DataFrame, path: str) -> None:
    """Items as JSON lines; letters stay as they are, nulls are left out."""
    items.write.mode("overwrite").json(path)


class Knowledge:
    """A knowledge base in JSON files that is read once, written as a table, and brought up to date when its files change.

    A manifest has each file's time and length. Of what changed, new and rewritten files alone are read again, and rows of
    files that are gone or rewritten are left out; all other rows are taken over from the table as it is."""

    def __init__(self, spark: SparkSession, path: str, schema: str, envelope: str = "items"):
        self.spark, self.path, self.schema, self.envelope = spark, path, schema, envelope
        self.manifest: dict[str, tuple[int, int]] = {}
        self.kept: DataFrame | None = None

    def found(self) -> dict[str, tuple[int, int]]:
        """Time and length of all files of the path (a file, folder or glob), as their file system tells them; a driver's look at
        metadata alone."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out: dict[str, tuple[int, int]] = {}
        for top in fs.globStatus(hadoop) or []:
            files = fs.listStatus(top.getPath()) if top.isDirectory() else [top]
            for f in files:
                if not f.isDirectory() and f.getPath().getName()[:1] not in "_.":
                    out[str(f.getPath())] = (f.getModificationTime(), f.getLen())
        return out

    def items(self) -> DataFrame:
        """The rows as the files are now; see read_items()."""
        now = self.found()
        if self.kept is None or now != self.manifest:
            gone = [f for f in self.manifest if now.get(f) != self.manifest[f]]
            fresh = [f for f in now if self.manifest.get(f) != now[f]]
            rows = read_items(self.spark, fresh, self.schema, self.envelope) if fresh else self.spark.createDataFrame([], f"file string, place int, {self.schema}")
            if self.kept is not None:
                left = self.spark.createDataFrame([(f,) for f in gone], "gone string")
                rows = rows.unionByName(self.kept.join(few(left), _plain(F.col("file")) == F.col("gone"), "left_anti"))
            self.kept, self.manifest = stored(rows), now
        return self.kept

    def reload(self) -> DataFrame:
        """All files read again."""
        self.kept, self.manifest = None, {}
        return self.items()

    def stats(self) -> DataFrame:
        """(file, items)."""
        return self.items().groupBy("file").agg(F.count("*").alias("items"))


def _plain(file: Column) -> Column:
    """A file as its file system spells it: without escapes, and local ones with one slash."""
    return F.regexp_replace(F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def read_enrichment(spark: SparkSession, path: str) -> dict:
    """topics (name: text), rules, prefix and suffix of a small configuration file; all empty where there is none."""
    schema = "topics map<string,string>, rules array<struct<if_any:array<string>,if_all:array<string>,add:string>>, prefix string, suffix string"
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        text = spark.createDataFrame([], "value string")
    row = text.select(F.from_json("value", schema).alias("c")).select("c.*").first()
    found = row.asDict(recursive=True) if row else {}
    return {"topics": found.get("topics") or {}, "rules": found.get("rules") or [], "prefix": found.get("prefix") or "", "suffix": found.get("suffix") or ""}


@dataclass(frozen=True)
class Settings:
    """What a search may be told by the session's settings (lexmill.<name>), under a name or an older one."""

    top_k: int = 8
    threshold: float = 0.30
    least_chars: int = 500
    answer_chars: int = 1200

    @classmethod
    def of(cls, spark: SparkSession, older: dict[str, str] | None = None) -> Settings:
        values = {}
        for f in fields(cls):
            for name in (f.name, *[o for o, n in (older or {}).items() if n == f.name]):
                said = spark.conf.get(f"lexmill.{name}", None)
                if said not in (None, ""):
                    values[f.name] = type(f.default)(said)
                    break
        return cls(**values)


def indexable(text, pairs=None):
    """Whether a text is long enough (500 characters) or has question-and-answer pairs."""
    long_enough = F.coalesce(F.length(text) >= 500, F.lit(False))
    return long_enough if pairs is None else long_enough | (F.coalesce(pairs, F.lit(0)) > 0)
