"""Helpers the operators of this subpackage share: words, folds, shared storage, checked broadcasts."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but the six ASCII white-space characters.
WORD_BREAK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A side is broadcast only after its rows were counted and measured, and only up to this many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 48 << 20
#: Keys of more rows than this are dealt over several tasks.
HOT_ROWS = 1_000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, whatever folder the session was started in."""
    root = Path(__file__).resolve().parents[2]
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if str(root) in paths or app in _shipped:
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="lexmill-"))
    target = os.path.join(folder, "lexmill.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted([*(root / "lexmill").rglob("*.py"), *(root / "lexmill").rglob("*.csv")]):
            z.write(p, str(p.relative_to(root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


_caches: dict[str, Callable[[], None]] = {}


def worker_cache(owner: str, size: int):
    """lru_cache() for what a worker keeps from task to task, under its owner's name."""

    def wrap(f):
        kept = functools.lru_cache(maxsize=size)(f)
        _caches[f"{owner}.{f.__name__}"] = kept.cache_clear
        return kept

    return wrap


def alone(owner: str) -> None:
    """Drop what other operators keep in this worker: workers go on from one stage of a pipeline to the next, and models
    of stages that are over would fill their memory."""
    for name, clear in _caches.items():
        if not name.startswith(f"{owner}."):
            clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone, whatever the locale."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), WORD_BREAK), "")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold that decides what a model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def let(value: Column, body) -> Column:
    """Bind an expression once: body sees it as a variable, so that it is not evaluated again for each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has few rows, and few bytes in them: its rows are counted, its texts, binaries and arrays measured.

    df should be cheap to read again, such as a table that a Workspace has written; no more than rows + 1 rows are
    looked at."""
    wide = [f for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType))]
    length = F.lit(16 * len(df.columns)).cast("long")
    for f in wide:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            inner = f.dataType.elementType
            flat = F.octet_length(F.array_join(c, "")) if isinstance(inner, T.StringType) else F.lit(0)
            each = 16 * (len(inner.fields) if isinstance(inner, T.StructType) else 1)
            length = length + F.coalesce(F.size(c) * each + flat, F.lit(0))
        else:
            length = length + F.coalesce(F.octet_length(c), F.lit(0))
    n, total = df.limit(rows + 1).select(length.alias("b")).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return n <= rows and total <= size


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark df for broadcast if it fits; else leave it to a shuffle join."""
    return F.broadcast(df) if fits(df, rows, size) else df


def spread(rows: DataFrame, keyed: DataFrame, key: str | list[str], by: str, hot: int = HOT_ROWS, how: str = "inner", once: bool = True) -> DataFrame:
    """rows joined with keyed on key, where keys of many rows are dealt over several tasks.

    keyed has one row for each key (unless once is false) and its number of rows as n; it should be a written table. Keys of over hot rows
    are looked up first (there are few); their rows are dealt by the column by, and their row of keyed is repeated."""
    key = [key] if isinstance(key, str) else key
    parts = keyed.where(F.col("n") > hot).select(*key, F.ceil(F.col("n") / hot).cast("int").alias("_parts"))
    parts = small(parts if once else parts.distinct())
    dealt = rows.join(parts, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(F.col(by), F.lit(3)), F.col("_parts")).cast("int"), F.lit(0)))
    copies = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / hot).cast("int") - 1))
    copied = keyed.withColumn("_part", F.explode(F.when(F.col("n") > hot, copies).otherwise(F.array(F.lit(0))))).drop("n")
    return dealt.drop("_parts").join(copied, [*key, "_part"], how).drop("_part")


def meet(rows: DataFrame, keyed: DataFrame, key: str | list[str], by: str, how: str = "inner", most: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """rows joined with keyed by broadcast where keyed fits, else as spread() does it. Either way no key fills a task.

    keyed may lack n, and may then have several rows for a key: rows are counted by key where that is needed."""
    key = [key] if isinstance(key, str) else key
    if fits(keyed, most, size):
        return rows.join(F.broadcast(keyed.drop("n")), key, how)
    once = "n" in keyed.columns
    if not once:
        counts = rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS)
        keyed = keyed.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return spread(rows, keyed, key, by, how=how, once=once)


class Workspace:
    """Intermediate tables as Parquet in the folder that driver and executors share.

    A written table cuts lineage and outlives any executor. The folder is spark.checkpoint.dir; where the
    session has none (tests, one machine) a temporary one is made."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        """Free a table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Unset, a session on one machine gets a temporary one, the same for the whole
    application; on a cluster, where the driver's disk is not the executors', that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        folder = _own_dirs.setdefault(app, _own_dirs.get(app) or f"file://{tempfile.mkdtemp(prefix='lexmill-checkpoints-')}")
    return folder.rstrip("/")
