"""Joins on words: sides broadcast after measuring them, words of many rows dealt over tasks, and tables written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only after its rows were counted and measured, and only up to this many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20
#: Keys of more rows than this are dealt over several tasks.
HOT_ROWS = 20_000

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_own_dirs: dict[str, str] = {}


def shared_dir(spark) -> str:
    """The folder of spark.checkpoint.dir; unset, a session on one machine gets a temporary one, and any other is told so."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        folder = _own_dirs.get(app) or _own_dirs.setdefault(app, f"file://{tempfile.mkdtemp(prefix='lexmill-tables-')}")
    return folder.rstrip("/")


def stored(df: DataFrame, batch: int | None = None) -> DataFrame:
    """df as a Parquet table of the shared folder: made once, read as often as a plan needs it, and still there when an
    executor is lost. The table goes when the application ends. batch: rows that go to Python at a time meanwhile, where these are long."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, before if batch is None else str(batch))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, rows: int | None = None, size: int | None = None) -> bool:
    """Whether df has few rows and few bytes in its texts and arrays. It should be cheap to read again; no more than
    rows + 1 rows are looked at."""
    rows, size = BROADCAST_ROWS if rows is None else rows, BROADCAST_BYTES if size is None else size
    length = F.lit(16 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            length = length + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            length = length + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    n, total = df.limit(rows + 1).select(length.alias("b")).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return n <= rows and total <= size


def few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df marked for broadcast if it fits; else left to a shuffle join."""
    return F.broadcast(df) if fits(df, rows) else df


def spread_out(df: DataFrame, by: str) -> DataFrame:
    """df dealt over all cores where it comes in fewer parts, before work that costs more than the exchange."""
    return df if df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism else df.repartition(by)


def word_join(rows: DataFrame, asked: DataFrame, key: str = "token", by: str = "d", hot: int | None = None, tiny: bool | None = None) -> DataFrame:
    """rows joined with asked on key, by broadcast where asked fits (tiny: what is known of that).

    Else by shuffle, where rows of a key with many of them are dealt by the column by over several tasks and the
    key's rows of asked go to all of these. Keys are counted by partial aggregates, those of asked alone."""
    if fits(asked) if tiny is None else tiny:
        return rows.join(F.broadcast(asked), key)
    hot = HOT_ROWS if hot is None else hot
    wanted = rows.join(asked.select(key).distinct(), key, "left_semi")
    parts = wanted.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > hot).select(key, F.ceil(F.col("n") / hot).cast("int").alias("_parts"))
    parts = few(stored(parts))  # one row for each hot rows at most
    dealt = rows.join(parts, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(F.col(by), F.lit(3)), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    copied = asked.join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))).drop("_parts")
    return dealt.join(copied, [key, "_part"]).drop("_part")
