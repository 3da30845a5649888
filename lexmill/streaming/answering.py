"""Questions as a stream: each micro-batch goes through the same batch plan, with the knowledge of its time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexmill.sources.knowledge import Knowledge


def answer_stream(questions: DataFrame, answer: Callable[..., DataFrame], path: str, checkpoint: str, knowledge: Knowledge | None = None) -> StreamingQuery:
    """Write answer(batch) of each micro-batch to path as Parquet, one folder a batch; with knowledge, answer(batch, items).

    The items are brought up to date before each batch, so changes of files count from the next batch on. A batch is done when
    its folder has the writer's mark of success; done again after a failure behind that, it is passed over, so its answers
    stay those of the knowledge that it met first."""
    spark = questions.sparkSession

    def each(batch: DataFrame, n: int) -> None:
        folder = f"{path}/batch={n}"
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
            return
        made = answer(batch) if knowledge is None else answer(batch, knowledge.items())
        made.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(folder)

    return questions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
