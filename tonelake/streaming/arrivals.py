"""Labelling recordings as they arrive: each one once, also over restarts and crashes.

A batch of the stream writes to a folder of its own, named by the stream and the batch, and is then committed by an empty file of the same name. The
checkpoint replays a batch that was not finished with the same files under the same number, so its folder is written anew; what has no commit
is not read. No batch reads what earlier ones wrote.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

#: Folder of the commits below the table; its name hides it from readers of the table itself.
COMMITS = "_commits"


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def committed(spark: SparkSession, out: str) -> list[str]:
    """Folders of the batches that were committed, one short name a batch."""
    fs, target = _fs(spark, f"{out}/{COMMITS}")
    if not fs.exists(target):
        return []
    return sorted(f"{out}/{'/'.join(s.getPath().getName().split('-'))}" for s in fs.listStatus(target))


def read_labels(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """Rows of all committed batches, with the numbers of their stream and batch."""
    found = committed(spark, out)
    if not found:
        return spark.createDataFrame([], f"{schema}, stream string, batch long")
    return spark.read.schema(f"{schema}, stream string, batch long").option("basePath", out).parquet(*found)


def label_arrivals(arriving: DataFrame, job: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True, written: Callable[[int], None] | None = None) -> StreamingQuery:
    """Run a labelling job on what has arrived since the last time; ``read_labels`` gives its rows.

    The checkpoint says which files were read; two streams (two checkpoints) may share a table. ``job`` must give the same rows for the same batch.
    ``written`` is called between a batch's rows and its commit (tests stop there).
    """
    stream = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def batch(rows: DataFrame, number: int) -> None:
        job(rows).write.mode("overwrite").parquet(f"{out}/stream={stream}/batch={number}")
        if written is not None:
            written(number)
        fs, target = _fs(rows.sparkSession, f"{out}/{COMMITS}/stream={stream}-batch={number}")
        fs.create(target, True).close()

    writer = arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
