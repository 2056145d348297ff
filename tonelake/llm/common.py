"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that a task works on at a time; a longer document is a slice of its own.
SLICE_BYTES = 2 << 20
#: A key with more than 1 / ``HOT`` of all rows is joined by broadcast, so at most that many keys are.
HOT = 1 << 14


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of whole rows with about ``size`` bytes of text each."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if total and total + n > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
        del batch
    released()


def released() -> None:
    """At a task's end, give freed memory back: an idle worker would otherwise keep its largest moment beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The texts of a batch; a null is an empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound what a task holds in Python at once; texts are long, so a few thousand rows are enough.

    The setting is the session's and every operator asks for the same bound; a smaller one that is set already stays.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder of the cluster; a temporary one where none is set in local mode (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-tonelake-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tonelake-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps start from files that every executor sees."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files behind a ``stored`` table that no later step reads."""
    path = getattr(df, "_stored_at", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def joined_by_key(rows: DataFrame, keys: DataFrame, on: str, total: int) -> DataFrame:
    """``rows`` with what ``keys`` (one row a key, ``n``: its number of rows) says of them; hot keys by broadcast, so that no task gets all rows of one."""
    bar = max(2, -(-total // HOT))
    hot, cold = keys.where(F.col("n") >= bar), keys.where(F.col("n") < bar)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on))


def with_body(docs: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, str]:
    """The columns ``keep``, and the name of the one that holds the text: a string column among them is not shipped twice."""
    if text in keep and dict(docs.dtypes)[text] == "string":
        return docs.select(*keep), text
    body = unused("body", keep)
    return docs.select(*keep, F.col(text).cast("string").alias(body)), body


def unused(name: str, columns: list[str]) -> str:
    """``name``, or a longer one that none of the columns has, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: str, parts: int):
    """``crc32(doc_id as text) mod parts``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts
