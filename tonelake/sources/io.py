"""Reading recordings, transcripts, manifests and results; writing chunks and reports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import base_name, source_key, stem

CHUNK = "chunk_id string, prefix string, chunk_idx int, source_key string, wpm double, text string, start_s double, end_s double, audio array<float>"
HOLDOUT = "kaggle_labeled array<struct<path:string,transcript:string>>, arrl_sources array<string>, arrl_labeled array<struct<npy:string,text:string,source_key:string>>"
FOLDS = "strategy string, num_folds int, folds array<struct<name:string,sources:array<string>,items:array<struct<npy:string,text:string,source_key:string,wpm:string>>,num_chunks:int,num_sources:int>>"
#: Older files lack some of these; they read as null.
RESULT = "timestamp timestamp_ntz, checkpoint string, decoder string, kaggle_cer double, kaggle_wer double, arrl_cer double, arrl_wer double, kaggle_v1_cer double, kaggle_v1_wer double, overall_cer double, arrl_folds array<struct<name:string,cer:double,wer:double,num_items:int,num_sources:int>>"
CASES = "timestamp timestamp_ntz, synthetic map<string,struct<target:string,decoded:string,wpm:double,bucket:string,content_type:string,cer:double,wer:double>>"


def scratch(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder that the cluster shares; a temporary one where none is set in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-tonelake-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tonelake-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """A table written once to the shared folder: what reads it several times does not compute it several times, and a lost executor costs no more than a read."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_recordings(spark: SparkSession, path: str, wpm: float | None = None) -> DataFrame:
    """Binary files with the speed of their folder and their base name; decode ``content`` with ``signal.decode_pcm``."""
    rows = recordings_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
    return rows if wpm is None else rows.where(F.col("wpm") == wpm)


def recordings_of(files: DataFrame) -> DataFrame:
    """``recording_id, path, wpm, content`` of binary files, read at once or as they arrive."""
    speed = F.regexp_extract("path", r"(\d+)wpm", 1)
    return files.select(stem(F.col("path")).alias("recording_id"), "path", F.when(speed != "", speed.cast("double")).alias("wpm"), "content")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("path", F.input_file_name())
    speed = F.regexp_extract("path", r"(\d+)wpm", 1)
    return rows.select(stem(F.col("path")).alias("recording_id"), F.when(speed != "", speed.cast("double")).alias("wpm"), F.col("value").alias("raw_text"))


def pair(recordings: DataFrame, texts: DataFrame) -> DataFrame:
    """Recordings with their transcripts; what lacks either goes. Join before sound is decoded."""
    on = ["recording_id", "wpm"]
    return recordings.join(texts.where(F.length(F.trim("raw_text")) > 0), on)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """``ID,PREDICTION`` rows with the name of the clip; a blank transcript is null (unlabelled). Quoted transcripts may have several lines."""
    rows = spark.read.csv(path, header=True, schema="ID int, PREDICTION string", multiLine=True, escape='"')
    t = F.trim("PREDICTION")
    return rows.select(F.format_string("cw%03d.wav", "ID").alias("clip"), F.when(t != "", t).alias("transcript"))


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object file -> text, as rows by name."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("clip", "transcript"))
    return rows.select("clip", F.upper(F.trim("transcript")).alias("transcript")).orderBy("clip")


def _documents(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    """JSON documents, one a file of any layout, or with ``lines`` one a line.

    Each file costs a listing, an opening and a commit. Where documents are many, write them with ``write.json``: files then grow with the bytes.
    """
    return spark.read.json(path, schema=schema, multiLine=not lines)


def read_holdout(spark: SparkSession, path: str) -> DataFrame:
    """Exclusion rows (``kind, key``) of a holdout manifest; paths may have either kind of slash."""
    m = spark.read.json(path, schema=HOLDOUT, multiLine=True)
    chunks = m.select(F.explode("arrl_labeled").alias("x"))
    parts = [
        m.select(F.lit("source").alias("kind"), F.explode("arrl_sources").alias("key")),
        chunks.select(F.lit("source").alias("kind"), F.coalesce("x.source_key", source_key(F.col("x.npy"))).alias("key")),
        chunks.select(F.lit("file").alias("kind"), base_name(F.col("x.npy")).alias("key")),
        m.select(F.explode("kaggle_labeled").alias("x")).select(F.lit("file").alias("kind"), base_name(F.col("x.path")).alias("key")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def read_folds(spark: SparkSession, path: str, fold: str = "all", lines: bool = False) -> DataFrame:
    """Items of a fold manifest: ``fold, chunk_file, source_key, text``. Raises when a named fold is not there."""
    m = _documents(spark, path, FOLDS, lines).select(F.explode("folds").alias("f"))
    if fold != "all":
        m = m.where(F.col("f.name") == fold)
        if not m.limit(1).count():
            raise ValueError(f"no fold {fold} in {path}")
    return m.select(F.col("f.name").alias("fold"), F.explode("f.items").alias("i")).select("fold", base_name(F.col("i.npy")).alias("chunk_file"), "i.source_key", "i.text")


def read_results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Result files of all ages under one nullable schema, with the file's name."""
    return _documents(spark, path, RESULT, lines).withColumn("file", base_name(F.input_file_name()))


def read_cases(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row for each case of synthetic result files."""
    rows = _documents(spark, path, CASES, lines).withColumn("file", base_name(F.input_file_name()))
    return rows.select("file", "timestamp", F.explode("synthetic").alias("case", "r")).select("file", "timestamp", "case", "r.*")


def write_chunks(chunks: DataFrame, path: str, by: tuple[str, ...] = ("dataset", "wpm"), replace: bool = False) -> None:
    """Labelled chunks as one partitioned table; with ``replace`` only the partitions at hand are written anew."""
    out = chunks.repartition(*by).write.partitionBy(*by)
    if replace:
        out = out.option("partitionOverwriteMode", "dynamic")
    out.mode("overwrite" if replace else "append").parquet(path)


def write_label_map(rows: DataFrame, name: str, text: str, path: str) -> None:
    """One JSON object file of name -> text; such a map is one document, so it is for small tables."""
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, text))))
    rows.agg(F.to_json(pairs).alias("value")).write.mode("overwrite").text(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A small report as one JSON document."""
    rows.agg(F.collect_list(F.struct(*rows.columns)).alias("rows")).write.mode("overwrite").json(path)


def stream_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Recordings as they arrive; run with ``trigger(availableNow=True)`` and a checkpoint to label each one once."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path)
