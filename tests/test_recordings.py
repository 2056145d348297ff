"""Recordings as files: written, read, paired, and labelled as they arrive, over crashes."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.functions import text
from tonelake.operators import label, signal
from tonelake.sources import io, recordings
from tonelake.streaming import arrivals


@pytest.fixture(scope="module")
def sent(spark):
    texts = ["CQ CQ DE TEST", "THE QUICK BROWN FOX JUMPS", "ONE TWO THREE FOUR", "PARIS PARIS PARIS", "73 AND OUT NOW"]
    rows = spark.createDataFrame([(f"rec{i}", 20.0, t) for i, t in enumerate(texts)], "recording_id string, wpm double, sent string")
    sound = signal.render(rows.withColumn("events", text.timing_events(F.col("sent"), 20.0)), "events").drop("events")
    return signal.encode_wav(sound).drop("audio").cache()


def test_files_of_rows(spark, sent, tmp_path):
    recordings.write_files(sent, str(tmp_path), "wav")
    recordings.write_files(sent.where("recording_id = 'rec1'"), f"file://{tmp_path}", "wav")  # a task run again
    assert sorted(os.listdir(tmp_path / "20wpm")) == [f"rec{i}.wav" for i in range(5)]
    want = {r["recording_id"]: bytes(r["content"]) for r in sent.collect()}
    for rows in (recordings.read_files(spark, str(tmp_path)), io.read_recordings(spark, str(tmp_path))):
        assert {r["recording_id"]: (r["wpm"], bytes(r["content"])) for r in rows.collect()} == {k: (20.0, v) for k, v in want.items()}
    recordings.write_files(sent.limit(1), str(tmp_path), "wav", replace=True)
    assert recordings.read_files(spark, str(tmp_path)).count() == 1


def test_odd_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, bytearray(b"")), ("b", 7.5, None), ("c d", 7.5, bytearray(b"x"))], "recording_id string, wpm double, content binary")
    recordings.write_files(rows, str(tmp_path), "raw")
    got = {r["recording_id"]: (r["wpm"], bytes(r["content"])) for r in recordings.read_files(spark, str(tmp_path), "raw").collect()}
    assert got == {"a": (None, b""), "c d": (7.5, b"x")}
    os.makedirs(tmp_path / "empty")
    assert recordings.read_files(spark, str(tmp_path / "empty")).count() == 0
    for bad in ("../x", "", ".hidden", "a/b"):
        with pytest.raises(ValueError):
            recordings.place_of(bad, None, "wav")


def test_pairs(spark, sent, tmp_path):
    recordings.write_files(sent, f"{tmp_path}/sound", "wav")
    recordings.write_files(sent.where("recording_id <> 'rec2'").withColumn("content", F.when(F.col("recording_id") == "rec3", " ").otherwise(F.col("sent")).cast("binary")), f"{tmp_path}/texts", "txt")
    got = io.pair(io.read_recordings(spark, f"{tmp_path}/sound"), io.read_texts(spark, f"{tmp_path}/texts")).collect()
    assert {r["recording_id"]: r["raw_text"] for r in got} == {f"rec{i}": t for i, t in enumerate(["CQ CQ DE TEST", "THE QUICK BROWN FOX JUMPS", "", "", "73 AND OUT NOW"]) if t}


def test_arriving_recordings_exactly_once(spark, sent, tmp_path):
    """Files arrive in three steps. The second batch is written, then the driver dies before the commit: its rows are not seen, and come once after the restart."""
    texts = sent.select("recording_id", "wpm", F.col("sent").alias("raw_text"))
    job = lambda files: label.label_recordings(io.pair(io.recordings_of(files), texts), "recording_id", "content", "raw_text", "wpm")
    sound, out, checkpoint = f"{tmp_path}/sound", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    schema = "recording_id string, chunk_idx int, text string, n_words int, start_s double, end_s double, error string"
    os.makedirs(sound)
    seen = lambda: sorted(r["recording_id"] for r in arrivals.read_labels(spark, out, schema).select("recording_id").distinct().collect())
    assert seen() == []

    def run(written=None):
        arrivals.label_arrivals(io.stream_recordings(spark, sound), job, out, checkpoint, written=written).awaitTermination()

    def die(_):
        raise RuntimeError("the driver died")

    recordings.write_files(sent.where("recording_id < 'rec2'"), sound, "wav")
    run()
    assert seen() == ["rec0", "rec1"]
    recordings.write_files(sent.where("recording_id in ('rec2', 'rec3')"), sound, "wav")
    with pytest.raises(Exception, match="the driver died"):
        run(die)
    assert seen() == ["rec0", "rec1"]
    recordings.write_files(sent.where("recording_id = 'rec4'"), sound, "wav")
    run()
    run()
    batch = job(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(sound))
    rows = lambda df: sorted(tuple(r) for r in df.select("recording_id", "chunk_idx", "text", "n_words", "start_s", "end_s", "error").collect())
    got = arrivals.read_labels(spark, out, schema)
    assert rows(got) == rows(batch) and got.select("batch").distinct().count() == 3
    assert len(seen()) == 5 and np.all([r["error"] is None for r in got.collect()])
