"""Long recordings in blocks against the same recordings in one row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.functions import text
from tonelake.operators import blocks, scans, signal
from tonelake.sources import recordings

SMALL = 16_000


@pytest.fixture(scope="module")
def sound(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long"))
    texts = ["PARIS " * 8, "THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG", "E", "CQ CQ CQ"]
    rows = spark.createDataFrame([(f"r{i}", 20.0, t, 500.0 + 90 * i) for i, t in enumerate(texts)], "recording_id string, wpm double, sent string, hz double")
    rows = signal.render(rows.withColumn("events", text.timing_events(F.col("sent"), 20.0)), "events", hz="hz", noise=0.02)
    exact = F.when(F.col("recording_id") == "r3", F.slice("audio", 1, 2 * SMALL + 64)).otherwise(F.col("audio"))  # a last block shorter than a window
    recordings.write_files(signal.encode_wav(rows.withColumn("audio", exact)), path)
    whole = signal.decode_pcm(recordings.read_files(spark, path)).select("recording_id", "audio").cache()
    return whole, recordings.read_blocks(spark, path, SMALL, blocks.HALO, at_once=2)


def test_blocks_hold_the_recording(spark, sound):
    whole, cut = sound
    want = {r["recording_id"]: np.array(r["audio"], np.float32) for r in whole.collect()}
    rows = cut.collect()
    assert max(len(r["audio"]) for r in rows) <= SMALL + 2 * blocks.HALO and max(r["n_samples"] for r in rows) > 8 * SMALL
    for k, x in want.items():
        mine = sorted((r for r in rows if r["recording_id"] == k), key=lambda r: r["first"])
        assert np.array_equal(np.concatenate([r["audio"][r["before"] : r["before"] + r["own"]] for r in mine]), x)
        for r in mine:
            assert np.array_equal(r["audio"], x[r["first"] - r["before"] : r["first"] + r["own"] + blocks.HALO])
    assert cut.rdd.getNumPartitions() > len(want)


def test_filter_and_spectra_equal_the_whole(spark, sound):
    whole, cut = sound
    want = {r["recording_id"]: np.array(r["audio"], np.float32) for r in whole.collect()}
    hz = {r["recording_id"]: r["carrier_hz"] for r in blocks.carriers(cut, "recording_id").collect()}
    assert hz == {k: round(signal.carrier(x), 1) for k, x in want.items()}
    got = {}
    for r in blocks.levels(cut, "recording_id").orderBy("frame").collect():
        got.setdefault(r["recording_id"], []).append((r["frame"], r["level"]))
    for k, x in want.items():
        level = signal.levels(x, hz[k])
        assert [f for f, _ in got[k]] == list(range(len(level))) and np.allclose([v for _, v in got[k]], level, atol=1e-6)
    mel = {}
    for r in blocks.log_mel(cut, "recording_id").orderBy("frame").collect():
        at = mel.setdefault(r["recording_id"], [])
        assert r["frame"] == len(at)
        at += r["mel"]
    for k, x in want.items():
        assert np.allclose(np.array(mel[k]), signal.log_mel_of(x), atol=1e-5) and len(mel[k]) == len(x) // 32 + 1


def test_pulses_over_many_tasks(spark, sound):
    whole, cut = sound
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        one = cut.where("recording_id = 'r0'")
        assert scans.sliced(blocks.levels(one, "recording_id"), ["recording_id"], ["frame"]).select(scans.SLICE).distinct().count() == 9
        rows = lambda df: sorted((r["recording_id"], round(r["start_s"], 6), round(r["dur_s"], 6), r["is_tone"]) for r in df.collect())
        assert rows(blocks.to_pulses(cut, "recording_id")) == rows(signal.to_pulses(whole, "recording_id"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
