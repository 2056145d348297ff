"""Recordings of any length in blocks: filter, power, spectra and pulses as of whole recordings, none of which a row or a task has to hold.

A block comes with a halo, sound of its neighbours (``recordings.read_blocks``). A causal filter that starts a halo early has forgotten its start when the block
begins; a centred spectrum takes half a window from it. Blocks begin at whole frames of both kinds, so frames are numbered through the recording.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import SAMPLE_RATE
from ..sources.io import stored
from . import signal
from .percentiles import percentiles
from .scans import scan, sliced

#: Sixteen seconds, whole frames of 40 (power) and of 32 samples (spectrum); and half a second, after which the filter's memory is below 1e-12.
BLOCK, HALO = 128_000, 4_096
FRAME, HOP, WINDOW = 40, 32, 256
#: Recordings whose carriers may be broadcast; above it both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def carriers(blocks: DataFrame, key: str) -> DataFrame:
    """``key, carrier_hz``: the strongest frequency of the middle ten seconds, which are put together from the few blocks that hold them."""
    half = 5 * SAMPLE_RATE
    low, high = F.greatest(F.lit(0), F.floor(F.col("n_samples") / 2) - half), F.floor(F.col("n_samples") / 2) + half
    a, b = F.greatest(low, F.col("first")), F.least(high, F.col("first") + F.col("own"))
    part = F.slice("audio", (F.col("before") + a - F.col("first") + 1).cast("int"), (b - a).cast("int"))
    parts = blocks.where((b > a) | (F.col("n_samples") == 0)).select(key, F.struct("first", F.when(b > a, part).otherwise(F.array().cast("array<float>")).alias("x")).alias("p"))
    middle = parts.groupBy(key).agg(F.flatten(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["x"])).alias("audio"))
    return signal.detect_carrier(middle, "audio").select(key, "carrier_hz")


def _levels(x: np.ndarray, before: int, own: int, hz: float) -> np.ndarray:
    return signal.envelope(signal.bandpass(np.asarray(x)[: before + own], hz)[before:], 1000 * FRAME / SAMPLE_RATE)


def levels(blocks: DataFrame, key: str) -> DataFrame:
    """``key, frame, level``: power of each frame of five milliseconds in a band around the recording's carrier."""
    hz = stored(carriers(blocks, key))
    rows = blocks.select(key, "first", "before", "own", "audio").join(F.broadcast(hz) if hz.count() <= BROADCAST_ROWS else hz, key)
    got = signal._mapped(rows, ["audio", "before", "own", "carrier_hz"], "level", "array<double>", _levels).drop("audio")
    return got.select(key, "first", F.posexplode("level").alias("i", "level")).select(key, (F.col("first") / FRAME + F.col("i")).cast("long").alias("frame"), "level")


def to_pulses(blocks: DataFrame, key: str) -> DataFrame:
    """``key, start_s, dur_s, is_tone``, as ``signal.to_pulses`` finds them; one recording's frames may be in any number of tasks."""
    frames = sliced(levels(blocks, key), [key], ["frame"])
    level = F.col("level")
    near = scan(frames, key, "frame", {"__b": ("lag", level), "__a": ("lead", level)}, keep_slice=True)
    smooth = stored(near.withColumn("smooth", (F.coalesce("__b", level) + level + F.coalesce("__a", level)) / 3).drop("__a", "__b", "level"))
    bounds = stored(percentiles(smooth, key, "smooth", {"low": 0.1, "high": 0.9}))
    on = smooth.join(F.broadcast(bounds) if bounds.count() <= BROADCAST_ROWS else bounds, key)
    on = on.withColumn("is_on", F.col("smooth") > F.col("low") + (F.col("high") - F.col("low")) * 0.35).drop("low", "high", "smooth")
    flips = stored(scan(on, key, "frame", {"__was": ("lag", F.col("is_on"))}, keep_slice=True).withColumn("__new", F.coalesce((F.col("is_on") != F.col("__was")).cast("int"), F.lit(1))))
    runs = scan(flips, key, "frame", {"__run": ("sum", F.col("__new"))})
    got = runs.groupBy(key, "__run").agg(F.min("frame").alias("a"), F.count("*").alias("n"), F.first("is_on").alias("is_tone"))
    frame_s = FRAME / SAMPLE_RATE
    return got.select(key, (F.col("a") * frame_s).alias("start_s"), (F.col("n") * frame_s).alias("dur_s"), "is_tone")


def _mel(x: np.ndarray, before: int, own: int, first: int, n: int) -> np.ndarray:
    x, half = np.asarray(x), WINDOW // 2
    if before == 0 and own == n:
        return signal.log_mel_of(x, WINDOW, HOP)
    end = before + own
    more = (max(0, half - before), max(0, end + half - len(x)))  # only a recording's own ends are mirrored
    wide = np.pad(x.astype(np.float64), more, mode="reflect")[before + more[0] - half : end + more[0] + half]
    frames = signal.mel_frames(wide, WINDOW, HOP)
    return frames if first + own == n else frames[: own // HOP]


def log_mel(blocks: DataFrame, key: str) -> DataFrame:
    """``key, frame, mel``: a row for each block with the number of its first frame, the same frames as of the whole recording."""
    rows = blocks.select(key, "first", "before", "own", "n_samples", "audio")
    got = signal._mapped(rows, ["audio", "before", "own", "first", "n_samples"], "mel", "array<array<float>>", _mel)
    return got.select(key, (F.col("first") / HOP).cast("long").alias("frame"), "mel")
