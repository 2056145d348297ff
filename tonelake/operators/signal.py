"""Dense signal work, one recording or chunk a row: numpy inside tasks, rows dealt by Spark.

Waveforms are arrays of floats at ``SAMPLE_RATE``. Each helper works on one array; the functions with a DataFrame apply it to a column in
small Arrow batches.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import SAMPLE_RATE, TARGET_WPM, WPM_HIGH, WPM_LOW

#: Rows whose waveforms a task holds at a time.
ROWS_AT_A_TIME = 16


# --- one waveform ---


def pcm(raw: bytes, rate: int = SAMPLE_RATE) -> np.ndarray:
    """WAV or bare 16-bit samples -> mono floats at ``SAMPLE_RATE``."""
    channels = 1
    if raw[:4] == b"RIFF":
        with wave.open(io.BytesIO(raw)) as w:
            rate, channels, raw = w.getframerate(), w.getnchannels(), w.readframes(w.getnframes())
    x = np.frombuffer(raw[: len(raw) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels).mean(1) / 32768
    if rate != SAMPLE_RATE and len(x):
        x = np.interp(np.linspace(0, len(x) - 1, max(1, round(len(x) * SAMPLE_RATE / rate))), np.arange(len(x)), x)
    return x.astype(np.float32)


def carrier(x: np.ndarray, low: float = 300, high: float = 1200, default: float = 700) -> float:
    """Strongest frequency of the middle ten seconds."""
    middle, half = len(x) // 2, 5 * SAMPLE_RATE
    part = x[max(0, middle - half) : middle + half]
    power = np.abs(np.fft.rfft(part)) if len(part) else np.empty(0)
    hz = np.fft.rfftfreq(len(part), 1 / SAMPLE_RATE) if len(part) else np.empty(0)
    inside = np.flatnonzero((hz >= low) & (hz <= high))
    return float(hz[inside[power[inside].argmax()]]) if len(inside) and power[inside].max() > 0 else default


def band_sections(low: float, high: float, order: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections of a Butterworth band filter: analogue poles, shifted to the band, mapped by the bilinear rule."""
    rate = 2 * SAMPLE_RATE
    a, b = (rate * np.tan(np.pi * f / SAMPLE_RATE) for f in (low, high))
    width, centre = b - a, np.sqrt(a * b)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * width / 2
    root = np.sqrt(poles**2 - centre**2)
    analogue = np.concatenate([poles + root, poles - root])
    digital = (rate + analogue) / (rate - analogue)
    upper = digital[digital.imag > 0]
    out = [(np.array([1.0, 0.0, -1.0]), np.array([1.0, -2 * p.real, abs(p) ** 2])) for p in upper]
    mid = np.exp(2j * np.arctan(centre / rate))
    gain = np.prod([np.polyval(n, mid) / np.polyval(d, mid) for n, d in out])
    out[0] = (out[0][0] / abs(gain), out[0][1])
    return out


def bandpass(x: np.ndarray, centre: float, width: float = 400) -> np.ndarray:
    """The causal filter, as its exact response on a padded spectrum."""
    if not len(x):
        return x
    low, high = max(50.0, centre - width / 2), min(SAMPLE_RATE / 2 - 50, centre + width / 2)
    n = 1 << int(np.ceil(np.log2(max(8192, 2 * len(x)))))
    z = np.exp(2j * np.pi * np.fft.rfftfreq(n))
    sections, square = band_sections(low, high), z * z
    below = np.ones_like(z)
    for _, den in sections:
        below *= square + den[1] * z + den[2]
    response = np.prod([num[0] for num, _ in sections]) * (square - 1) ** len(sections) / below  # every numerator is z^2 - 1, times a gain
    return np.fft.irfft(np.fft.rfft(x, n) * response, n)[: len(x)]


def envelope(x: np.ndarray, window_ms: float = 5) -> np.ndarray:
    """Power of whole windows; the rest is dropped."""
    k = max(1, int(SAMPLE_RATE * window_ms / 1000))
    return np.sqrt((x[: len(x) // k * k].reshape(-1, k).astype(float) ** 2).mean(1))


def runs(on: np.ndarray, frame_s: float) -> list[tuple[float, float, bool]]:
    if not len(on):
        return []
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(on)) + 1, [len(on)]])
    return [(a * frame_s, (b - a) * frame_s, bool(on[a])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def levels(x: np.ndarray, carrier_hz: float | None = None, window_ms: float = 5) -> np.ndarray:
    """Power of each frame in a band around the carrier."""
    return envelope(bandpass(x, carrier(x) if carrier_hz is None else carrier_hz), window_ms)


def speed(x: np.ndarray, window_ms: float = 2) -> float:
    """Words a minute from the short tones; the target speed where nothing can be measured."""
    env = envelope(x, window_ms)
    if not len(env) or env.max() <= 0:
        return TARGET_WPM
    shifted = np.full((5, len(env)), np.nan)
    for k, d in enumerate(range(-2, 3)):
        shifted[k, max(0, -d) : len(env) - max(0, d)] = env[max(0, d) : len(env) - max(0, -d)]
    env = np.nanmedian(shifted, axis=0)
    floor, peak = np.percentile(env, [20, 95])
    if peak <= floor:
        return TARGET_WPM
    tones = [d for _, d, tone in runs(env > floor + 0.35 * (peak - floor), window_ms / 1000) if tone and d >= 0.6 / WPM_HIGH]
    dit = np.percentile(tones, 10) if tones else 0
    return float(np.clip(1.2 / dit, WPM_LOW, WPM_HIGH)) if dit > 0 else TARGET_WPM


def stretched(x: np.ndarray, factor: float) -> np.ndarray:
    if abs(factor - 1) < 0.01 or not len(x):
        return x
    return np.interp(np.linspace(0, len(x) - 1, max(1, round(len(x) * factor))), np.arange(len(x)), x).astype(np.float32)


def at_speed(x: np.ndarray, known_wpm: float | None = None, target: float = TARGET_WPM) -> np.ndarray:
    src = speed(x) if known_wpm is None or np.isnan(known_wpm) else known_wpm
    return stretched(x, float(np.clip(src, target / 2, target * 2)) / target)


def mel_bank(n_fft: int = 256, bands: int = 64, low: float = 200, high: float = 4000) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    hz = 700 * (10 ** (np.linspace(mel(low), mel(high), bands + 2) / 2595) - 1)
    f = np.linspace(0, SAMPLE_RATE / 2, n_fft // 2 + 1)[:, None]
    return np.maximum(0, np.minimum((f - hz[:-2]) / (hz[1:-1] - hz[:-2]), (hz[2:] - f) / (hz[2:] - hz[1:-1])))


def log_mel_of(x: np.ndarray, n_fft: int = 256, hop: int = 32) -> np.ndarray:
    """Frames x bands: log(1 + power) of triangular bands over a centred Hann spectrum."""
    if len(x) <= n_fft // 2:
        x = np.pad(x, (0, n_fft // 2 + 1 - len(x)))
    return mel_frames(np.pad(x.astype(np.float64), n_fft // 2, mode="reflect"), n_fft, hop)


def mel_frames(wide: np.ndarray, n_fft: int = 256, hop: int = 32) -> np.ndarray:
    """Frames of a stretch of sound that has half a window more on both sides."""
    frames = np.lib.stride_tricks.sliding_window_view(wide, n_fft)[::hop]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    return np.log1p((np.abs(np.fft.rfft(frames * window)) ** 2) @ mel_bank(n_fft)).astype(np.float32)


def rendered(durations: np.ndarray, tones: np.ndarray, hz: float = 700, rise_ms: float = 5, noise: float = 0.0, seed: int = 0) -> np.ndarray:
    """A keyed tone with soft edges, full scale, and a quarter second of rest; one second of silence for no events."""
    if not len(durations):
        return np.zeros(SAMPLE_RATE, np.float32)
    n = np.round(np.asarray(durations) * SAMPLE_RATE).astype(int)
    parts = []
    for size, tone in zip(n, tones, strict=True):
        level = np.full(size, 1.0 if tone else 0.0)
        edge = min(int(rise_ms * SAMPLE_RATE / 1000), size // 2)
        if tone and edge:
            ramp = 0.5 - 0.5 * np.cos(np.pi * np.arange(edge) / edge)
            level[:edge], level[size - edge :] = ramp, ramp[::-1]
        parts.append(level)
    level = np.concatenate([*parts, np.zeros(SAMPLE_RATE // 4)])
    x = level * np.sin(2 * np.pi * hz * np.arange(len(level)) / SAMPLE_RATE)
    if noise:
        x = x + noise * np.random.default_rng(seed).standard_normal(len(x))
    return (x / max(1e-9, np.abs(x).max())).astype(np.float32)


def disturbed(x: np.ndarray, seed: int) -> np.ndarray:
    """Fading, pink and white noise, a second carrier, a narrow band: each with its own chance; full scale again."""
    rng = np.random.default_rng(seed & 0xFFFFFFFF)
    t = np.arange(len(x)) / SAMPLE_RATE
    chance = rng.random(5)
    if chance[0] < 0.5:
        x = x * (1 - rng.uniform(0.2, 0.6) * (0.5 + 0.5 * np.sin(2 * np.pi * rng.uniform(0.1, 0.6) * t + rng.uniform(0, 6))))
    if chance[1] < 0.6:
        spectrum = np.fft.rfft(rng.standard_normal(len(x))) / np.sqrt(np.maximum(1, np.arange(len(x) // 2 + 1)))
        pink = np.fft.irfft(spectrum, len(x))
        x = x + rng.uniform(0.02, 0.2) * pink / max(1e-9, np.abs(pink).max())
    if chance[2] < 0.4:
        x = x + rng.uniform(0.005, 0.05) * rng.standard_normal(len(x))
    if chance[3] < 0.3:
        x = x + rng.uniform(0.05, 0.3) * np.sin(2 * np.pi * rng.uniform(400, 1200) * t)
    if chance[4] < 0.4:
        x = bandpass(x, rng.uniform(600, 800), rng.uniform(300, 800))
    return (x / max(1e-9, np.abs(x).max())).astype(np.float32)


# --- columns ---


def _cells(column: pa.Array) -> list:
    """Values of a column; lists of floats as arrays without a copy."""
    if not (pa.types.is_list(column.type) and pa.types.is_floating(column.type.value_type)):
        return column.to_pylist()
    flat = column.values.to_numpy(zero_copy_only=False)
    cuts = column.offsets.to_numpy()
    return [flat[i:j] if ok else None for i, j, ok in zip(cuts[:-1], cuts[1:], column.is_valid().to_pylist(), strict=True)]


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """The other way: arrays of one or two dimensions as lists, anything else as it is."""
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    some = [v for v in values if v is not None]
    cuts = pa.array(np.concatenate([[0], np.cumsum([0 if v is None else len(v) for v in values])]).astype(np.int32))
    inner = kind.value_type
    if pa.types.is_list(inner):
        rows = np.concatenate(some) if some else np.empty((0, 0))
        flat = pa.ListArray.from_arrays(pa.array((np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)), pa.array(rows.ravel(), inner.value_type))
    else:
        flat = pa.array(np.concatenate(some) if some else np.empty(0), inner)
    return pa.ListArray.from_arrays(cuts, flat, mask=pa.array([v is None for v in values]))


def _mapped(df: DataFrame, inputs: list[str], out: str, kind: str, fn, error: str | None = None) -> DataFrame:
    """``df`` with ``out`` = fn(*inputs) for each row; a null first input gives null. With ``error`` a failed row has null and the message there."""
    schema = T.StructType([f for f in df.schema if f.name not in (out, error)]).add(out, T._parse_datatype_string(kind))
    new = [schema[out]]
    if error:
        schema = schema.add(error, "string")

    def one(row: tuple) -> tuple:
        try:
            return (None if row[0] is None else fn(*row)), None
        except Exception as e:  # noqa: BLE001 - the message is part of the result
            if error is None:
                raise
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for whole in batches:
            for k in range(0, whole.num_rows, ROWS_AT_A_TIME):
                p = whole.slice(k, ROWS_AT_A_TIME)
                got = [one(r) for r in zip(*[_cells(p.column(c)) for c in inputs], strict=True)]
                columns = {c: p.column(c) for c in p.schema.names if c not in (out, error)}
                columns[out] = _column([g for g, _ in got], to_arrow_type(new[0].dataType))
                if error:
                    columns[error] = pa.array([e for _, e in got], pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return df.mapInArrow(run, schema)


def decode_pcm(df: DataFrame, raw: str = "content", out: str = "audio", error: str | None = None) -> DataFrame:
    return _mapped(df, [raw], out, "array<float>", lambda b: pcm(bytes(b)), error)


def render(df: DataFrame, events: str, out: str = "audio", hz: float | str = 700, noise: float = 0.0) -> DataFrame:
    """``events``: array<struct<dur_s, is_tone>>; ``hz``: one tone for all, or a column."""
    if isinstance(hz, str):
        return _mapped(df, [events, hz], out, "array<float>", lambda e, f: rendered(np.array([x["dur_s"] for x in e]), [x["is_tone"] for x in e], hz=f, noise=noise))
    return _mapped(df, [events], out, "array<float>", lambda e: rendered(np.array([x["dur_s"] for x in e]), [x["is_tone"] for x in e], hz=hz, noise=noise))


def detect_carrier(df: DataFrame, audio: str = "audio", out: str = "carrier_hz") -> DataFrame:
    return _mapped(df, [audio], out, "double", lambda x: round(carrier(np.asarray(x)), 1))


def encode_pcm(df: DataFrame, audio: str = "audio", out: str = "content") -> DataFrame:
    """Waveforms as bare 16-bit samples."""
    return _mapped(df, [audio], out, "binary", lambda x: np.round(np.clip(np.asarray(x), -1, 1) * 32767).astype("<i2").tobytes())


def encode_wav(df: DataFrame, audio: str = "audio", out: str = "content") -> DataFrame:
    """Waveforms as the bytes of mono 16-bit WAV files."""
    def one(x) -> bytes:
        made = io.BytesIO()
        with wave.open(made, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(SAMPLE_RATE)
            w.writeframes(np.round(np.clip(np.asarray(x), -1, 1) * 32767).astype("<i2").tobytes())
        return made.getvalue()

    return _mapped(df, [audio], out, "binary", one)


def to_pulses(df: DataFrame, key: str, audio: str = "audio", window_ms: float = 5) -> DataFrame:
    """``key, start_s, dur_s, is_tone``. Only the filter runs on whole waveforms in a task; frames become pulses in windows over each recording."""
    from ..sources.io import stored
    from .pulses import binarize_frames, frames_to_pulses, moving_mean

    frames = _mapped(df.select(key, audio), [audio], audio, "array<double>", lambda x: levels(np.asarray(x), None, window_ms))
    frames = stored(frames).select(key, F.posexplode(audio).alias("frame", "level"))  # read twice: for the bounds and for the frames
    on = binarize_frames(moving_mean(frames, key, "frame", "level"), key, "smooth")
    return frames_to_pulses(on, key, "frame", "is_on", int(SAMPLE_RATE * window_ms / 1000) / SAMPLE_RATE)


def detect_wpm(df: DataFrame, audio: str = "audio", out: str = "wpm") -> DataFrame:
    return _mapped(df, [audio], out, "double", lambda x: speed(np.asarray(x)))


def normalize_speed(df: DataFrame, audio: str = "audio", out: str = "audio", target: float = TARGET_WPM, known_wpm: str | None = None) -> DataFrame:
    """Stretched to the target speed; ``known_wpm``: a column of speeds, where null the speed is measured."""
    if known_wpm:
        return _mapped(df, [audio, known_wpm], out, "array<float>", lambda x, w: at_speed(np.asarray(x), w, target))
    return _mapped(df, [audio], out, "array<float>", lambda x: at_speed(np.asarray(x), None, target))


def log_mel(df: DataFrame, audio: str = "audio", out: str = "mel") -> DataFrame:
    return _mapped(df, [audio], out, "array<array<float>>", lambda x: log_mel_of(np.asarray(x)))


def augment(df: DataFrame, key: str, seed: int, audio: str = "audio") -> DataFrame:
    seeded = df.withColumn("__seed", F.xxhash64(F.lit(seed), F.col(key)))
    return _mapped(seeded, [audio, "__seed"], audio, "array<float>", lambda x, s: disturbed(np.asarray(x), int(s))).drop("__seed")


def prepared(df: DataFrame, key: str, seed: int, audio: str = "audio", normalize_share: float = 0.5, augment_share: float = 0.5) -> DataFrame:
    """A share of the rows at the target speed, a share disturbed, each drawn by a hash of its own; ``normalized`` and ``augmented`` say which."""
    from .splits import drawn

    rows = df.withColumn("normalized", drawn(seed, "normalize", key, normalize_share)).withColumn("augmented", drawn(seed, "augment", key, augment_share)).withColumn("__seed", F.xxhash64(F.lit(seed), F.col(key)))

    def one(x, normalize: bool, augment: bool, s: int) -> np.ndarray:
        x = np.asarray(x)
        x = at_speed(x) if normalize else x
        return disturbed(x, int(s)) if augment else x

    return _mapped(rows, [audio, "normalized", "augmented", "__seed"], audio, "array<float>", one).drop("__seed")


def decode_audio(df: DataFrame, key: str, audio: str = "audio", known_wpm: float | None = None) -> DataFrame:
    """Words of recordings. The pulses are written once, as their speed and their words are found from them."""
    from ..sources.io import stored
    from .pulses import decode_words, estimate_dit

    flat = to_pulses(df, key, audio)
    if not known_wpm:
        flat = stored(flat)
    return decode_words(flat, 1.2 / known_wpm if known_wpm else estimate_dit(flat, key), key)


def peak_normalized(audio: Column) -> Column:
    top = F.array_max(F.transform(audio, lambda x: F.abs(x)))
    return F.when(top > 0, F.transform(audio, lambda x: x / top)).otherwise(audio)


def rms(audio: Column) -> Column:
    return F.sqrt(F.aggregate(audio, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.size(audio))


def seconds(audio: Column) -> Column:
    return F.size(audio) / float(SAMPLE_RATE)
