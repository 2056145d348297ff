"""Training logs: rows of epochs and batches, best epochs, streaks below a target, and a stream that raises an alarm."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.scans import scan

EPOCH = r"Epoch\s+(\d+)/(\d+)\s+\|\s+Loss:\s+([\d.]+)\s+\|\s+CER:\s+([\d.]+)\s+\|\s+Time:\s+([\d.]+)s\s+\|\s+([\d.]+)ms/batch"
BATCH = r"\[(\d\d:\d\d:\d\d)\]\s+Epoch\s+(\d+)\s+\|\s+batch\s+(\d+)/(\d+)\s+\|\s+loss\s+([\d.]+)\s+\|\s+([\d.]+)ms/batch\s+\|\s+ETA\s+([\d.]+)min"


def _fields(df: DataFrame, line: str, pattern: str, kinds: dict[str, str]) -> DataFrame:
    rows = df.where(F.col(line).rlike(pattern))
    return rows.select(*[c for c in df.columns if c != line], *[F.regexp_extract(line, pattern, i).try_cast(t).alias(n) for i, (n, t) in enumerate(kinds.items(), 1)])


def parse_epochs(df: DataFrame, line: str = "value") -> DataFrame:
    """Epoch rows of log lines; anything else is passed over."""
    return _fields(df, line, EPOCH, {"epoch": "int", "epochs": "int", "loss": "double", "cer": "double", "seconds": "double", "ms_per_batch": "double"})


def parse_batches(df: DataFrame, line: str = "value") -> DataFrame:
    return _fields(df, line, BATCH, {"time": "string", "epoch": "int", "batch": "int", "batches": "int", "loss": "double", "ms_per_batch": "double", "eta_min": "double"})


def best_epochs(epochs: DataFrame, run: str) -> DataFrame:
    """First best epoch, its error rate and the total time of each run."""
    best = F.min(F.struct("cer", "epoch")).alias("b")
    return epochs.groupBy(run).agg(best, F.sum("seconds").alias("seconds"), F.count("*").alias("epochs")).select(run, F.col("b.epoch").alias("best_epoch"), F.col("b.cer").alias("best_cer"), "seconds", "epochs")


def improvements(epochs: DataFrame, run: str) -> DataFrame:
    """Whether an epoch beats all before it; a run may be of any length."""
    rows = scan(epochs, run, "epoch", {"__before": ("min_before", F.col("cer"))})
    return rows.withColumn("is_best", F.col("__before").isNull() | (F.col("cer") < F.col("__before"))).drop("__before")


def streaks(epochs: DataFrame, run: str, target: float = 0.015, patience: int = 3) -> DataFrame:
    """Runs of epochs in a row below the target: first, last, length and whether it is long enough."""
    ok = F.col("cer") < target
    rows = scan(epochs.withColumn("__ok", ok), run, "epoch", {"__island": ("sum", (~ok).cast("int"))})
    got = rows.where("__ok").groupBy(run, "__island").agg(F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"), F.count("*").alias("length"))
    return got.select(run, "first_epoch", "last_epoch", "length", (F.col("length") >= patience).alias("alarm"))


class _Streak(StatefulProcessor):
    """Last epoch seen and length of the streak of one run; epochs that come again are ignored."""

    def __init__(self, target: float, patience: int):
        self.target, self.patience = target, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("streak", "last int, length int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, length = self.state.get() if self.state.exists() else (None, 0)
        found = []
        every = pd.concat(list(rows)).drop_duplicates("epoch").sort_values("epoch")
        for epoch, cer in zip(every["epoch"], every["cer"], strict=True):
            if last is not None and epoch <= last:
                continue
            last, length = int(epoch), length + 1 if cer < self.target else 0
            if length == self.patience:
                found.append((key[0], last, float(cer)))
        self.state.update((last, length))
        yield pd.DataFrame(found, columns=["run", "epoch", "cer"])

    def close(self) -> None:
        pass


def stream_target_alarm(epochs: DataFrame, run: str = "run", target: float = 0.015, patience: int = 3) -> DataFrame:
    """One row for each run when its error rate has been below the target ``patience`` epochs in a row. Restarts go on from the checkpoint."""
    return epochs.groupBy(run).transformWithStateInPandas(_Streak(target, patience), outputStructType="run string, epoch int, cer double", outputMode="Append", timeMode="None")
