"""Trials from a stream of events: a trial opens with its start event and leaves with its end event."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trialloom.functions.alignment import TRIAL_END, TRIAL_START

_STATE = "names array<string>, times array<double>"
_OUT = "trial_id long, t_start double, t_end double, names array<string>, times array<double>, complete boolean"


def assemble(stream: DataFrame, patience: str | None = None) -> DataFrame:
    """One row for each trial of stream(trial_id, event, t) once its TrialEnd has come.

    Times are counted from TrialStart and ordered; events of a trial may come in any order
    before its end. With patience (such as "10 minutes", of processing time) a trial that
    hears nothing for so long leaves as it is, with complete false. State is kept for open
    trials alone.
    """
    wait = pd.Timedelta(patience).value // 1_000_000 if patience else None

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, times = map(list, state.get) if state.exists else ([], [])
        late = state.hasTimedOut
        for frame in frames if not late else ():
            names += frame["event"].tolist()
            times += frame["t"].astype(float).tolist()
        if TRIAL_END in names or late:
            state.remove()
            at = sorted(range(len(names)), key=lambda i: (times[i], names[i]))
            first = min((times[i] for i in at if names[i] == TRIAL_START), default=min(times))
            yield pd.DataFrame({"trial_id": [key[0]], "t_start": [0.0], "t_end": [max(times) - first], "names": [[names[i] for i in at]], "times": [[times[i] - first for i in at]], "complete": [TRIAL_END in names and TRIAL_START in names]})
        else:
            state.update((names, times))
            if wait:
                state.setTimeoutDuration(wait)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if patience else GroupStateTimeout.NoTimeout
    return stream.select("trial_id", "event", "t").groupBy("trial_id").applyInPandasWithState(step, _OUT, _STATE, "append", timeout)


def windowed_counts(stream: DataFrame, width: str, lateness: str) -> DataFrame:
    """Counts of each event in tumbling windows of stream(ts, event, ...); rows later than
    lateness behind the newest are left out, which bounds the state."""
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event", "n")


def sessions(stream: DataFrame, by: str, gap: str, lateness: str) -> DataFrame:
    """Stretches of a key without a gap: start, stop and number of events."""
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", lateness).groupBy(w, by).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """A query that appends every micro-batch of trials to a Parquet table."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
