"""Running quotas and duplicate filters over streams.

State per key is a bounded list of timestamps and two counters; it lives in Spark's
state store, so a restarted query goes on where it stopped.  The batch forms apply the
same rule to a table in time order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "key string, event_id long, ts timestamp, admitted boolean, reason string"
_STATE = "recent array<long>, day long, used long"
DAY_US = 86_400_000_000


def _judge(recent: list[int], day: int, used: int, us: int, per_window: int, window_us: int, per_day: int) -> tuple[list[int], int, int, str | None]:
    """State after a request and the reason of its refusal; refused requests use nothing up."""
    if us // DAY_US != day:
        day, used = us // DAY_US, 0
    recent = [x for x in recent if us - x < window_us]
    if len(recent) >= per_window:
        return recent, day, used, "window"
    if used >= per_day:
        return recent, day, used, "day"
    return [*recent, us], day, used + 1, None


def _admit(pdf: pd.DataFrame, state: tuple, per_window: int, window_us: int, per_day: int) -> tuple[pd.DataFrame, tuple]:
    pdf = pdf.sort_values(["ts", "event_id"])
    recent, day, used = state
    said = []
    for us in pdf["ts"].astype("datetime64[us]").astype("int64"):
        recent, day, used, why = _judge(recent, day, used, int(us), per_window, window_us, per_day)
        said.append(why)
    out = pdf[["key", "event_id", "ts"]].copy()
    out["admitted"] = [w is None for w in said]
    out["reason"] = said
    return out, (recent, day, used)


def admission_stream(events: DataFrame, per_window: int = 4, window_s: float = 60, per_day: int = 500) -> DataFrame:
    """(key, event_id, ts, admitted, reason) of a stream with these first three columns."""
    window_us = int(window_s * 1_000_000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ([], -1, 0)
        now = (list(now[0]), now[1], now[2])
        for pdf in frames:
            out, now = _admit(pdf, now, per_window, window_us, per_day)
            yield out
        state.update((now[0], now[1], now[2]))

    return events.groupBy("key").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def admission_batch(events: DataFrame, per_window: int = 4, window_s: float = 60, per_day: int = 500) -> DataFrame:
    """The same over a table.

    Within a key the rule is sequential; keys are first cut into sections that no window
    spans (a gap of at least the window before a new UTC day), which are independent, so
    a key of many days is spread over tasks.
    """
    from pyspark.sql import Window

    window_us = int(window_s * 1_000_000)
    us = F.unix_micros("ts")
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    cut = (us - F.lag(us).over(w) >= window_us) & (F.floor(us / DAY_US) != F.floor(F.lag(us).over(w) / DAY_US))
    part = F.sum(F.coalesce(cut, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _admit(pdf, ([], -1, 0), per_window, window_us, per_day)[0]

    return events.select("key", "event_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("section", part).groupBy("key", "section").applyInPandas(run, _OUT)


def submission_stream(events: DataFrame, per_run: int = 1, per_day: int = 500) -> DataFrame:
    """Admission per run and per UTC day: one window as long as a run, kept per run key."""
    return admission_stream(events, per_run, DAY_US / 1_000_000 * 36_500, per_day)


def first_requests(events: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Drops repeats of the keys that arrive within the allowed lateness; state is bounded by it."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, ts: str, kind: str, length: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per tumbling window and kind, late rows up to ``late`` included."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length), kind).agg(F.count(F.lit(1)).alias("n"))
