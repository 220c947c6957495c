"""Stateful stream operators: drift by source, and buffers for inference."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.analytics import BASELINE_EVENTS, BASELINE_RATE, CLEAN, TRIP_MISSES, TRIP_RISE, WINDOW

QUIET_MS = 5000
STATE = "events long, misses long, n long, m long, tripped boolean, clean int"
OUT = "source string, tripped boolean, trips int, baseline_events long, baseline_misses long, quiet boolean"


def judge(state: tuple, events: int, misses: int) -> tuple[tuple, int]:
    """The drift machine's step for one window: (n, m, tripped, clean) and whether it tripped just now."""
    n, m, tripped, clean = state
    rate, base = misses / events, m / n if n else 0.0
    if tripped:
        clean = clean + 1 if rate < base + TRIP_RISE else 0
        return ((0, 0, False, 0) if clean >= CLEAN else (n, m, True, clean)), 0
    if n >= BASELINE_EVENTS and base < BASELINE_RATE and misses >= TRIP_MISSES and rate >= base + TRIP_RISE:
        return (n, m, True, 0), 1
    return (n + events, m + misses, False, 0), 0


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    events, misses, n, m, tripped, clean = state.get if state.exists else (0, 0, 0, 0, False, 0)
    trips, quiet = 0, False
    if state.hasTimedOut:  # a silent source's partial window counts if it holds misses enough
        quiet = misses >= TRIP_MISSES
        if quiet:
            (n, m, tripped, clean), t = judge((n, m, tripped, clean), events, misses)
            trips, events, misses = trips + t, 0, 0
    for pdf in frames:
        for missed in pdf.sort_values("raw_id").missed:
            events, misses = events + 1, misses + bool(missed)
            if events == WINDOW:
                (n, m, tripped, clean), t = judge((n, m, tripped, clean), events, misses)
                trips, events, misses = trips + t, 0, 0
    state.update((events, misses, n, m, tripped, clean))
    state.setTimeoutDuration(QUIET_MS)
    yield pd.DataFrame({"source": [key[0]], "tripped": [tripped], "trips": [trips], "baseline_events": [n], "baseline_misses": [m], "quiet": [quiet]})


def drift_stream(events: DataFrame) -> DataFrame:
    """(source, raw_id, missed) as a stream -> each source's drift state after every micro-batch."""
    return events.groupBy("source").applyInPandasWithState(_step, OUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
