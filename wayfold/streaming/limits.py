"""A token bucket for each key, as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECIDED = "key string, id long, at timestamp, allowed boolean"


def decide(times: list[float], tokens: float, last: float | None, rate: float, burst: float) -> tuple[list[bool], float, float | None]:
    """Of requests in order of time (seconds): if each finds a token; the tokens left, and the last time. Time does not run backwards: a late request fills nothing."""
    out = []
    for t in times:
        if last is not None and t > last:
            tokens = min(burst, tokens + (t - last) * rate)
        last = t if last is None else max(last, t)
        out.append(tokens >= 1)
        tokens -= out[-1]
    return out, tokens, last


def limited(requests: DataFrame, rate: float, burst: float, idle: str = "1 hour") -> DataFrame:
    """``key, id, at, allowed`` of a stream of ``key, id, at``: each key has ``burst`` tokens, refilled at ``rate`` a second.

    Within a batch a key's requests are taken in order of time, then id. A key that is idle for so long that its bucket is full again is forgotten: its state
    ends when the watermark (``idle``) has passed it. Null keys are a key; requests without a time are refused a place (no row).
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["at", "id"], kind="stable")
        tokens, last = state.get if state.exists else (float(burst), None)
        allowed, tokens, last = decide([t.timestamp() for t in rows["at"]], tokens, last, rate, burst)
        state.update((tokens, last))
        full = (last + (burst - tokens) / rate) * 1000 if rate > 0 else float("inf")
        if full < 4e15:
            state.setTimeoutTimestamp(max(int(full) + 1, state.getCurrentWatermarkMs() + 1))
        yield rows[["key", "id", "at"]].assign(allowed=allowed)

    rows = requests.where("at IS NOT NULL").withWatermark("at", idle)
    return rows.groupBy("key").applyInPandasWithState(run, DECIDED, "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)
