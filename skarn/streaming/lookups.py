"""Lookups through a cache whose entries live for a time, as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds that an answer and a failure are kept (fixed values).
LIVE, LIVE_FAILED = 6 * 3600, 60
RESULT = "key string, event_id long, ts timestamp, fetched boolean, source long, available boolean"


def _looked_up(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(parts).sort_values(["ts", "event_id"], kind="stable")
    until, source, available = state.get if state.exists else (None, None, False)
    out = []
    for event, at, ok in zip(rows["event_id"].tolist(), rows["ts"].astype("datetime64[us]").astype("int64").tolist(), rows["ok"].tolist(), strict=True):
        fetched = until is None or at >= until
        if fetched:
            until, source, available = at + (LIVE if ok else LIVE_FAILED) * 1_000_000, event, bool(ok)
        out.append((fetched, source, available))
    state.update((until, source, available))
    if until // 1000 > state.getCurrentWatermarkMs():
        state.setTimeoutTimestamp(until // 1000)
    made = pd.DataFrame(out, columns=["fetched", "source", "available"], index=rows.index)
    yield pd.DataFrame({"key": str(key[0]), "event_id": rows["event_id"], "ts": rows["ts"], "fetched": made["fetched"], "source": made["source"], "available": made["available"]})


def cached_lookups(events: DataFrame, key: str) -> DataFrame:
    """RESULT, a row for each lookup of a stream with event_id, ts (with a watermark), ok and ``key``: whether it had to be fetched, and by which lookup its answer was.

    A fetch that succeeds (``ok``) serves LIVE seconds, one that fails LIVE_FAILED;
    a lookup at the end of that time fetches again. Rows of a key are taken in the order of
    time within a micro-batch. An entry's state goes once the watermark has passed its end.
    """
    rows = events.select(key, "event_id", "ts", "ok").filter(f"`{key}` is not null")
    return rows.groupBy(key).applyInPandasWithState(_looked_up, RESULT, "until long, source long, available boolean", "append", GroupStateTimeout.EventTimeTimeout)
