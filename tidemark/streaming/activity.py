"""Active time kept up to date as log lines arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.activity import GAP_CAP_US


def running_active_time(messages: DataFrame, cap_us: int = GAP_CAP_US) -> DataFrame:
    """(agent, session_id, messages, active_us) after each micro-batch of a stream of messages.

    The state of a session is its last instant, its total and its count. Events of one batch are
    sorted; one that is older than the last instant is counted but adds no time (a later full run
    of `activity.sessions` has the exact figure).
    """

    def step(key: tuple, tables: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, total, n = state.get if state.exists else (None, 0, 0)
        instants = sorted(t for table in tables for t in table.ts_us.dropna().astype("int64"))
        for t in instants:
            if last is not None and t > last:
                total += min(t - last, cap_us)
            last = t if last is None else max(last, t)
            n += 1
        state.update((last, total, n))
        yield pd.DataFrame({"agent": [key[0]], "session_id": [key[1]], "messages": [n], "active_us": [total]})

    return messages.select("agent", "session_id", "ts_us").groupBy("agent", "session_id").applyInPandasWithState(
        step, "agent string, session_id string, messages long, active_us long", "last long, total long, n long", "update", GroupStateTimeout.NoTimeout
    )
