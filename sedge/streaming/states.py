"""Live job states: a keyed state machine over an event stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RANK = {"Pending": 0, "Generating": 1, "Generated": 2, "Failed": 2}


def _advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, seen = state.get if state.exists else ("Pending", 0)
    for b in batches:
        for s in b.sort_values("at_ms")["status"]:
            seen += 1
            if RANK.get(s, -1) >= RANK[status] or s == "Pending":  # a requeue may go back
                status = s
    state.update((status, seen))
    yield pd.DataFrame({"job_id": [key[0]], "status": [status], "events": [seen]})


def track(stream: DataFrame) -> DataFrame:
    """(job_id, status, events) after each batch from events (job_id, status, at_ms)."""
    return stream.groupBy("job_id").applyInPandasWithState(_advance, "job_id string, status string, events long", "status string, events long", "update", GroupStateTimeout.NoTimeout)
