"""Progress of streams: counts observed per batch, gathered by a listener."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

NAME = "sedge"


def observed(stream: DataFrame, existed: str | None = None) -> DataFrame:
    """Counts discovered (and, with a flag column, skipped) rows of each batch under the name ``sedge``."""
    counts = [F.count(F.lit(1)).alias("discovered")]
    if existed:
        counts.append(F.count_if(F.col(existed)).alias("skipped"))
    return stream.observe(NAME, *counts)


class Progress(StreamingQueryListener):
    """Sums of what ``observed`` counted; ``finished`` turns true when a query ends."""

    def __init__(self):
        self.totals: dict[str, int] = {}
        self.finished = False

    def onQueryStarted(self, event):  # noqa: N802
        self.finished = False

    def onQueryProgress(self, event):  # noqa: N802
        row = (event.progress.observedMetrics or {}).get(NAME)
        for k, v in (row.asDict() if row else {}).items():
            self.totals[k] = self.totals.get(k, 0) + v

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        self.finished = True
