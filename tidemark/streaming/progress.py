"""Numbers of running queries, by Spark's own events."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Rows read and batches of each named query so far, and how it ended."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.ended: list[str] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        name = event.progress.name or str(event.progress.id)
        self.rows[name] = self.rows.get(name, 0) + event.progress.numInputRows
        self.batches[name] = self.batches.get(name, 0) + 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append(str(event.id))

    def lines(self) -> list[str]:
        """As text exposition."""
        return [f'{metric}{{query="{q}"}} {n}' for metric, of in (("rows_total", self.rows), ("batches_total", self.batches)) for q, n in sorted(of.items())]
