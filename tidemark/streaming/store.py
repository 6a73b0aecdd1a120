"""Storing ticks and divergences in batches, by size or time, with retry of the oldest first."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.tables import cut, numbered_rows

Write = Callable[[str, DataFrame], None]


def flushes(rows: DataFrame, by: str, at: str, order: str, size: int = 5000, ms: int = 500) -> DataFrame:
    """The batch that each row of a table ``by`` falls in: ``window`` (each ``ms`` of ``at``) and ``part`` (each ``size`` rows in
    it), as a writer that flushes on either makes them."""
    timed = rows.withColumn("window", F.expr(f"unix_millis({at}) div {ms}"))
    return numbered_rows(timed, [by, "window"], [order], "_n").withColumn("part", F.expr(f"(_n - 1) div {size}")).drop("_n")


@dataclass
class Counts:
    written: int = 0
    dropped: int = 0
    errors: int = 0


class Store:
    """Writes micro-batches of named tables through ``write``; give ``batch`` to ``foreachBatch``.

    A batch that fails stays queued and goes first at the next call, so order is kept. Queued batches are tables in the
    shared folder. Beyond ``most`` queued rows the oldest batch is dropped and counted; with None nothing is ever dropped."""

    def __init__(self, write: Write, most: int | None = 100_000):
        self.write, self.most, self.counts = write, most, Counts()
        self.queue: deque[tuple[str, DataFrame, int]] = deque()

    def put(self, table: str, rows: DataFrame) -> None:
        held = cut(rows)
        if n := held.count():
            self.queue.append((table, held, n))
        while self.most is not None and sum(n for _, _, n in self.queue) > self.most:
            self.counts.dropped += self.queue.popleft()[2]

    def flush(self) -> bool:
        """Writes what is queued, oldest first, up to the first failure."""
        while self.queue:
            table, rows, n = self.queue[0]
            try:
                self.write(table, rows)
            except Exception:  # noqa: BLE001 - the sink is out of reach; the batch waits
                self.counts.errors += 1
                return False
            self.queue.popleft()
            self.counts.written += n
        return True

    def batch(self, table: str) -> Callable[[DataFrame, int], None]:
        def run(rows: DataFrame, _: int) -> None:
            self.put(table, rows)
            self.flush()

        return run


def parquet(root: str) -> Write:
    """A write that appends to a Parquet table a name."""
    return lambda table, rows: rows.write.mode("append").parquet(f"{root}/{table}")
