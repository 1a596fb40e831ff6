"""Starting a stream again from its checkpoint after a failure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql.streaming import StreamingQuery


def run_with_restarts(start: Callable[[], StreamingQuery], restarts: int = 3) -> int:
    """Runs the query that ``start`` begins to its end and gives the number of restarts it took.

    A failed query is started again, which goes on from its checkpoint, at most ``restarts`` times in a row without
    progress; then the failure is raised.
    """
    taken, failed, reached = 0, 0, -1
    while True:
        query = start()
        try:
            query.awaitTermination()
            return taken
        except StreamingQueryException:
            last = query.lastProgress
            batch = last.batchId if last is not None else -1
            failed = failed + 1 if batch <= reached else 1
            reached = max(reached, batch)
            if failed > restarts:
                raise
            taken += 1
