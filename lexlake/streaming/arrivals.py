"""Run the lake's batch jobs for every micro-batch of a stream of marks."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexlake.plans.lake import Lake


def _utc_now() -> datetime:
    return datetime.now(timezone.utc)


def update_on_arrival(
    marks: DataFrame,
    lake: Lake,
    checkpoint: str,
    clock: Callable[[], datetime] = _utc_now,
    available_now: bool = True,
    retry_every: timedelta = timedelta(hours=1),
) -> StreamingQuery:
    """Update stage to golden with each micro-batch; by default take what has arrived and stop.

    Marks may arrive in any order. A batch that is replayed after a failure does no harm: stage takes only marks it lacks,
    and the later tables find what they have not seen by its stamp. Tokens that stayed undefined are asked for again
    once per ``retry_every``, with the first batch after it, an empty one too; other empty batches do nothing. A lake with
    a schedule of retries asks for what is due instead, also after a restart.
    """
    last_retry: list[datetime] = []

    def update(batch: DataFrame, _: int) -> None:
        now = clock()
        if lake.retries is not None:
            retry = lake.retry_due(now)
        else:
            retry = not last_retry or now - last_retry[-1] >= retry_every
        if not retry and batch.isEmpty():
            return
        lake.update_internal(batch, now, in_order=False, retry=retry)
        if retry:
            last_retry[:] = [now]

    writer = marks.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
