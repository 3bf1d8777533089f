"""Progress of streams and of staged work, told to a function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Tells ``tell(name, batch, rows)`` of every micro-batch, and ``tell(name, None, None)`` of a stream's end."""

    def __init__(self, tell: Callable[[str | None, int | None, int | None], None]):
        self.tell, self.names = tell, {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.names[str(event.id)] = event.name

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.tell(p.name, p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.tell(self.names.pop(str(event.id), None), None, None)


def watch(spark: SparkSession, tell: Callable[[str | None, int | None, int | None], None]) -> Progress:
    """A listener that is added to the session; remove it with ``spark.streams.removeListener``."""
    listener = Progress(tell)
    spark.streams.addListener(listener)
    return listener


def staged(df: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], tell: Callable[[str, int, int], None]) -> DataFrame:
    """``df`` through named stages, each told as (name, number, of how many) before it is planned."""
    for i, (name, stage) in enumerate(stages, 1):
        tell(name, i, len(stages))
        df = stage(df)
    return df
