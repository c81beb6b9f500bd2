"""De-duplication over several loads that arrive as files.

A batch de-duplication sees one load.  Here the keys seen lately are kept as
state, so a copy that comes with a later file is dropped as well.

Defined results: of rows with equal keys the first to arrive stays; the
others are dropped if their event times lie within ``delay`` of it.  A row
older than the watermark (the latest event time so far, less ``delay``) is
late: it is dropped unseen and counted as late.  A key leaves the state when
the watermark passes its event time plus ``delay``, so the state holds the
keys of about ``delay`` of event time, whatever has arrived before; a copy
that comes after that counts as new.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def drop_repeats(stream: DataFrame, keys: Iterable[str], event_time: str, delay: str) -> DataFrame:
    """The first row of each key, as rows arrive; ``event_time`` is a timestamp column, ``delay`` an interval such as ``2 days``."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


class RepeatCounts(NamedTuple):
    rows_read: int
    duplicates: int                 # dropped as copies
    late: int                       # dropped behind the watermark
    keys_held: int                  # in the state after the last batch


def repeat_counts(query: StreamingQuery) -> RepeatCounts:
    """What a ``drop_repeats`` query has done so far, by its own progress reports (those Spark still keeps)."""
    read = duplicates = late = held = 0
    for progress in query.recentProgress:
        read += progress["numInputRows"]
        for state in progress["stateOperators"]:
            duplicates += int(state["customMetrics"].get("numDroppedDuplicateRows", 0))
            late += int(state["numRowsDroppedByWatermark"])
            held = int(state["numRowsTotal"])
    return RepeatCounts(read, duplicates, late, held)
