"""The same operators on Structured Streaming sources.

The cleaning operators are pure projections and filters and the payment
summary is a plain grouped aggregate, so they apply unchanged to a streaming
DataFrame; ``incremental`` only wires source, checkpoint and sink.
``dedupe`` keeps the keys seen lately, so that copies in later files go too.
"""

from orderlens.streaming.dedupe import RepeatCounts, drop_repeats, repeat_counts
from orderlens.streaming.incremental import payment_summary_stream, read_stream, start, stream_checkpoint

__all__ = ["RepeatCounts", "drop_repeats", "repeat_counts", "payment_summary_stream", "read_stream", "start", "stream_checkpoint"]
