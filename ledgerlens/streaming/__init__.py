"""Structured Streaming adapters for the batch operators.

The reference has no streaming layer. The cleaning, filter and scoring
operators perform no actions, so they apply unchanged to a streaming frame;
this package only supplies the stream source and a restartable sink.
"""

from ledgerlens.streaming.stream import (
    read_transaction_stream,
    scored_stream,
    start_sink,
)

__all__ = ["read_transaction_stream", "scored_stream", "start_sink"]
