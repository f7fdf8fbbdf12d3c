"""Structured Streaming operators: readiness (T3), publishing (T5); T4 is D3 on a stream,
or against a published table (score_stream)."""

from featshare.streaming.publish_stream import publish_batch, publish_stream
from featshare.streaming.readiness_stream import readiness_stream
from featshare.streaming.score_stream import score_records, score_stream

__all__ = ["publish_batch", "publish_stream", "readiness_stream", "score_records", "score_stream"]
