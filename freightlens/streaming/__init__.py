"""Structured Streaming jobs."""

from .audit_stream import batch_equivalent, run_audit_stream_once, start_audit_stream

__all__ = ["batch_equivalent", "run_audit_stream_once", "start_audit_stream"]
