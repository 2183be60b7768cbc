"""Structured Streaming over the event log (an extension; the batch path is authoritative)."""
