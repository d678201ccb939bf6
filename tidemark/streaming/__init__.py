"""Structured Streaming: log replay with a read view, price feeds and event-time windows."""
