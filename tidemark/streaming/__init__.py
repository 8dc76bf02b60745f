"""Structured Streaming: topics, event-time windows and stateful operators."""
