"""Structured Streaming: windowed metrics and keyed state machines."""
