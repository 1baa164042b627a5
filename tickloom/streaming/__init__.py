"""Structured Streaming: sinks, and the queries of the quote service."""
