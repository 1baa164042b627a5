"""Readers: quote messages, daily bars, quote pages."""
