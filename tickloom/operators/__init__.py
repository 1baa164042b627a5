"""DataFrame operators: cleaning, encoding, window statistics, ordered series, as-of matching."""
