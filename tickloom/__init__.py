"""Market-quote analytics on Spark: cleaning, signals, models and backtests, in batch and in streams."""
