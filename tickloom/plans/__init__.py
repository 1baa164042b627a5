"""Whole computations put together from the operators: signals, model, backtest."""
