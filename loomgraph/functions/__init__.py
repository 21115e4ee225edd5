"""Column expressions and the few Arrow functions behind them."""
