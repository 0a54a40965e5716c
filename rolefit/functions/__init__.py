"""Column expressions and the small Arrow helpers behind them."""
