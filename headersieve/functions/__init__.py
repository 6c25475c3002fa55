"""Column functions and the fixed values behind them."""
