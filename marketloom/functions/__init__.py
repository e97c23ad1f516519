"""Column expressions: cleaning, signals, sizing, costs, prices, reason codes."""
