"""Column expressions: cleaning, time, null rules, column-set helpers, p-values."""
