"""Column expressions: text keys, numbers, shares, geometry measures."""
