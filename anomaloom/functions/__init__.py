"""Column expressions: text clean-up, labels, numbers, rules."""
