"""Column expressions and the vocabulary of event logs."""
