"""Column expressions: scores, labels and payload parsing."""
