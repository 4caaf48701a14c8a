"""Column expressions: text, scores and catalogue arithmetic."""
