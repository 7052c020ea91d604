"""Column expressions over sequences, qualities and intervals."""
