"""Column -> Column expressions: time-codes, text and identifiers."""
