"""operators of the record archive engine."""
