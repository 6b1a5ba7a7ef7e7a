"""streaming of the record archive engine."""
