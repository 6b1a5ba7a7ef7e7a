"""sources of the record archive engine."""
