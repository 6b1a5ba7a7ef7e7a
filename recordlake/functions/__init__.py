"""functions of the record archive engine."""
