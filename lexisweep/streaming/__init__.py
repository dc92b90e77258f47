"""The same columns and operators on unbounded input."""
