"""Column expressions: NULL-propagating logic, recodes and hash-based randomness."""
