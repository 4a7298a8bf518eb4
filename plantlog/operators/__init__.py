"""Operators: pure ``DataFrame(s) -> DataFrame`` functions, one module per area."""
