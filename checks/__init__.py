"""Inputs and DuckDB statements that check the operators; not part of the library."""
